"""Last-writer-wins merge of entries, and replay of an ordered log.

The reducers aggregate before they shuffle, so a key with very many versions is no hot task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import FIELDS, size_bytes, version


def lww(entries: DataFrame) -> DataFrame:
    """Per key the entry of the highest version; of equal versions the first arrival, where there is one."""
    order = [F.col("timestamp"), F.col("node"), F.col("seq")]
    if "arrival" in entries.columns:
        order.append(-F.col("arrival"))
    best = F.max_by(F.struct(*FIELDS[1:]), F.struct(*order))
    return entries.groupBy("key").agg(best.alias("e")).select("key", *[F.col(f"e.{c}") for c in FIELDS[1:]])


def last_arrival(entries: DataFrame, order: str = "arrival") -> DataFrame:
    """Per key the entry that comes last in log order, whatever its version (local writes and replay)."""
    best = F.max_by(F.struct(*FIELDS[1:]), F.col(order))
    return entries.groupBy("key").agg(best.alias("e")).select("key", *[F.col(f"e.{c}") for c in FIELDS[1:]])


def merge(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """State after incoming entries: an entry replaces the stored one only if its version is higher."""
    stored = state.select(*FIELDS).withColumn("arrival", F.lit(-1).cast("long"))
    if "arrival" not in incoming.columns:
        incoming = incoming.withColumn("arrival", F.lit(0).cast("long"))
    return lww(stored.unionByName(incoming.select(*FIELDS, F.col("arrival").cast("long"))))


def decided(state: DataFrame, incoming: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Incoming entries that beat everything before them, in arrival order: stored entries come first.

    The best version of each key is found for every `width` arrivals first, by partial aggregation; what
    came before a stretch follows from those. So a key's entries are sorted a stretch at a time."""
    rows = incoming.select(*FIELDS, F.col("arrival").cast("long")).withColumn("_w", F.floor(F.col("arrival") / width))
    best = rows.groupBy("key", "_w").agg(F.max(version()).alias("_v"))
    best = best.unionByName(state.select("key", F.lit(None).cast("long").alias("_w"), version().alias("_v")))  # null sorts first
    earlier = best.withColumn("_p", F.max("_v").over(W.partitionBy("key").orderBy(F.col("_w").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)))
    earlier = earlier.filter("_w IS NOT NULL").select("key", "_w", "_p")
    inside = F.max(version()).over(W.partitionBy("key", "_w").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1))
    before = F.greatest("_i", "_p")  # skips nulls
    out = rows.withColumn("_i", inside).join(earlier, ["key", "_w"])
    return out.filter(before.isNull() | (version() > before)).select(*FIELDS, "arrival")


def net_effect(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: new_keys, bytes_delta that merging would bring."""
    after = lww(incoming.withColumn("_in", F.lit(1)).drop("_in"))
    s = state.select("key", size_bytes().alias("_old"), version().alias("_v"))
    won = after.join(s, "key", "left").filter(F.col("_v").isNull() | (version() > F.col("_v")))
    return won.agg(F.count_if(F.col("_v").isNull()).alias("new_keys"), F.coalesce(F.sum(size_bytes() - F.coalesce("_old", F.lit(0))), F.lit(0)).alias("bytes_delta"))


@dataclass
class MergeOutcome:
    merged: int
    rejected: int
    complete: bool
    peer_delta_empty: bool = False
    digest_match: bool | None = None
    resume_from: tuple[int, int] | None = None
    acks_adopted: bool = False


def replay(base: DataFrame, ops: DataFrame) -> DataFrame:
    """base (a snapshot) after Set and Clear records, in log order (wal_seq)."""
    last = ops.filter(F.col("op").isin("Set", "Clear")).groupBy("key").agg(F.max_by(F.struct("op", *FIELDS[1:]), "wal_seq").alias("e"))
    untouched = base.select(*FIELDS).join(last.select("key"), "key", "left_anti")
    return untouched.unionByName(last.filter("e.op = 'Set'").select("key", *[F.col(f"e.{c}") for c in FIELDS[1:]]))


def valid_prefix(ops: DataFrame) -> DataFrame:
    """Log records before the first whose crc does not fit; crc covers all other columns but wal_seq's file order."""
    bad = ops.filter(F.col("crc") != record_crc()).agg(F.min("wal_seq").alias("_bad"))
    return ops.crossJoin(F.broadcast(bad)).filter(F.col("_bad").isNull() | (F.col("wal_seq") < F.col("_bad"))).drop("_bad")  # bad is one row


def record_crc(columns=("wal_seq", "op", "key", "value", "node", "seq", "timestamp")):
    """The checksum of a log record's columns."""
    cell = lambda c: F.coalesce(F.hex(F.col(c).cast("string")), F.lit("-"))
    return F.crc32(F.encode(F.concat_ws("|", *[cell(c) for c in columns]), "UTF-8"))
