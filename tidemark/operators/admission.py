"""Which incoming entries may land: size, clock, capacity, and the user's policy, in that order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.versions import FIELDS, size_bytes
from ..sources.files import shared_folder

STRETCH = 1 << 17  # rows that are sorted together before they are folded


@dataclass(frozen=True)
class Limits:
    max_key_bytes: int = 1024
    max_value_bytes: int = 1 << 20
    max_keys: int = 1_000_000
    max_total_bytes: int = 1 << 30
    max_drift_ms: int = 300_000


def entry_reason(limits: Limits, now_ms: int) -> Column:
    """Null, or why the entry alone may not land. Bounds are inclusive; past stamps are never refused."""
    return (
        F.when(F.octet_length("key") > limits.max_key_bytes, "key exceeds max_key_bytes")
        .when(F.octet_length("value") > limits.max_value_bytes, "value exceeds max_value_bytes")
        .when(F.col("timestamp") > min(now_ms + limits.max_drift_ms, (1 << 63) - 1), "timestamp too far in the future")
    )


def _no_rule() -> Column:
    return F.lit(None).cast("string")


def with_key_capacity(state: DataFrame, incoming: DataFrame, reason: Column, max_keys: int, rule: Column | None = None) -> DataFrame:
    """incoming with `reason`. New keys get places in the order of their first entry that nothing else refuses
    (an entry that the rule refuses takes no place); once all are taken, entries of other new keys are
    refused for that, before the rule is asked. Only the first max_keys new keys are ranked together."""
    marked = incoming.withColumn("_why", reason).withColumn("_rule", _no_rule() if rule is None else rule)
    room = max(0, max_keys - state.count())
    fresh = marked.filter("_why IS NULL AND _rule IS NULL").join(state.select("key"), "key", "left_anti").groupBy("key").agg(F.min("arrival").alias("_a"))
    placed = fresh.orderBy("_a").limit(room) if room else fresh.limit(0)
    taken, last = placed.agg(F.count("*"), F.max("_a")).first()
    full = F.lit(True) if not room else F.col("arrival") > last if taken == room else F.lit(False)
    known = state.select("key").unionByName(placed.select("key")).withColumn("_known", F.lit(True))
    out = marked.join(known, "key", "left")
    why = F.coalesce("_why", F.when(F.col("_known").isNull() & full, "max_keys reached"), "_rule")
    return out.select(*incoming.columns, why.alias("reason"))


def admit(state: DataFrame, incoming: DataFrame, limits: Limits, now_ms: int, policy: Callable[[], Column] | None = None) -> DataFrame:
    """incoming with `reason` (null: admitted). policy makes a column: a reason, or null. It is asked last, and
    what it refuses takes up no capacity.

    Where the batch cannot reach the byte cap, all is columns; else capacity depends on the arrivals
    before, and the entries of new keys are folded in their order."""
    why, rule = entry_reason(limits, now_ms), policy() if policy else _no_rule()
    have, keys = state.agg(F.coalesce(F.sum(size_bytes()), F.lit(0)), F.count("*")).first()
    most, rows = incoming.filter(why.isNull() & rule.isNull()).agg(F.coalesce(F.sum(size_bytes()), F.lit(0)), F.count("*")).first()
    if have + most < limits.max_total_bytes and keys + rows < limits.max_keys:  # no capacity can run out
        return incoming.withColumn("reason", F.coalesce(why, rule))
    if have + most < limits.max_total_bytes:
        return with_key_capacity(state, incoming, why, limits.max_keys, rule)
    return fold_capacity(state, incoming.withColumn("_why", why).withColumn("_rule", rule), limits)


def growth_of_known(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """(arrival, grown): how many bytes each winning entry of a key in the state adds. Capacity never refuses
    those, so it follows from columns alone."""
    from .merge import decided

    own = incoming.join(state.select("key"), "key", "left_semi")
    won = decided(state, own).select("key", "arrival", size_bytes().alias("_size")).unionByName(state.select("key", F.lit(-1).cast("long").alias("arrival"), size_bytes().alias("_size")))
    before = F.lag("_size").over(W.partitionBy("key").orderBy("arrival"))
    return won.withColumn("grown", F.col("_size") - before).filter("arrival >= 0 AND grown IS NOT NULL").select("arrival", "grown")


def in_order(pieces):
    """Rows of (partition, rows) in the order of partitions. One task reads all, one after the other, but where the
    rows have preferred places, the first may be one that is not due yet: it waits for its turn."""
    first, waiting, last = None, [], -1
    for part, rows in pieces:
        first = part if first is None else first
        if part == first > 0:
            waiting.append(rows)
            continue
        if waiting and part > first:
            yield from waiting
            waiting, last = [], first
        if part < last:
            raise RuntimeError(f"partition {part} came behind {last}")
        last = part
        yield rows
    yield from waiting


def _sorted_stretches(rows: DataFrame, most: int) -> DataFrame:
    """rows (at most so many) in arrival order, pinned by stretches that are numbered in _part."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    order = ["arrival", "node", "seq"]  # of equal arrivals those of lower nodes and seqs come first
    return rows.repartitionByRange(1 + most // STRETCH, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).checkpoint()


def fold_capacity(state: DataFrame, marked: DataFrame, limits: Limits) -> DataFrame:
    """Both capacities in arrival order: a new key is refused when the store with the batch so far is at either.
    marked: incoming with _why and _rule. One task reads the entries of new keys, and the growth of
    known ones as numbers, a batch at a time; it remembers the new keys that got in, max_keys at most. They were
    sorted by many tasks before, so that one sorts nothing."""
    columns = [c for c in marked.columns if c not in ("_why", "_rule")]
    have, keys = state.agg(F.coalesce(F.sum(size_bytes()), F.lit(0)), F.count("*")).first()
    settled = marked.filter("_why IS NOT NULL").unionByName(marked.filter("_why IS NULL").join(state.select("key"), "key", "left_semi").select(*marked.columns))
    settled = settled.select(*columns, F.coalesce("_why", "_rule").alias("reason"))
    fresh = marked.filter("_why IS NULL").join(state.select("key"), "key", "left_anti").select(*columns, "_rule").withColumn("_size", size_bytes()).withColumn("_grown", F.lit(None).cast("long"))
    known = growth_of_known(state, marked.filter("_why IS NULL AND _rule IS NULL").select(*columns))
    events = fresh.unionByName(known.select("arrival", F.col("grown").alias("_grown")), allowMissingColumns=True)
    most, cap = limits.max_keys, limits.max_total_bytes

    def fold(batches):
        held: dict = {}
        total, n = int(have), int(keys)
        for pdf in in_order((part, rows) for batch in batches for part, rows in batch.groupby("_part", sort=False)):
            reasons = []
            for key, node, seq, stamp, rule, size, grown in zip(*(pdf[c].tolist() for c in ("key", "node", "seq", "timestamp", "_rule", "_size", "_grown")), strict=True):
                if grown == grown and grown is not None:  # not NaN: a known key's growth
                    total += int(grown)
                    reasons.append(None)
                    continue
                version, why = (int(stamp), int(node), int(seq)), None
                if key not in held:
                    why = "max_keys reached" if n >= most else "max_total_bytes reached" if total >= cap else None
                why = why or (rule if isinstance(rule, str) else None)
                if why is None and (key not in held or version > held[key][1]):
                    n += key not in held
                    total += int(size) - (held[key][0] if key in held else 0)
                    held[key] = (int(size), version)
                reasons.append(why)
            mine = pdf["_grown"].isna()
            yield pdf.assign(reason=pd.Series(reasons, index=pdf.index, dtype=object))[mine][[*columns, "reason"]]

    schema = T.StructType([*marked.select(*columns).schema.fields, T.StructField("reason", T.StringType())])
    return settled.unionByName(_sorted_stretches(events, marked.count() + known.count()).coalesce(1).mapInPandas(fold, schema))


def merge_admitted(state: DataFrame, incoming: DataFrame, limits: Limits, now_ms: int, policy=None):
    """(state after, rows with reasons): one refused entry makes the batch incomplete, not void."""
    from .merge import merge

    checked = admit(state, incoming, limits, now_ms, policy)
    return merge(state, checked.filter("reason is null").select(*FIELDS, "arrival")), checked
