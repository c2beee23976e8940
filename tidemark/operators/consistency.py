"""Agreement of replicas and directories, and debug projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .members import peer_status


def replica_consistency(files: DataFrame, replicas: int) -> DataFrame:
    """files(dir_id, name, content): per name copies, versions, consistent (in every directory, all equal)."""
    got = files.groupBy("name").agg(F.count("*").alias("copies"), F.count_distinct(F.md5(F.col("content").cast("binary"))).alias("versions"))
    return got.withColumn("consistent", F.lit(replicas < 2) | ((F.col("copies") == replicas) & (F.col("versions") == 1)))


def debug_state(state: DataFrame, prefix: str) -> DataFrame:
    rows = state.filter(F.col("key").startswith(prefix))
    return rows.select(F.expr(f"substring(key, {len(prefix) + 1})").alias("name"), F.coalesce(F.octet_length("value"), F.lit(0)).alias("value_size"), F.col("value").isNull().alias("is_tombstone"), "timestamp", "seq", F.col("node").alias("origin"))


def debug_acks(members: DataFrame, own: int, acks: DataFrame, peer_acks: DataFrame) -> DataFrame:
    """(peer, ack, peer_ack) of every other member: what is covered here, and what it said it covers of own's."""
    return peer_status(members, own, acks, peer_acks).filter(F.col("id") != own).select(F.col("id").alias("peer"), "ack", "peer_ack")


def debug_raw(state: DataFrame, most: int = 100) -> DataFrame:
    text = F.col("value").cast("string")
    preview = F.when(F.octet_length(text) > most, F.concat(F.expr(f"left(cast(value as string), {most})"), F.lit("..."))).otherwise(text)
    return state.select("key", F.when(F.is_valid_utf8(text), preview).alias("value_preview"), F.col("value").isNull().alias("is_tombstone"), "timestamp", "seq", F.col("node").alias("origin"))


def reconcile(listing: DataFrame, state: DataFrame) -> DataFrame:
    """listing(name, content) against state(name, value): status by name; tombstones without a file are left out."""
    f, s = listing.select("name", F.col("content").alias("_c"), F.lit(True).alias("_f")), state.select("name", F.col("value").alias("_v"), F.lit(True).alias("_s"))
    status = F.when(F.col("_s").isNull(), "not_in_kv").when(F.col("_f").isNull(), F.when(F.col("_v").isNotNull(), "missing_on_fs")).when(F.col("_v").isNull(), "tombstone").when(F.col("_c") == F.col("_v"), "match").otherwise("mismatch")
    return f.join(s, "name", "full").select("name", status.alias("status")).filter("status is not null")
