"""Digests of a state, and signs of divergence."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import canonical_hex


def state_digest(state: DataFrame) -> DataFrame:
    """One row: the SHA-256 (hex) of the entries' canonical encodings in key order. One cell holds the
    encodings, so it is for states of up to about 1 GB; beyond that see streamed_digest and bucketed_digest."""
    rows = state.select("key", canonical_hex().alias("_h"))
    return rows.agg(F.expr("sha2(unhex(coalesce(listagg(_h) WITHIN GROUP (ORDER BY key), '')), 256)").alias("digest"))


def streamed_digest(state: DataFrame) -> str:
    """The same digest of a state of any size: sorted by Spark, hashed on the driver, a partition at a time."""
    h = hashlib.sha256()
    for r in state.select("key", canonical_hex().alias("_h")).orderBy("key").toLocalIterator():
        h.update(bytes.fromhex(r["_h"]))
    return h.hexdigest()


def bucketed_digest(state: DataFrame, buckets: int = 4096) -> DataFrame:
    """(bucket, digest): a digest for each hash bucket of keys, made in parallel; replicas that differ
    differ in some bucket, and only that needs a closer look."""
    rows = state.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", canonical_hex().alias("_h"))
    return rows.groupBy("bucket").agg(F.expr("sha2(unhex(listagg(_h) WITHIN GROUP (ORDER BY key)), 256)").alias("digest"))


def combined_digest(state: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row: a digest of the buckets' digests. Equal for equal states like state_digest, but no cell
    holds more than one bucket, so it is for states of any size."""
    parts = bucketed_digest(state, buckets).select("bucket", F.concat(F.lpad(F.hex("bucket"), 8, "0"), F.upper("digest")).alias("_h"))
    return parts.agg(F.expr("sha2(unhex(coalesce(listagg(_h) WITHIN GROUP (ORDER BY bucket), '')), 256)").alias("digest"))


def short(column):
    return F.substring(column, 1, 16)


def streaks(rounds: DataFrame, threshold: int = 3) -> DataFrame:
    """rounds(peer, round, merged, peer_delta_empty, digest_match) with `streak`, quiescent mismatches in a
    row so far, and `repair`, whether it reaches the threshold. Other rounds neither count nor reset."""
    quiet = (F.col("merged") == 0) & F.col("peer_delta_empty") & F.col("digest_match").isNotNull()
    hit = (quiet & ~F.col("digest_match")).cast("long")
    w = W.partitionBy("peer").orderBy("round")
    island = F.sum((quiet & F.col("digest_match")).cast("long")).over(w)
    out = rounds.withColumn("_i", island).withColumn("_h", F.coalesce(hit, F.lit(0)))
    out = out.withColumn("streak", F.sum("_h").over(W.partitionBy("peer", "_i").orderBy("round")))
    return out.withColumn("repair", (F.col("streak") > 0) & (F.col("streak") % threshold == 0) & (F.col("_h") == 1)).drop("_i", "_h")
