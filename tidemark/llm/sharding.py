"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first (a matrix whose row sums are
the partitions' counts and whose column sums are the shards' sizes, as a uniform permutation would
give). Then each partition permutes its rows and deals them out by its row of the matrix, and each
shard permutes what it gets. DataFrame functions only; the driver sees one count a partition. The
first permutation is a sort inside the input's partitions, so rows are exchanged once."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import stage


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good balls among `draws` taken from an urn. Every count's weight relative to the mode's follows from
    ratios of neighbours, so no large factorials cancel, and the weights are summed rather than
    assumed to be 1; counts over nine standard deviations away weigh less than a double resolves."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    reach = 40 + int(9 * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))))
    k = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    up = np.cumprod((good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1)))
    k = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    down = np.cumprod(k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1)))
    weight = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    at = int(np.searchsorted(weight, rng.random() * weight[-1], "right"))
    return mode - len(down) + min(at, len(weight) - 1)


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """One row of counts by shard for each partition. Shard sizes are at most one apart."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        left, rest, row = n, sum(room), []
        for s in range(shards):
            rest -= room[s]
            k = _hypergeometric(rng, room[s], rest, left)
            row.append(k)
            left -= k
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def shard(df: DataFrame, shards: int = 16, seed: int = 7, group_rows: int = 1 << 16) -> DataFrame:
    """df with `shard` (int, 0 to shards-1; sizes at most one apart) and `slot` (long, gapless from 0
    in a shard). Columns of df by these names are replaced; all others, whatever their names, nulls and
    repeated rows stay. An empty table gives an empty result. Every row is one ball of the urn, whatever
    it holds, so equal or null keys make no partition hot. The input, in its permuted order, is written
    once to the shared folder, so all passes see the same rows in the same partitions.

    group_rows: about how many rows of a shard are ordered together; their number follows from it."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    rows = df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id"))
    rows = rows.sortWithinPartitions(F.xxhash64("id", F.lit(seed)), "id").select("row", F.monotonically_increasing_id().alias("id"))
    part = F.shiftright("id", 33)
    base = stage(rows, "shard")
    counted = base.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    matrix = communication_matrix([r["count"] for r in counted], shards, seed)
    ends = [(r["part"], np.cumsum(row).tolist()) for r, row in zip(counted, matrix, strict=True)]
    groups = max(1, -(-sum(r["count"] for r in counted) // (shards * group_rows)))
    plan = spark.createDataFrame(ends, "part long, ends array<long>")
    place = F.col("id").bitwiseAND((1 << 33) - 1)  # in its partition's permutation
    sent = base.withColumn("part", part).join(plan, "part")
    sent = sent.select("row", "id", F.size(F.filter("ends", lambda e: e <= place)).cast("int").alias("shard"), F.xxhash64("id", F.lit(seed + 1)).alias("key"))
    sent = sent.withColumn("fan", F.pmod(F.shiftright("key", 20), F.lit(groups)))
    placed = sent.withColumn("at", F.row_number().over(W.partitionBy("shard", "fan").orderBy("key", "id")))
    sizes = sent.groupBy("shard", "fan").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "fan", (F.sum("n").over(W.partitionBy("shard").orderBy("fan")) - F.col("n")).alias("before"))  # a row a group
    out = placed.join(before, ["shard", "fan"])
    return out.select("row.*", "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"))


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 under the law `rows`."""
    raw = F.coalesce("text", F.lit("")).cast("binary")  # no copy into another encoding
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shard(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
