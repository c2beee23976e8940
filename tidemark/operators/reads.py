"""Point gets and scans of a state. Prefixes are compared by bytes and reach Parquet as StartsWith."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def get(state: DataFrame, key: str, tombstones: bool = False) -> DataFrame:
    found = state.filter(F.col("key") == key)
    return found if tombstones else found.filter(F.col("value").isNotNull())


def by_prefix(state: DataFrame, prefix: str, tombstones: bool = False) -> DataFrame:
    found = state.filter(F.col("key").startswith(prefix)) if prefix else state
    return found if tombstones else found.filter(F.col("value").isNotNull())


def iterate(state: DataFrame, prefix: str = "", tombstones: bool = False):
    """Rows in key order, one partition at a time."""
    return by_prefix(state, prefix, tombstones).orderBy("key").toLocalIterator()


def ranked(state: DataFrame, prefix: str = "", tombstones: bool = False, stretch: int = 3) -> DataFrame:
    """Rows with `rank`, their place in key order from 1. Rows are ranked among keys that go on alike for
    `stretch` characters behind the prefix, and the counts of the groups before add to that."""
    rows = by_prefix(state, prefix, tombstones).withColumn("_g", F.substring("key", len(prefix) + 1, stretch))
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_c"))
    before = sizes.select("_g", (F.sum("_c").over(W.orderBy("_g")) - F.col("_c")).alias("_before"))  # a row a group
    out = rows.join(before, "_g").withColumn("rank", F.col("_before") + F.row_number().over(W.partitionBy("_g").orderBy("key")))
    return out.drop("_g", "_before")


def live(state: DataFrame) -> DataFrame:
    return state.filter(F.col("value").isNotNull())


def tombstones(state: DataFrame) -> DataFrame:
    return state.filter(F.col("value").isNull())
