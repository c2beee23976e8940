"""Random changes of directories, for tests and benchmarks: the same seed gives the same changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def churn(spark: SparkSession, steps: int, directories: int = 3, files: int = 50, seed: int = 0) -> DataFrame:
    """(step, dir_id, op, name, content): of a hundred steps forty create, thirty modify and thirty delete, in
    directories and files dealt out evenly. A delete has no content."""
    mixed = lambda a, m: F.pmod(F.col("id") * F.lit(a) + F.lit(seed), F.lit(m))
    turn = mixed(37, 100)
    op = F.when(turn < 40, "create").when(turn < 70, "modify").otherwise("delete")
    rows = spark.range(steps).select(F.col("id").alias("step"), mixed(7919, directories).alias("dir_id"), op.alias("op"), F.concat(F.lit("file-"), mixed(104729, files).cast("string")).alias("name"))
    return rows.withColumn("content", F.when(F.col("op") != "delete", F.concat_ws(" ", F.col("op"), F.col("name"), F.col("step").cast("string"))))


def as_entries(changes: DataFrame, prefix: str = "__file/") -> DataFrame:
    """The changes as entries, a directory being a node and a step a timestamp and seq."""
    key = F.concat(F.lit(prefix), "name").alias("key")
    return changes.select(key, F.col("content").cast("binary").alias("value"), (F.col("dir_id") + 1).alias("node"), (F.col("step") + 1).alias("seq"), F.col("step").alias("timestamp"), F.col("step").alias("arrival"))
