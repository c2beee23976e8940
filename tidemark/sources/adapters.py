"""Entries made of the events table, as fixtures for the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_to_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 20).cast("string")).alias("key"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"),
        (F.col("event_id") % 3 + 1).alias("node"),
        F.expr("event_id div 3 + 1").alias("seq"),
        (ms - ms % 864000000).alias("timestamp"),
        ((F.col("event_id") * 7919) % 1000003).alias("arrival"),
    )
