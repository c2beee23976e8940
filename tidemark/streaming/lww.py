"""Last-writer-wins over a stream, watchers, and periodic rounds, on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import FIELDS


def lww_stream(entries: DataFrame) -> DataFrame:
    """The winning entry per key, updated as entries arrive in any order. Tombstones stay in the state."""
    best = F.max_by(F.struct(*FIELDS[1:]), F.struct("timestamp", "node", "seq"))
    return entries.groupBy("key").agg(best.alias("e")).select("key", *[F.col(f"e.{c}") for c in FIELDS[1:]])


def watch(entries: DataFrame, on_signal, key: str | None = None, prefix: str | None = None, trigger: dict | None = None):
    """A query that calls on_signal(batch) once for each micro-batch that touches the key or prefix."""
    hit = entries.filter(F.col("key") == key) if key is not None else entries.filter(F.col("key").startswith(prefix or ""))

    def fire(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            on_signal(n)

    return hit.writeStream.foreachBatch(fire).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of entries."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return raw.select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 20).cast("string")).alias("key"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"),
        (F.col("event_id") % 3 + 1).alias("node"),
        F.expr("event_id div 3 + 1").alias("seq"),
        (ms - ms % 864000000).alias("timestamp"),
    )


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream run to its end; equals the batch result."""
    name = "lww_" + uuid.uuid4().hex
    q = lww_stream(read_events(spark, f"{sf_dir}/events.parquet")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
