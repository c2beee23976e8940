"""Running queries around a replica: periodic rounds with all peers, coalesced pushes, timed log commits.

Each is a Structured Streaming query on a clock; its trigger interval is the period, and what
happens inside one interval is handled together. stop() of the query ends it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.durable import DurableReplica
from ..plans.sync import Replica, push, sync_all
from ..sources.directories import LISTING, news, read_directory


def every(spark: SparkSession, seconds: float, act) -> StreamingQuery:
    """Call act() on the driver once in each interval. A batch that takes longer delays the next; none pile up."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()

    def fire(batch: DataFrame, n: int) -> None:
        act()

    return clock.writeStream.foreachBatch(fire).trigger(processingTime=f"{max(1, round(seconds * 1000))} milliseconds").start()


def start_rounds(a: Replica, peers: list[Replica]) -> StreamingQuery:
    """Rounds of the configured interval; a peer's failure is counted and stops nothing."""
    return every(a.spark, a.config.interval_s, lambda: sync_all(a, peers))


def start_pushes(a: Replica, peers: list[Replica]) -> StreamingQuery:
    """Writes of one coalescing window go out together, each key once; an idle window sends nothing."""
    return every(a.spark, a.config.coalesce_s, lambda: push(a, peers))


def watch_directory(a: Replica, url: str):
    """A function that puts what changed in a directory since its last call: new and other files, and
    deletes of those that went. At the first call all files count as new, none as gone."""
    before = a.spark.createDataFrame([], LISTING)

    def look() -> int:
        nonlocal before
        now = read_directory(a.spark, url).checkpoint()
        n = a.put_all(news(a.state, before, now))
        before = now  # only once the changes are in
        return n

    return look


def start_directory(a: Replica, url: str, seconds: float = 1.0) -> StreamingQuery:
    """Follow a directory: each interval its changes become local writes."""
    return every(a.spark, seconds, watch_directory(a, url))


def start_snapshots(a: DurableReplica, seconds: float = 10.0) -> StreamingQuery:
    """A new generation once in each interval in which something changed."""
    return every(a.spark, seconds, a.persist)


def start_commits(store) -> StreamingQuery:
    """Commits held appends of a store once in its sync window."""
    return every(store.spark, max(store.window, 0.05), store.sync_if_due)
