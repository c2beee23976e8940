"""Membership, tombstone collection, and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.versions import size_bytes
from .digest import state_digest


def members(spark, own: int, peers: list[int]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in dict.fromkeys([own, *peers])], "node_id long")


def peers_of(table: DataFrame, own: int) -> DataFrame:
    return table.filter(F.col("node_id") != own)


def add(table: DataFrame, peer: int) -> DataFrame:
    return table.union(table.sparkSession.createDataFrame([(peer,)], "node_id long")).distinct()


def remove(table: DataFrame, peer: int, own: int) -> DataFrame:
    return table if peer == own else table.filter(F.col("node_id") != peer)


def low_watermarks(peer_acks: DataFrame, peers: DataFrame) -> DataFrame:
    """(origin, low): what every peer has covered. An origin that any peer has not reported has no row."""
    seen = peer_acks.join(peers.select(F.col("node_id").alias("peer")), "peer")
    low = seen.groupBy("origin").agg(F.min("ack").alias("low"), F.count_distinct("peer").alias("_n"))
    total = peers.agg(F.count_distinct("node_id").alias("_all"))
    return low.crossJoin(F.broadcast(total)).filter("_n = _all").select("origin", "low")  # total is one row


def collectable(state: DataFrame, peer_acks: DataFrame, peers: DataFrame) -> DataFrame:
    """Tombstones that every peer has covered; all of them where there is no peer."""
    dead = state.filter(F.col("value").isNull())
    if peers.isEmpty():
        return dead
    low = low_watermarks(peer_acks, peers)
    return dead.join(low, (F.col("node") == F.col("origin")) & (F.col("seq") <= F.col("low")), "left_semi")


def collect(state: DataFrame, peer_acks: DataFrame, peers: DataFrame) -> DataFrame:
    """The state without what is collectable: one pass, with a row an origin beside it."""
    if peers.isEmpty():
        return state.filter(F.col("value").isNotNull())
    low = low_watermarks(peer_acks, peers)
    joined = state.join(low, F.col("node") == F.col("origin"), "left")
    return joined.filter(F.col("value").isNotNull() | F.col("low").isNull() | (F.col("seq") > F.col("low"))).drop("origin", "low")


def node_status(state: DataFrame) -> DataFrame:
    """One row: n_kvs (tombstones included), n_tombstones, storage_bytes."""
    return state.agg(F.count("*").alias("n_kvs"), F.count_if(F.col("value").isNull()).alias("n_tombstones"), F.coalesce(F.sum(size_bytes()), F.lit(0)).alias("storage_bytes"))


def peer_status(table: DataFrame, own: int, acks: DataFrame, peer_acks: DataFrame) -> DataFrame:
    """Every member by id: how far its writes are covered here, how far it said that it covers `own`'s, and
    whether it has ever said anything."""
    heard = peer_acks.groupBy("peer").agg(F.coalesce(F.max(F.when(F.col("origin") == own, F.col("ack"))), F.lit(0)).alias("peer_ack"))
    out = table.select(F.col("node_id").alias("id")).join(acks, F.col("id") == F.col("origin"), "left").join(heard, F.col("id") == F.col("peer"), "left")
    return out.select("id", F.coalesce("ack", F.lit(0)).alias("ack"), F.coalesce("peer_ack", F.lit(0)).alias("peer_ack"), F.col("peer").isNotNull().alias("heard_from"))


def node_report(state: DataFrame, own: int, table: DataFrame, acks: DataFrame, peer_acks: DataFrame, next_seq: int, dirty: bool, log: bool, merged: int, rejected: int) -> DataFrame:
    """One row: id, n_kvs (tombstones included), next_seq, dirty, log, digest, merged, rejected, and peers as an
    array in the order of their ids (as many as members)."""
    peers = peer_status(table, own, acks, peer_acks).agg(F.array_sort(F.collect_list(F.struct("id", "ack", "peer_ack", "heard_from"))).alias("peers"))
    counts = state.agg(F.count("*").alias("n_kvs")).crossJoin(state_digest(state)).crossJoin(peers)  # one row each
    fixed = {"id": own, "next_seq": next_seq, "merged": merged, "rejected": rejected}
    return counts.select(*[F.lit(v).cast("long").alias(k) for k, v in fixed.items()], F.lit(dirty).alias("dirty"), F.lit(log).alias("log"), "n_kvs", "digest", "peers")


def link_status(table: DataFrame, own: int, links: DataFrame) -> DataFrame:
    """Every known peer: protocol, mismatches, failures; defaults where no link is known."""
    joined = peers_of(table, own).join(links, F.col("node_id") == F.col("peer"), "left")
    return joined.select("node_id", F.coalesce("protocol", F.lit("v2")).alias("protocol"), F.coalesce("mismatches", F.lit(0)).cast("long").alias("mismatches"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures")).orderBy("node_id")
