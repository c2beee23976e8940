"""Coverage: per origin, up to which seq entries are known (a missing origin: 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adopt(acks: DataFrame, other: DataFrame) -> DataFrame:
    """Pointwise maximum; bumping one origin is adopting one row."""
    return acks.select("origin", "ack").unionByName(other.select("origin", "ack")).groupBy("origin").agg(F.max("ack").alias("ack"))


def reset(acks: DataFrame, origin: int | None = None) -> DataFrame:
    return acks.filter(F.lit(False)) if origin is None else acks.filter(F.col("origin") != origin)


def record_peer(peer_acks: DataFrame, peer: int, acks: DataFrame) -> DataFrame:
    """The peer's coverage is replaced, not raised."""
    return peer_acks.filter(F.col("peer") != peer).unionByName(acks.select(F.lit(peer).cast("long").alias("peer"), "origin", "ack"))


def forget_peer(peer_acks: DataFrame, peer: int) -> DataFrame:
    return peer_acks.filter(F.col("peer") != peer)


def ack_for(acks: DataFrame, origin: int) -> DataFrame:
    return acks.filter(F.col("origin") == origin).agg(F.coalesce(F.max("ack"), F.lit(0)).alias("ack"))


def recover_next_seq(state: DataFrame, acks: DataFrame, node: int, floor: int = 1) -> DataFrame:
    """One row: the next own seq that nothing has used; never below floor."""
    own = state.filter(F.col("node") == node).select(F.col("seq").alias("s")).unionByName(acks.filter(F.col("origin") == node).select(F.col("ack").alias("s")))
    return own.agg(F.greatest(F.lit(floor).cast("long"), F.coalesce(F.max("s"), F.lit(0)) + 1).alias("next_seq"))
