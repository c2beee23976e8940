"""What a peer has not covered, whole or by pages.

acks are a map from origin to covered seq with one entry a node of the cluster. They become literal
predicates on (node, seq), which reach Parquet; beyond MOST origins they are joined instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import weight

MOST = 64


def delta(state: DataFrame, acks: dict[int, int]) -> DataFrame:
    """Entries with seq above their origin's ack (0 where there is none), tombstones included."""
    if len(acks) > MOST:
        table = state.sparkSession.createDataFrame(list(acks.items()), "_o long, _a long")
        joined = state.join(table, F.col("node") == F.col("_o"), "left")
        return joined.filter(F.col("seq") > F.coalesce("_a", F.lit(0))).drop("_o", "_a")
    known = [(F.col("node") == n) & (F.col("seq") > max(a, 0)) for n, a in sorted(acks.items())]
    other = (F.col("seq") > 0) & ~F.col("node").isin(list(acks)) if acks else F.col("seq") > 0
    return state.filter(reduce(lambda x, y: x | y, [*known, other]))


def after(entries: DataFrame, cursor: tuple[int, int] | None) -> DataFrame:
    """Entries behind the cursor (the last row that was sent), in (node, seq) order."""
    if cursor is None:
        return entries
    n, s = cursor
    return entries.filter((F.col("node") > n) | ((F.col("node") == n) & (F.col("seq") > s)))


def page(state: DataFrame, acks: dict[int, int], cursor: tuple[int, int] | None = None, max_entries: int = 4096, max_bytes: int = 4 << 20) -> DataFrame:
    """One page: the first entries under both budgets, and at least one. Column `more` tells whether
    anything uncovered remains behind it."""
    top = after(delta(state, acks), cursor).orderBy("node", "seq").limit(max_entries + 1)
    w = W.orderBy("node", "seq")  # at most max_entries + 1 rows
    ranked = top.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(weight()).over(w)).withColumn("_all", F.count("*").over(W.partitionBy()))
    kept = ranked.filter((F.col("_n") == 1) | ((F.col("_n") <= max_entries) & (F.col("_b") <= max_bytes)))
    return kept.withColumn("more", F.col("_all") > F.count("*").over(W.partitionBy())).drop("_n", "_b", "_all")


def pages_by_count(state: DataFrame, acks: dict[int, int], max_entries: int, stretch: int = 1 << 16) -> DataFrame:
    """All pages at once under the entry budget: column page from 0. Rows are ranked inside stretches of an
    origin's seqs, and the counts of the stretches before add to that, so no task sees a whole origin."""
    d = delta(state, acks).withColumn("_s", F.floor(F.col("seq") / stretch))
    sizes = d.groupBy("node", "_s").agg(F.count("*").alias("_c"))
    origins = sizes.groupBy("node").agg(F.sum("_c").alias("_n")).withColumn("_o", F.sum("_n").over(W.orderBy("node")) - F.col("_n")).drop("_n")  # a row an origin
    before = sizes.withColumn("_b", F.sum("_c").over(W.partitionBy("node").orderBy("_s")) - F.col("_c")).join(origins, "node").select("node", "_s", (F.col("_b") + F.col("_o")).alias("_before"))
    ranked = d.withColumn("_r", F.row_number().over(W.partitionBy("node", "_s").orderBy("seq"))).join(before, ["node", "_s"])
    return ranked.select(*state.columns, F.expr(f"(_before + _r - 1) div {int(max_entries)}").alias("page"))


def pages(state: DataFrame, acks: dict[int, int], max_entries: int = 4096, max_bytes: int = 4 << 20):
    """Pages one after another under both budgets, each a list of at most max_entries rows."""
    cursor = None
    while True:
        rows = page(state, acks, cursor, max_entries, max_bytes).orderBy("node", "seq").collect()
        if not rows:
            return
        yield rows
        if not rows[0]["more"]:
            return
        cursor = (rows[-1]["node"], rows[-1]["seq"])


def origin_index(state: DataFrame) -> DataFrame:
    return state.select("node", "seq", "key")


def seq_conflicts(entries: DataFrame) -> DataFrame:
    """(node, seq) pairs that more than one entry claims."""
    return entries.groupBy("node", "seq").agg(F.count("*").alias("n")).filter("n > 1")


def max_own_seq(state: DataFrame, node: int) -> DataFrame:
    return state.filter(F.col("node") == node).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))
