"""The fold of capacity reads sorted stretches, and its one task sorts nothing itself."""

import random

import pytest

from tidemark.functions.versions import ENTRY
from tidemark.operators import admission


def folded(spark, n=200):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(40)}", bytearray(b"y" * rng.randrange(9)), 1, i + 1, rng.randrange(8), i) for i in range(n)]
    e = spark.createDataFrame(rows, ENTRY + ", arrival long").repartition(3)
    return rows, admission.admit(spark.createDataFrame([], ENTRY), e, admission.Limits(max_total_bytes=60), 1 << 40)


@pytest.mark.parametrize("stretch", [1, 7, 1 << 17])
def test_stretches_give_what_a_plain_fold_gives(spark, monkeypatch, stretch):
    monkeypatch.setattr(admission, "STRETCH", stretch)
    rows, out = folded(spark)
    held, want = {}, {}
    for key, value, node, seq, stamp, arrival in rows:
        full = key not in held and sum(z for z, _ in held.values()) >= 60
        want[arrival] = "max_total_bytes reached" if full else None
        if not full and (key not in held or (stamp, node, seq) > held[key][1]):
            held[key] = (len(key) + len(value), (stamp, node, seq))
    assert {r["arrival"]: r["reason"] for r in out.collect()} == want and set(want.values()) == {None, "max_total_bytes reached"}


def test_the_folding_task_sorts_nothing(spark):
    plan = folded(spark)[1]._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Sort [arrival" not in plan


def test_partitions_wait_for_their_turn():
    ahead = lambda *parts: list(admission.in_order((p, f"{p}{x}") for p in parts for x in "ab"))
    assert ahead(3, 0, 1, 4) == ["0a", "0b", "1a", "1b", "3a", "3b", "4a", "4b"]
    assert ahead(0, 1, 5) == ["0a", "0b", "1a", "1b", "5a", "5b"] and ahead(2) == ["2a", "2b"] and ahead(2, 5) == ["2a", "2b", "5a", "5b"]
    with pytest.raises(RuntimeError):
        ahead(0, 5, 3)
