"""Rules of the keyed state that plausible mistakes would break."""

import pytest

from tidemark.functions.versions import ENTRY
from tidemark.operators import admission, delta, digest, members, merge, reads
from tidemark.plans.sync import Config, IdentityError, Replica, bootstrap, push, sync_round, sync_to

ARRIVAL = ENTRY + ", arrival long"


def rows(spark, *r):
    return spark.createDataFrame([(k, None if v is None else v.encode(), n, s, t) for k, v, n, s, t in r], ENTRY)


def arriving(spark, *r):
    return spark.createDataFrame([(k, None if v is None else v.encode(), n, s, t, i) for i, (k, v, n, s, t) in enumerate(r)], ARRIVAL)


@pytest.mark.parametrize(("put", "gone", "live"), [(1, 2, 0), (2, 1, 1)])
def test_higher_node_wins_ties_whatever_it_says(spark, put, gone, live):
    s = merge.lww(rows(spark, ("k", "v", put, 1, 1234), ("k", None, gone, 1, 1234)))
    assert reads.live(s).count() == live


def test_equal_versions_keep_the_incumbent(spark):
    s = merge.merge(rows(spark, ("k", "old", 1, 1, 5)), arriving(spark, ("k", "new", 1, 1, 5)))
    assert bytes(s.first()["value"]) == b"old"


def test_prefixes_are_literal(spark):
    s = rows(spark, ("a_1", "x", 1, 1, 1), ("ab1", "x", 1, 2, 1), ("a%", None, 1, 3, 1))
    assert [r["key"] for r in reads.iterate(s, "a_")] == ["a_1"]
    assert reads.by_prefix(s, "").count() == 2
    assert reads.by_prefix(s, "", tombstones=True).count() == 3


def test_pages_join_to_the_delta(spark):
    s = rows(spark, *[(f"k{i}", "v" * 10, 1 + i % 3, 1 + i, 1) for i in range(20)])
    for budget in ({"max_entries": 3}, {"max_bytes": 120}, {"max_bytes": 1}):
        got = [(r["node"], r["seq"]) for p in delta.pages(s, {1: 4}, **budget) for r in p]
        assert got == sorted((r["node"], r["seq"]) for r in delta.delta(s, {1: 4}).collect())


def test_many_origins_join(spark):
    s = rows(spark, ("a", "v", 1, 1, 1), ("b", "v", 2, 3, 1))
    assert [r["key"] for r in delta.delta(s, {n: 2 for n in range(1, 100)}).collect()] == ["b"]


def test_digest(spark):
    base = rows(spark, ("a", "1", 1, 1, 1), ("b", None, 1, 2, 2))
    d = digest.state_digest(base).first()[0]
    assert d == digest.streamed_digest(base) == digest.state_digest(base.orderBy("value")).first()[0]
    for other in (rows(spark, ("a", "1", 1, 1, 1)), rows(spark, ("a", "1", 1, 1, 1), ("b", "", 1, 2, 2)), rows(spark, ("a", "1", 1, 1, 9), ("b", None, 1, 2, 2))):
        assert digest.state_digest(other).first()[0] != d
    assert digest.state_digest(rows(spark, ("ab", "", 1, 1, 1))).first()[0] != digest.state_digest(rows(spark, ("a", "b", 1, 1, 1))).first()[0]


@pytest.mark.parametrize(("acks", "n"), [([], 0), ([(2, 1, 0)], 0), ([(2, 1, 1)], 1)])
def test_tombstones_wait_for_every_peer(spark, acks, n):
    s, p = rows(spark, ("k", None, 1, 1, 1)), spark.createDataFrame([(2,)], "node_id long")
    assert members.collectable(s, spark.createDataFrame(acks, "peer long, origin long, ack long"), p).count() == n
    assert members.collectable(s, spark.createDataFrame([], "peer long, origin long, ack long"), p.limit(0)).count() == 1


def test_bounds_are_inclusive(spark):
    e = arriving(spark, ("abcd", "1234", 1, 1, 60_000), ("abcde", "1", 1, 2, 0), ("a", "12345", 1, 3, 0), ("b", "1", 1, 4, 60_001), ("c", "1", 1, 5, 0))
    limits = admission.Limits(max_key_bytes=4, max_value_bytes=4, max_drift_ms=60_000)
    got = {r["seq"]: r["reason"] for r in admission.admit(rows(spark), e, limits, 0).collect()}
    assert [s for s, why in got.items() if why] == [2, 3, 4]


def test_byte_capacity_sees_the_batch(spark):
    held = rows(spark, ("big", "x" * 1197, 1, 1, 1))
    e = arriving(spark, ("big", "y" * 7, 1, 2, 2), ("small", "z" * 5, 1, 3, 2))
    got = admission.admit(held, e, admission.Limits(max_total_bytes=1000), 10).collect()
    assert all(r["reason"] is None for r in got)


def test_refusal_blocks_adoption_and_pages_arrive(spark):
    a = Replica(spark, 1, [2], Config(max_entries=2, policy=None))
    b = Replica.of(rows(spark, *[(f"k{i}", "v", 2, i + 1, 5) for i in range(5)]), 2, [1], config=Config(max_entries=2))
    assert sync_round(a, b).merged == 5 and a.acks == {2: 5} and a.digest() == b.digest()
    c = Replica(spark, 3, [2], Config(limits=admission.Limits(max_key_bytes=1)))
    out = sync_round(c, b)
    assert out.rejected and not out.acks_adopted and c.acks == {}


def test_repair_after_three_quiet_mismatches(spark):
    a, b = Replica.of(rows(spark, ("a", "1", 1, 1, 1)), 1, [2]), Replica.of(rows(spark, ("b", "1", 2, 1, 1)), 2, [1])
    for r, p in ((a, 2), (b, 1)):
        r.acks, r.peer_acks = {1: 9, 2: 9}, {p: {1: 9, 2: 9}}
    counts = []
    for _ in range(3):
        sync_round(a, b)
        counts.append(a.mismatches[2])
    assert counts == [1, 2, 0] and 2 in a.reset_next
    sync_round(a, b)
    assert a.state.count() == 2


def test_push_old_protocol_bootstrap_identity(spark):
    a, b = Replica(spark, 1, [2]), Replica(spark, 2, [1], known={1: b"someone else"})
    a.put("k", b"v", 5)
    with pytest.raises(IdentityError):
        sync_round(a, b)
    b.known = None
    push(a, [b])
    assert b.state.count() == 1 and b.acks == {}
    assert sync_to(b, a, speaks_v2=False, now=0).acks_adopted and 1 in b.legacy
    c = Replica(spark, 1, [2])
    bootstrap(c, [b])
    assert c.next_seq == 2


def test_force_put_goes_above_what_is_there(spark):
    a = Replica(spark, 1, [])
    a.put("k", b"v", 1000)
    assert a.force_put("k", b"w", 5)[4] == 1001
    assert a.delete("k", 7)["timestamp"] == 1001 and a.delete("none", 7) is None
