"""Replicas over a store, and a directory that feeds one."""

import pytest

from tidemark.plans.durable import DurableReplica
from tidemark.plans.sync import LogError, Replica, sync_round
from tidemark.sources.directories import write_directory
from tidemark.sources.store import Store, StoreError
from tidemark.streaming.loops import watch_directory


def opened(spark, url, node=1, peers=(2,)):
    return DurableReplica(Store(spark, url, node), list(peers))


def held(r):
    return {x["key"]: None if x["value"] is None else bytes(x["value"]) for x in r.state.collect()}


def test_reopening_gives_everything_back(spark, tmp_path):
    url = f"file://{tmp_path}/s"
    a = opened(spark, url)
    a.put("k", b"1", 5)
    a.put("gone", b"2", 5)
    a.delete("gone", 6)
    a.add_peer(3)
    assert a.persist() == 1 and a.persist() is None
    a.remove_peer(2)
    a.put("k", b"3", 7)
    b = opened(spark, url, peers=(9,))
    assert held(b) == {"k": b"3", "gone": None} and b.digest() == a.digest()
    assert (b.members, b.next_seq, b.acks) == ([1, 3], 5, {1: 4})
    b.peer_acks = {3: {1: 4}}
    assert b.collect_garbage() == 1 and b.collect_garbage() == 0
    assert held(opened(spark, url)) == {"k": b"3"}


def test_a_merged_batch_is_one_commit(spark, tmp_path):
    a = opened(spark, f"file://{tmp_path}/s")
    other = Replica(spark, 2, [1])
    rows = spark.createDataFrame([(f"k{i}", bytearray(b"v")) for i in range(200)], "key string, value binary")
    assert other.put_all(rows, 5) == 200 and other.put_all(rows.limit(0), 5) == 0
    assert sync_round(a, other).merged == 200 and a.store.commits == 1 and a.acks == {2: 200}
    a.persist()
    again = opened(spark, f"file://{tmp_path}/s")
    assert again.acks == {2: 200} and again.digest() == other.digest()
    assert sync_round(again, other).merged == 0 and again.store.commits == 0


def test_what_is_not_logged_did_not_happen(spark, tmp_path, monkeypatch):
    url = f"file://{tmp_path}/s"
    a, other = opened(spark, url), Replica(spark, 2, [1])
    other.put("x", b"1", 5)

    def full(*_):
        raise StoreError("no room")

    with monkeypatch.context() as m:
        m.setattr(a.store, "sync", full)
        with pytest.raises(LogError):
            a.put("k", b"1", 5)
        out = sync_round(a, other)
        assert not out.complete and not out.acks_adopted and a.acks == {} and held(a) == {}
        with pytest.raises(LogError):
            a.add_peer(7)
        assert a.members == [1, 2] and not a.store.has_unsynced()
    assert a.put("k", b"1", 5)[3] == 2  # the first seq is not used again
    assert sync_round(a, other).complete and a.acks == {1: 2, 2: 1}
    assert held(opened(spark, url)) == {"k": b"1", "x": b"1"}


def test_directory_feeds_a_replica_without_echo(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a").write_bytes(b"1"), (d / "b").write_bytes(b"2")
    r = opened(spark, f"file://{tmp_path}/s")
    look = watch_directory(r, f"file://{d}")
    assert look() == 2 and look() == 0
    (d / "a").unlink(), (d / "b").write_bytes(b"3"), (d / "c").write_bytes(b"")
    assert look() == 3 and held(r) == {"__file/a": None, "__file/b": b"3", "__file/c": b""}
    other = Replica(spark, 2, [1])
    other.put("__file/new", b"n", 5)
    sync_round(r, other)
    assert write_directory(r.state, f"file://{d}") == 1 and look() == 0
    assert watch_directory(opened(spark, f"file://{tmp_path}/s"), f"file://{d}")() == 0
