"""Directories, the envelope codec, and running loops."""

import time

import pytest

from tidemark.functions.versions import ENTRY
from tidemark.operators import merge
from tidemark.plans import codec
from tidemark.plans.sync import Config, Envelope, Replica, sync_round
from tidemark.sources.directories import as_entries, changes, peer_address, read_directory, write_directory
from tidemark.sources.store import Store
from tidemark.streaming.loops import start_commits, start_pushes, start_rounds


def listing(df):
    return {r["name"]: bytes(r["content"]) for r in df.collect()}


def test_directory_to_state_and_back(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir(), (a / "sub").mkdir()
    (a / "x.txt").write_bytes(b"x"), (a / ".dot").write_bytes(b"."), (a / "_under").write_bytes(b""), (a / "b c%20").write_bytes(b"\xff"), (a / "sub" / "no").write_bytes(b"n")
    (b / "own").write_bytes(b"mine"), (b / "x.txt").write_bytes(b"old")
    one = read_directory(spark, f"file://{a}").checkpoint()
    assert listing(one) == {"x.txt": b"x", ".dot": b".", "_under": b"", "b c%20": b"\xff"}
    state = as_entries(one, 1, 1, 5)
    assert [r["seq"] for r in state.orderBy("key").collect()] == [1, 2, 3, 4]
    assert write_directory(state, f"file://{b}") == 4
    assert listing(read_directory(spark, f"file://{b}")) == listing(one) | {"own": b"mine"}
    assert write_directory(state, f"file://{b}") == 0
    (a / "x.txt").unlink(), (a / ".dot").write_bytes(b"new")
    diff = {r["key"]: r["change"] for r in changes(one, read_directory(spark, f"file://{a}")).collect()}
    assert diff == {"__file/x.txt": "delete", "__file/.dot": "put"}
    gone = merge.merge(state, spark.createDataFrame([("__file/x.txt", None, 1, 9, 9), ("__file/never", None, 1, 10, 9)], ENTRY))
    assert write_directory(gone, f"file://{b}") == 1 and not (b / "x.txt").exists()
    empty = tmp_path / "e"
    empty.mkdir()
    assert read_directory(spark, f"file://{empty}").count() == 0
    with pytest.raises(ValueError):
        write_directory(spark.createDataFrame([("__file/../up", bytearray(b"x"), 1, 1, 1)], ENTRY), f"file://{b}")
    assert peer_address(spark.createDataFrame([("__peer_addr/2", bytearray(b"host:1"), 1, 1, 1)], ENTRY), 2).first()[0] == "host:1"


def test_codec(spark):
    rows = spark.createDataFrame([("k", bytearray(b"\xff\x00"), 1, 2, 3), ("é", None, 1, 3, 4)], ENTRY)
    e = Envelope(7, b"id", {1: 5}, rows, "ab", (1, 3), True)
    got = codec.decode(spark, codec.encode(e))
    assert (got.sender, got.uuid, got.acks, got.digest, got.cursor, got.reset_acks, got.push_only) == (7, b"id", {1: 5}, "ab", (1, 3), True, False)
    assert sorted(map(str, got.entries.collect())) == sorted(map(str, rows.collect()))
    least = b'{"version": 1, "sender_id": 1, "sender_uuid": "", "acks": {}, "entries": [], "later": 1}'
    assert codec.decode(spark, least).adoptable
    for bad in (least + b"x", least.replace(b": 1,", b": 2,", 1), least[:-1], b"[]", b'{"version": 1}', b""):
        with pytest.raises(codec.CodecError):
            codec.decode(spark, bad)


def until(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)
    return done()


def test_loops(spark, tmp_path):
    a, b = Replica(spark, 1, [2], Config(interval_s=0.5, coalesce_s=0.2)), Replica(spark, 2, [1], Config(interval_s=0.5))
    a.put("k", b"v", 5)
    pushes = start_pushes(a, [b])
    assert until(lambda: b.state.count() == 1)
    pushes.stop()
    assert b.acks == {}
    rounds = start_rounds(b, [a])
    assert until(lambda: b.acks == {1: 1})
    rounds.stop()
    assert sync_round(a, b).merged == 0
    s = Store(spark, f"file://{tmp_path}/s", 1, sync_window_s=0.3)
    q = start_commits(s)
    s.append(a.state)
    assert until(lambda: s.commits == 1)
    q.stop()
    assert s.load()[0].count() == 1
