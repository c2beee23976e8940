"""The durable store: what survives damage, reopening and removal."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.versions import ENTRY
from tidemark.sources.store import Store, StoreError, as_ops, drop_noops, from_legacy_peers, legacy_peers, number, replay_acks, replay_next_seq

ARRIVAL = ENTRY + ", arrival long"


def entries(spark, *r):
    return spark.createDataFrame([(k, None if v is None else v.encode(), 1, s, 5, s) for k, v, s in r], ARRIVAL)


def held(state):
    return {r["key"]: None if r["value"] is None else bytes(r["value"]).decode() for r in state.collect()}


def test_numbers_are_gapless_in_order_of_arrival(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 7919 % 1009).alias("arrival")).repartition(7)
    got = [r["key"] for r in number(rows, 5).orderBy("wal_seq").collect()]
    assert got == sorted(range(1000), key=lambda i: i * 7919 % 1009)
    assert {r["wal_seq"] for r in number(rows, 5).collect()} == set(range(5, 1005))
    assert number(rows.limit(0), 5).count() == 0


def test_reopening_snapshots_and_owners(spark, tmp_path):
    url = f"file://{tmp_path}/s"
    with Store(spark, url, 1) as s:
        s.append(entries(spark, ("a", "1", 1), ("b", "2", 2), ("a", "3", 3)))
        assert s.commits == 1 and s.last == 3
        state, members, seq = s.load()
        assert held(state) == {"a": "3", "b": "2"} and members == [1] and seq == 4
        assert s.persist(state, [1, 2], seq) == 1 and s.persist(state, [1, 2], seq) is None
        s.append(entries(spark, ("c", None, 4)))
        s.append(spark.createDataFrame([("AddPeer", 7), ("RemovePeer", 2)], "op string, peer_id long"))
        s.append(spark.createDataFrame([("Clear", "b")], "op string, key string"))
        s.append(spark.createDataFrame([("IncrementSeq", 1)], "op string, ack_seq long"))  # not durable
    with pytest.raises(StoreError):
        s.append(entries(spark, ("z", "z", 9)))
    with pytest.raises(StoreError):
        Store(spark, url, 2)
    s = Store(spark, url, 1)
    state, members, seq = s.load()
    assert s.last == 7 and held(state) == {"a": "3", "c": None} and members == [1, 7] and seq == 5
    assert s.persist(state, members, seq, force=True) == 2
    assert s.log().count() == 4  # what the first generation lacks
    s.reset()
    assert s.load()[0].count() == 2 and Store(spark, url, 1).last == 7


def test_damaged_records_end_the_log(spark, tmp_path):
    url = f"file://{tmp_path}/s"
    s = Store(spark, url, 1)
    s.append(entries(spark, ("a", "1", 1), ("b", "2", 2), ("c", "3", 3)))
    s.append(entries(spark, ("d", "4", 4)))
    first = f"{url}/log/{1:020d}"
    rows = s.log().filter("wal_seq <= 3").withColumn("crc", F.when(F.col("wal_seq") == 2, 0).otherwise(F.col("crc"))).checkpoint()
    rows.write.mode("overwrite").parquet(first)
    s = Store(spark, url, 1)
    assert held(s.load()[0]) == {"a": "1"} and s.last == 1 and s.rewritten == 1
    s.append(entries(spark, ("e", "5", 5)))
    (tmp_path / "s" / "log" / f"{2:020d}" / "_SUCCESS").unlink()  # a torn commit
    assert held(Store(spark, url, 1).load()[0]) == {"a": "1"}
    s = Store(spark, url, 1)
    s.append(entries(spark, ("f", "6", 6)))
    for p in (tmp_path / "s" / "log" / f"{2:020d}").glob("part-*"):
        p.write_bytes(b"no parquet at all")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    s = Store(spark, url, 1)
    assert held(s.load()[0]) == {"a": "1"} and s.last == 1


def test_older_generation_stands_in(spark, tmp_path):
    url = f"file://{tmp_path}/s"
    s = Store(spark, url, 1)
    for i, key in enumerate("abc"):
        s.append(entries(spark, (key, "v", i + 1)))
        s.persist(s.load()[0])
    for p in (tmp_path / "s" / f"snapshot-{3:012d}").glob("part-*"):
        p.unlink()
    assert sorted(held(Store(spark, url, 1).load()[0])) == ["a", "b", "c"]
    (tmp_path / "s" / f"generation-{3:012d}.json").write_text("{")
    (tmp_path / "s" / f".generation-{3:012d}.json.crc").unlink(missing_ok=True)
    assert sorted(held(Store(spark, url, 1).load()[0])) == ["a", "b", "c"]


def test_sync_window_holds_appends(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", 1, sync_window_s=3600)
    for i in range(4):
        s.append(entries(spark, ("k", str(i), i + 1)))
    assert s.commits == 0 and s.has_unsynced() and not s.sync_if_due()
    s.sync()
    assert s.commits == 1 and held(s.load()[0]) == {"k": "3"}
    s.sync()
    assert s.commits == 1


def test_records_of_older_logs(spark):
    ops = as_ops(spark.createDataFrame([("UpdateLocalAck", 2, 9, None, None), ("RemovePeer", 2, None, None, None), ("PushPeerLog", 2, None, 2, 4), ("UpdateLocalAck", 3, 7, None, None), ("SetNextSeq", None, 20, None, None), ("Set", None, None, 1, 30), ("IncrementSeq", None, None, None, None)], "op string, peer_id long, ack_seq long, node long, seq long"))
    ops = number(ops, 1)
    assert {r["origin"]: r["ack"] for r in replay_acks(ops).collect()} == {2: 4, 3: 7}
    assert replay_next_seq(ops, 1).first()[0] == 32


def test_noops_and_legacy_peers(spark):
    state = entries(spark, ("a", "1", 1)).drop("arrival")
    ops = as_ops(spark.createDataFrame([("Clear", "a", None), ("Clear", "b", None), ("AddPeer", None, 1), ("AddPeer", None, 2), ("RemovePeer", None, 5)], "op string, key string, peer_id long"))
    assert sorted((r["op"], r["key"], r["peer_id"]) for r in drop_noops(ops, state, [1]).collect()) == [("AddPeer", None, 2), ("Clear", "a", None)]
    nodes = spark.createDataFrame([(1,), (2,)], "node_id long")
    acks = spark.createDataFrame([(1, 8), (9, 3)], "origin long, ack long")
    peer_acks = spark.createDataFrame([(2, 1, 6), (2, 2, 5)], "peer long, origin long, ack long")
    table = legacy_peers(nodes, acks, peer_acks, 1)
    assert sorted(map(tuple, table.collect())) == [(1, 8, 0), (2, 0, 6), (9, 3, 0)]
    m, a = from_legacy_peers(table, spark.createDataFrame([(9, 9, 11), (9, 1, 99)], "peer long, node long, seq long"))
    assert m.count() == 3 and {r["origin"]: r["ack"] for r in a.collect()} == {1: 8, 2: 0, 9: 11}
