"""Threads that share a store or a replica, transports, and capacity against a plain fold."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions.versions import ENTRY
from tidemark.operators import admission, churn, consistency, delta, digest, merge
from tidemark.plans.sync import Config, IdentityError, Replica, push_to, round_with, talk_to_all
from tidemark.plans.transport import InProcess, Mailbox
from tidemark.sources.store import Store, StoreError

ARRIVAL = ENTRY + ", arrival long"


def entry(spark, key, seq):
    return spark.createDataFrame([(key, bytearray(b"v"), 1, seq, 5, seq)], ARRIVAL)


def together(*acts):
    problems = []

    def run(act):
        try:
            act()
        except Exception as e:
            problems.append(e)

    threads = [threading.Thread(target=run, args=(a,)) for a in acts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return problems


def test_two_threads_commit_one_row_once(spark, tmp_path):
    for k in range(4):
        s = Store(spark, f"file://{tmp_path}/s{k}", 1, sync_window_s=3600)
        s.append(entry(spark, "a", 1))
        assert together(s.sync, s.sync, s.sync) == []
        assert s.commits == 1 and s.load()[0].count() == 1


def test_appends_of_many_threads_all_arrive(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", 1)
    assert together(*[lambda i=i: s.append(entry(spark, f"k{i}", i)) for i in range(6)], lambda: s.persist(s.load()[0], force=True)) == []
    again = Store(spark, f"file://{tmp_path}/s", 1)
    assert again.last == 6 and {r["key"] for r in again.log().collect()} | {r["key"] for r in again.load()[0].collect()} == {f"k{i}" for i in range(6)}


def test_a_failed_commit_takes_nothing_along(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/s", 1)
    s.append(entry(spark, "a", 1))
    with monkeypatch.context() as m:
        m.setattr(s.folder, "rename", lambda *_: (_ for _ in ()).throw(OSError("no")))
        with pytest.raises(OSError):
            s.append(entry(spark, "b", 2))
    other = Store(spark, f"file://{tmp_path}/s", 1)  # opened before the first one goes on
    s.append(entry(spark, "c", 3))
    with pytest.raises(OSError):
        other.append(entry(spark, "d", 4))  # its place in the log is taken
    assert {r["key"] for r in Store(spark, f"file://{tmp_path}/s", 1).load()[0].collect()} == {"a", "c"}


def test_a_second_snapshot_is_refused(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", 1)
    s.append(entry(spark, "a", 1))
    s._snapshotting = True
    with pytest.raises(StoreError):
        s.persist(s.load()[0])


def test_writes_beside_the_state_are_the_state(spark):
    a, b = Replica(spark, 1, [2], Config(loose_rows=3)), Replica(spark, 2, [1], Config(loose_rows=1000))
    for k in "abcabd":
        a.put(k, k.encode(), 5)
    a.delete("a", 6)
    assert len(a._loose) <= 3 and {r["key"]: r["value"] and bytes(r["value"]) for r in a.state.collect()} == {"a": None, "b": b"b", "c": b"c", "d": b"d"}
    round_with(b, 1, InProcess([a]))
    assert b.digest() == a.digest() and b._loose


def test_watchers_conflate_and_close(spark):
    a, b = Replica(spark, 1, [2]), Replica(spark, 2, [1])
    one, some, gone = a.watch_key("x/1"), a.watch_prefix("x/"), a.watch_prefix("")
    gone.close()
    a.put("x/1", b"1", 5)
    a.put("x/1", b"2", 6)
    assert one.wait(0) and not one.wait(0) and some.wait(0) and not gone.wait(0) and gone not in a.watchers
    b.put("x/2", b"3", 7)
    round_with(a, 2, InProcess([b]))
    assert some.wait(0) and not one.pending()
    round_with(a, 2, InProcess([b]))
    assert not some.pending()  # nothing was set


def test_mailbox(spark, tmp_path):
    a, b = Replica(spark, 1, [2]), Replica(spark, 2, [1], known={7: b"x"})
    for i in range(5):
        b.put(f"k{i}", b"v", 5)
    box, stop = Mailbox(spark, f"file://{tmp_path}/box", wait_s=30), threading.Event()
    a.put("mine", b"w", 5)
    push_to(a, [2], box)
    assert box.serve(b) == 1 and b.state.count() == 6 and b.acks == {2: 5}

    def serve():
        while not stop.wait(0.02):
            box.serve(b)

    t = threading.Thread(target=serve)
    t.start()
    try:
        assert round_with(a, 2, box).merged == 5 and a.acks == {1: 1, 2: 5}
        entries, acks, whole = box.sync_v1(2, 1, a.state.limit(0), {2: 3})
        assert whole and acks[2] == 5 and sorted(r["key"] for r in entries.collect()) == ["k3", "k4", "mine"]
        a.node = 7
        with pytest.raises(RuntimeError, match=IdentityError.__name__):
            round_with(a, 2, box)
    finally:
        stop.set()
        t.join()
    quiet = Mailbox(spark, f"file://{tmp_path}/none", wait_s=0.1)
    assert talk_to_all(a, [2, 3], quiet) == {2: None, 3: None} and a.failures[2] == a.failures[3] == 1


def plain(held, rows, limits, rule):
    """One entry after the other, as a node without batches would do it."""
    size = {k: (z, v) for k, z, v in held}
    out = {}
    for key, value, node, seq, stamp, arrival in rows:
        z, v = len(key) + len(value or b""), (stamp, node, seq)
        why = "key exceeds max_key_bytes" if len(key) > limits.max_key_bytes else None
        if why is None and key not in size:
            total = sum(x for x, _ in size.values())
            why = "max_keys reached" if len(size) >= limits.max_keys else "max_total_bytes reached" if total >= limits.max_total_bytes else None
        why = why or rule(key, seq)
        if why is None and (key not in size or v > size[key][1]):
            size[key] = (z, v)
        out[arrival] = why
    return out


@pytest.mark.parametrize("seed", range(6))
def test_capacity_against_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    held = [(f"k{i}", b"x" * rng.randrange(1, 30), 1, i + 1, 3) for i in range(4)]
    rows = [(f"k{rng.randrange(25)}" + ("long" if rng.random() < 0.1 else ""), rng.choice([None, b"y" * rng.randrange(40)]), rng.randrange(1, 3), 100 + i, rng.randrange(8), i) for i in range(120)]
    state = spark.createDataFrame([(k, bytearray(v), n, s, t) for k, v, n, s, t in held], ENTRY)
    e = spark.createDataFrame([(k, None if v is None else bytearray(v), *r) for k, v, *r in rows], ARRIVAL).repartition(3)
    limits = [admission.Limits(max_key_bytes=5, max_keys=10), admission.Limits(max_key_bytes=5, max_total_bytes=200), admission.Limits(max_key_bytes=5, max_total_bytes=250, max_keys=12), admission.Limits(max_keys=3)][seed % 4]
    policy = [None, lambda: F.when(F.col("key").endswith("7") | (F.col("seq") % 5 == 0), "no")][seed % 2]
    got = {r["arrival"]: r["reason"] for r in admission.admit(state, e, limits, 1 << 40, policy).collect()}
    rule = (lambda k, s: "no" if k.endswith("7") or s % 5 == 0 else None) if policy else (lambda k, s: None)
    assert got == plain([(k, len(k) + len(v), (t, n, s)) for k, v, n, s, t in held], rows, limits, rule)


def test_what_the_policy_refuses_takes_no_place(spark):
    e = spark.createDataFrame([(k, bytearray(b"v"), 1, i + 1, 1, i) for i, k in enumerate(["no/1", "no/2", "yes/1", "yes/2", "no/3"])], ARRIVAL)
    rule = lambda: F.when(F.col("key").startswith("no/"), "denied")
    got = [r["reason"] for r in admission.admit(spark.createDataFrame([], ENTRY), e, admission.Limits(max_keys=1), 10, rule).orderBy("arrival").collect()]
    assert got == ["denied", "denied", None, "max_keys reached", "max_keys reached"]


def test_decided_and_pages_in_small_stretches(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(3)}", None, rng.randrange(1, 4), i + 1, rng.randrange(9), i) for i in range(200)]
    e, state = spark.createDataFrame(rows, ARRIVAL), spark.createDataFrame([("k0", None, 1, 500, 4)], ENTRY)
    best, want = {"k0": (4, 1, 500)}, []
    for k, _, n, s, t, i in rows:
        if k not in best or (t, n, s) > best[k]:
            best[k] = (t, n, s)
            want.append(i)
    for width in (1, 7, 1 << 16):
        assert sorted(r["arrival"] for r in merge.decided(state, e, width).collect()) == want
    for stretch in (1, 16, 1 << 16):
        got = delta.pages_by_count(e.drop("arrival"), {1: 50}, 9, stretch).orderBy("node", "seq").collect()
        assert [r["page"] for r in got] == [i // 9 for i in range(len(got))]


def test_digests_by_buckets(spark):
    rows = [(f"k{i}", bytearray(b"v"), 1, i + 1, 5) for i in range(50)]
    a, b = spark.createDataFrame(rows, ENTRY), spark.createDataFrame(rows[::-1], ENTRY).repartition(5)
    c = spark.createDataFrame(rows[:-1] + [("k49", bytearray(b"w"), 1, 50, 5)], ENTRY)
    one = lambda df, n: digest.combined_digest(df, n).first()[0]
    for n in (1, 7, 4096):
        assert one(a, n) == one(b, n) != one(c, n)
    assert one(a.limit(0), 7) == one(b.limit(0), 7)
    differ = digest.bucketed_digest(a, 16).exceptAll(digest.bucketed_digest(c, 16)).count()
    assert differ == 1


def test_random_changes_converge(spark):
    """Directories that change at random hold the same files after two rounds each way, in any order of arrival."""
    e = churn.as_entries(churn.churn(spark, 300, directories=3, files=20, seed=9))
    nodes = []
    for n in (1, 2, 3):
        own = merge.lww(e.filter(F.col("node") == n).drop("arrival").orderBy(F.xxhash64("seq", F.lit(n))))
        nodes.append(Replica.of(own, n, [m for m in (1, 2, 3) if m != n]))
    for _ in range(2):
        for a in nodes:
            talk_to_all(a, [b.node for b in nodes if b is not a], InProcess(nodes))
    assert len({a.digest() for a in nodes}) == 1 and nodes[0].digest() == digest.combined_digest(merge.lww(e.drop("arrival"))).first()[0]
    files = None
    for a in nodes:
        mine = a.state.filter("value is not null").select(F.lit(a.node).alias("dir_id"), F.col("key").alias("name"), F.col("value").alias("content"))
        files = mine if files is None else files.unionByName(mine)
    assert consistency.replica_consistency(files, 3).filter("not consistent").count() == 0
