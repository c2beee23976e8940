"""Rounds of many pages: few passes over the states, one pinned state a round, and nothing left out."""

import pytest

from tidemark import queries as registered
from tidemark.functions.versions import ENTRY
from tidemark.operators import merge
from tidemark.plans import codec, sync
from tidemark.plans.sync import Config, Replica, round_with, sync_round
from tidemark.plans.transport import InProcess

SF = "/root/testdata/sf0.001"


def sides(spark, n=40, **config):
    b = Replica.of(spark.createDataFrame([(f"k{i:03}", bytearray(b"v" * (i % 7)), 2, i + 1, 5) for i in range(n)], ENTRY), 2, [1], config=Config(**config))
    return Replica(spark, 1, [2], Config(**config)), b


class Failing(InProcess):
    """The answer to the n-th message does not come; `before` is called ahead of each."""

    def __init__(self, replicas, at=None, before=lambda n: None):
        super().__init__(replicas)
        self.at, self.before, self.n = at, before, 0

    def sync(self, peer, message, resume=None):
        self.before(self.n)
        self.n += 1
        if self.n == self.at:
            raise TimeoutError
        return super().sync(peer, message, resume)


@pytest.mark.parametrize("budget", [{"max_entries": 3}, {"max_bytes": 100}, {"max_bytes": 1}])
def test_many_pages_cost_what_few_cost(spark, monkeypatch, budget):
    calls = {"merge": 0, "digest": 0, "page": 0}

    def counted(name, f):
        def inner(*args, **more):
            calls[name] += 1
            return f(*args, **more)

        return inner

    a, b = sides(spark, **budget)
    monkeypatch.setattr(merge, "decided", counted("merge", merge.decided))
    monkeypatch.setattr(sync.digest, "combined_digest", counted("digest", sync.digest.combined_digest))
    monkeypatch.setattr(sync.delta, "page", counted("page", sync.delta.page))
    out = sync_round(a, b)
    assert (out.merged, out.complete, out.acks_adopted, out.digest_match, a.acks) == (40, True, True, True, {2: 40})
    assert calls == {"merge": 1, "digest": 2, "page": 2}
    assert a.digest() == b.digest()


def test_pages_keep_the_budgets(spark):
    for budget in ({"max_entries": 3}, {"max_bytes": 100}, {"max_bytes": 1}, {"max_entries": 2, "max_bytes": 75}):
        a, b = sides(spark, **budget)
        want = [[(r["node"], r["seq"]) for r in p] for p in sync.delta.pages(b.state, {}, budget.get("max_entries", 4096), budget.get("max_bytes", 4 << 20))]
        got, cursor, first = [], None, True
        while first or cursor is not None:
            e = b.handle(sync.Envelope(1, b"", {}, sync.Page(spark, []), cursor=None if first else (0, 0)), cursor)
            got.append([(r[2], r[3]) for r in e.rows()])
            cursor, first = e.cursor, False
        assert got == want


def test_pages_are_of_one_state(spark):
    """A write between two pages is of the next round, and so is what the peer covers by it."""
    a, b = sides(spark, max_entries=9)
    out = round_with(a, 2, Failing([b], before=lambda n: b.put(f"k{n:03}", b"late", 6) if n else None))
    assert out.merged == 40 and a.acks == {2: 40} and b.acks == {2: 44}
    assert {bytes(r["value"]) for r in a.state.filter("key in ('k001', 'k002')").collect()} == {b"v", b"vv"}
    assert sync_round(a, b).merged == 4 and a.digest() == b.digest()


def test_pages_before_a_failure_land(spark):
    a, b = sides(spark, max_entries=9)
    with pytest.raises(TimeoutError):
        round_with(a, 2, Failing([b], at=4))
    assert a.state.count() == 27 and a.acks == {}
    assert sync_round(a, b).merged == 13 and a.acks == {2: 40}


def test_a_page_that_is_asked_for_again(spark):
    _, b = sides(spark, max_entries=9)
    ask = lambda resume: [r[3] for r in b.handle(sync.Envelope(1, b"", {}, sync.Page(spark, []), cursor=(0, 0)), resume).rows()]
    assert ask(None) == list(range(1, 10)) and ask((2, 9)) == ask((2, 9)) == list(range(10, 19)) and ask((2, 36)) == list(range(37, 41))


def test_gathered_pages_are_pinned_beyond_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(sync, "STRETCH_ROWS", 10)
    a, b = sides(spark, max_entries=4)
    assert sync_round(a, b).merged == 40 and a.digest() == b.digest()


def test_a_page_as_bytes_asks_nothing_of_spark(spark, monkeypatch):
    e = sync.Envelope(1, b"", {}, sync.Page(spark, [("a", None, 1, 1, 1), ("b", bytearray(b"x"), 1, 2, 1)]))
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert codec.decode(spark, codec.encode(e)).rows() == e.rows()


@pytest.mark.parametrize("name", ["push_merged", "older_round", "bootstrapped", "sync_applied_answer", "sync_served_answer", "fan_out", "mailbox_round"])
def test_nothing_is_refused_where_the_sql_refuses_nothing(spark, monkeypatch, name):
    """The capacity of these nodes is no part of the queries, however many keys there are."""
    seen = []
    merged = Replica.merge_batch
    monkeypatch.setattr(Replica, "merge_batch", lambda self, *args, **more: (seen.append(self.config.limits), merged(self, *args, **more))[1])
    registered.queries()[name](spark, SF).collect()
    assert seen and all(x.max_keys == x.max_total_bytes == 1 << 60 for x in seen)


@pytest.mark.parametrize("name", ["sync_applied_answer", "sync_served_answer"])
def test_messages_of_whole_states_have_no_budget(spark, monkeypatch, name):
    seen, asked = [], Replica.prepare_sync
    monkeypatch.setattr(Replica, "prepare_sync", lambda self, peer: (seen.append((self.config.max_entries, self.config.max_bytes)), asked(self, peer))[1])
    registered.queries()[name](spark, SF).collect()
    assert seen == [(None, None)]


def test_a_page_without_a_budget_is_all(spark):
    a, b = sides(spark, max_entries=None, max_bytes=None)
    e = b.handle(a.prepare_sync(2))
    assert e.page is None and e.cursor is None and e.entries.count() == 40
    a, b = sides(spark, max_entries=None, max_bytes=1 << 20)
    assert len(b.handle(a.prepare_sync(2)).rows()) == 40 and sync_round(a, b).merged == 40


def test_loops_wait_for_long_rounds(spark, monkeypatch):
    """Rounds may take longer than any fixed time: only the clock of the query is moved here."""
    import time

    real, began = time.monotonic, []
    monkeypatch.setattr(time, "monotonic", lambda: real() + 1000 * len(began.append(0) or began))
    assert [tuple(r) for r in registered.queries()["loops_converge"](spark, SF).collect()] == [(registered.state(spark, SF).count(), True)]
