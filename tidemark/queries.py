"""Registered queries on keyed state, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.versions import FIELDS, forced, size_bytes
from .operators import admission, churn, consistency, coverage, delta, digest, members, merge, reads
from .sources.adapters import events_to_entries

ACKS = {1: 2000, 2: 3000}
PEER_ACKS = [(2, 1, 3000), (2, 2, 2500), (2, 3, 900), (3, 1, 1500), (3, 2, 3333)]
CURSOR = (1, 2500)
LIMITS = admission.Limits(max_key_bytes=9, max_value_bytes=6, max_drift_ms=60_000)
NOW = 1_705_000_000_000
UNLIMITED = admission.Limits(max_keys=1 << 60, max_total_bytes=1 << 60, max_drift_ms=1 << 60)  # nothing is refused
_QUERIES, _SQL = {}, {}

_E = """e AS (SELECT 'user/' || user_id::varchar || '/' || (event_id % 20)::varchar AS key,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value, (event_id % 3 + 1)::bigint AS node,
  (event_id // 3 + 1)::bigint AS seq, epoch_ms(ts) - epoch_ms(ts) % 864000000 AS timestamp,
  ((event_id * 7919) % 1000003)::bigint AS arrival FROM events),
s AS (SELECT key, value, node, seq, timestamp FROM e
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, node DESC, seq DESC) = 1)"""


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = "WITH " + _E + ", " * sql.lstrip().startswith("#") + " " + sql.lstrip().lstrip("#")
        return f

    return add


def entries(spark, d) -> DataFrame:
    return events_to_entries(spark, d)


def state(spark, d) -> DataFrame:
    return merge.lww(entries(spark, d).drop("arrival"))


def acks_table(spark, acks=None) -> DataFrame:
    return spark.createDataFrame(list((acks or ACKS).items()), "origin long, ack long")


@query("SELECT * FROM s")
def lww_state(spark, d):
    return state(spark, d)


@query("SELECT * FROM s WHERE value IS NOT NULL")
def lww_live_state(spark, d):
    return reads.live(state(spark, d))


@query("SELECT * FROM s WHERE key = 'user/1/4' AND value IS NOT NULL")
def point_get(spark, d):
    return reads.get(state(spark, d), "user/1/4")


@query("SELECT * FROM s WHERE key = (SELECT min(key) FROM s WHERE value IS NULL)")
def point_get_tombstone(spark, d):
    key = reads.tombstones(state(spark, d)).agg(F.min("key").alias("key")).first()["key"]
    return reads.get(state(spark, d), key or "", tombstones=True)


@query("SELECT * FROM s WHERE starts_with(key, 'user/1') AND value IS NOT NULL")
def prefix_scan(spark, d):
    return reads.by_prefix(state(spark, d), "user/1")


@query("SELECT *, row_number() OVER (ORDER BY key) AS rank FROM s WHERE starts_with(key, 'user/12') AND value IS NOT NULL")
def prefix_iterate(spark, d):
    return reads.ranked(state(spark, d), "user/12")


@query("SELECT key, value, node, seq, timestamp, value IS NULL AS is_tombstone FROM s")
def full_scan(spark, d):
    return state(spark, d).withColumn("is_tombstone", F.col("value").isNull())


@query("SELECT * FROM s WHERE value IS NULL")
def tombstones(spark, d):
    return reads.tombstones(state(spark, d))


_DELTA = "SELECT * FROM s WHERE seq > CASE node WHEN 1 THEN 2000 WHEN 2 THEN 3000 ELSE 0 END"


@query(_DELTA)
def delta_since_acks(spark, d):
    return delta.delta(state(spark, d), ACKS)


@query("SELECT * FROM s WHERE seq > 0")
def bootstrap_delta(spark, d):
    return delta.delta(state(spark, d), {})


def _page_sql(after: str, entries_: int, bytes_: int) -> str:
    return f"""# d AS ({_DELTA}), r AS (SELECT *, row_number() OVER w AS n, sum(strlen(key) + coalesce(strlen(value), 0) + 32) OVER w AS b,
  count(*) OVER () AS total FROM d WHERE {after} WINDOW w AS (ORDER BY node, seq)),
k AS (SELECT * FROM r WHERE n = 1 OR (n <= {entries_} AND b <= {bytes_}))
SELECT key, value, node, seq, timestamp, total > count(*) OVER () AS more FROM k"""


@query(_page_sql("true", 64, 1 << 22))
def delta_page_first(spark, d):
    return delta.page(state(spark, d), ACKS, None, 64)


@query(_page_sql("node > 1 OR (node = 1 AND seq > 2500)", 64, 1 << 22))
def delta_page_resume(spark, d):
    return delta.page(state(spark, d), ACKS, CURSOR, 64)


@query(_page_sql("node > 1 OR (node = 1 AND seq > 2500)", 64, 2000))
def delta_page_byte_budget(spark, d):
    return delta.page(state(spark, d), ACKS, CURSOR, 64, 2000)


@query(f"# d AS ({_DELTA}) SELECT *, (row_number() OVER (ORDER BY node, seq) - 1) // 100 AS page FROM d")
def delta_pages_by_count(spark, d):
    return delta.pages_by_count(state(spark, d), ACKS, 100)


@query("SELECT node, seq, key FROM s")
def origin_index(spark, d):
    return delta.origin_index(state(spark, d))


@query("SELECT node, seq, count(*) AS n FROM (SELECT node % 2 AS node, seq FROM e) GROUP BY ALL HAVING count(*) > 1")
def origin_seq_conflicts(spark, d):
    return delta.seq_conflicts(entries(spark, d).withColumn("node", F.col("node") % 2))


@query("SELECT coalesce(max(seq), 0) AS max_seq FROM s WHERE node = 2")
def max_own_seq(spark, d):
    return delta.max_own_seq(state(spark, d), 2)


@query("SELECT greatest(1, coalesce((SELECT max(seq) FROM s WHERE node = 1), 0) + 1, 2001) AS next_seq")
def recover_next_seq(spark, d):
    return coverage.recover_next_seq(state(spark, d), acks_table(spark), 1)


_SEEN = "SELECT node AS origin, max(seq) AS ack FROM s GROUP BY node"


@query(f"SELECT origin, max(ack) AS ack FROM ({_SEEN} UNION ALL SELECT * FROM (VALUES (1, 2000), (2, 3000))) GROUP BY origin")
def ack_adopt(spark, d):
    seen = state(spark, d).groupBy(F.col("node").alias("origin")).agg(F.max("seq").alias("ack"))
    return coverage.adopt(acks_table(spark), seen)


@query(f"SELECT * FROM ({_SEEN}) WHERE origin <> 2")
def ack_reset(spark, d):
    return coverage.reset(state(spark, d).groupBy(F.col("node").alias("origin")).agg(F.max("seq").alias("ack")), 2)


@query("SELECT 3::bigint AS peer, node AS origin, max(seq) AS ack FROM s GROUP BY node UNION ALL SELECT * FROM (VALUES (2, 1, 3000), (2, 2, 2500), (2, 3, 900))")
def peer_acks_record(spark, d):
    seen = state(spark, d).groupBy(F.col("node").alias("origin")).agg(F.max("seq").alias("ack"))
    return coverage.record_peer(_peer_acks(spark), 3, seen)


def _peer_acks(spark):
    return spark.createDataFrame(PEER_ACKS, "peer long, origin long, ack long")


def _peers(spark):
    return members.peers_of(members.members(spark, 1, [2, 3]), 1)


_LOW = "p AS (SELECT * FROM (VALUES (2, 1, 3000), (2, 2, 2500), (2, 3, 900), (3, 1, 1500), (3, 2, 3333)) t(peer, origin, ack)), low AS (SELECT origin, min(ack) AS low FROM p GROUP BY origin HAVING count(DISTINCT peer) = 2)"


@query(f"# {_LOW} SELECT origin::bigint AS origin, low::bigint AS low FROM low")
def gc_watermark(spark, d):
    return members.low_watermarks(_peer_acks(spark), _peers(spark))


@query(f"# {_LOW} SELECT s.* FROM s JOIN low ON node = origin AND seq <= low WHERE value IS NULL")
def gc_collectable(spark, d):
    return members.collectable(state(spark, d), _peer_acks(spark), _peers(spark))


@query(f"# {_LOW} SELECT s.* FROM s LEFT JOIN low ON node = origin WHERE value IS NOT NULL OR low IS NULL OR seq > low")
def gc_state_after(spark, d):
    return members.collect(state(spark, d), _peer_acks(spark), _peers(spark))


def _halves(spark, d):
    e = entries(spark, d).drop("arrival")
    half = F.col("seq") % 2 == 0
    return merge.lww(e.filter(half)), merge.lww(e.filter(~half))


@query("SELECT * FROM s")
def merge_two_replicas(spark, d):
    a, b = _halves(spark, d)
    return merge.merge(a, b)


@query("# r AS (SELECT *, max({'t': timestamp, 'n': node, 's': seq}) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e) SELECT count(*) AS merged FROM r WHERE b IS NULL OR {'t': timestamp, 'n': node, 's': seq} > b")
def merge_outcome_counts(spark, d):
    empty = spark.createDataFrame([], "key string, value string, node long, seq long, timestamp long")
    return merge.decided(empty, entries(spark, d)).agg(F.count("*").alias("merged"))


@query("""# a AS (SELECT * FROM e WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, node DESC, seq DESC) = 1),
b AS (SELECT * FROM e WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, node DESC, seq DESC) = 1)
SELECT count(*) FILTER (a.key IS NULL) AS new_keys, sum(strlen(b.key) + coalesce(strlen(b.value), 0) - coalesce(strlen(a.key) + coalesce(strlen(a.value), 0), 0))::bigint AS bytes_delta
FROM b LEFT JOIN a USING (key) WHERE a.key IS NULL OR (b.timestamp, b.node, b.seq) > (a.timestamp, a.node, a.seq)""")
def merge_batch_new_keys_bytes(spark, d):
    e = entries(spark, d)
    return merge.net_effect(merge.lww(e.filter("seq % 2 = 0").drop("arrival")), e.filter("seq % 2 = 1"))


@query("SELECT key, value, node, seq, timestamp FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC) = 1")
def put_last_arrival(spark, d):
    return merge.last_arrival(entries(spark, d))


def _ops(spark, d):
    e = entries(spark, d).withColumnRenamed("arrival", "wal_seq")
    return e.withColumn("op", F.when(F.col("wal_seq") % 7 == 0, "Clear").otherwise("Set"))


@query("# l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC) = 1) SELECT key, value, node, seq, timestamp FROM l WHERE arrival % 7 <> 0")
def replay_log_order(spark, d):
    empty = spark.createDataFrame([], "key string, value string, node long, seq long, timestamp long")
    return merge.replay(empty, _ops(spark, d))


@query("SELECT arrival AS wal_seq, key FROM e WHERE arrival < coalesce((SELECT min(arrival) FROM e WHERE event_bad), 9223372036854775807)".replace("event_bad", "arrival > 500000 AND arrival % 13 = 0"))
def replay_valid_prefix(spark, d):
    ops = _ops(spark, d).withColumn("crc", merge.record_crc())
    broken = (F.col("wal_seq") > 500000) & (F.col("wal_seq") % 13 == 0)
    return merge.valid_prefix(ops.withColumn("crc", F.when(broken, F.col("crc") + 1).otherwise(F.col("crc")))).select("wal_seq", "key")


@query(f"SELECT key, greatest({NOW}, timestamp + 1) AS timestamp FROM s")
def force_put_timestamps(spark, d):
    return state(spark, d).select("key", forced(NOW).alias("timestamp"))


_REASON = f"CASE WHEN strlen(key) > 9 THEN 'key exceeds max_key_bytes' WHEN strlen(value) > 6 THEN 'value exceeds max_value_bytes' WHEN timestamp > {NOW + 60000} THEN 'timestamp too far in the future' END"


@query(f"SELECT key, arrival, {_REASON} AS reason FROM e")
def admission_reasons(spark, d):
    return entries(spark, d).select("key", "arrival", admission.entry_reason(LIMITS, NOW).alias("reason"))


@query(f"""# r AS (SELECT *, {_REASON} AS why FROM e), f AS (SELECT key, row_number() OVER (ORDER BY min(arrival)) AS n FROM r WHERE why IS NULL GROUP BY key)
SELECT r.key, arrival, coalesce(why, CASE WHEN n > 50 THEN 'max_keys reached' END) AS reason FROM r LEFT JOIN f USING (key)""")
def admission_max_keys(spark, d):
    empty = spark.createDataFrame([], "key string, value string, node long, seq long, timestamp long")
    return admission.with_key_capacity(empty, entries(spark, d), admission.entry_reason(LIMITS, NOW), 50).select("key", "arrival", "reason")


@query()
def admission_total_bytes(spark, d):
    empty = spark.createDataFrame([], "key string, value string, node long, seq long, timestamp long")
    limits = admission.Limits(max_total_bytes=1500)
    return admission.admit(empty, entries(spark, d), limits, 1 << 62).select("key", "arrival", "reason")


def _le(x: str, n: int) -> str:
    return " || ".join(f"substr(printf('%016x', {x}), {15 - 2 * k}, 2)" for k in range(n))


_HEX = f"{_le('strlen(key)', 4)} || hex(encode(key)) || {_le('node', 4)} || {_le('seq', 8)} || {_le('timestamp', 8)} || CASE WHEN value IS NULL THEN '00' ELSE '01' || {_le('strlen(value)', 4)} || hex(encode(value)) END"


@query(f"SELECT sha256(unhex(string_agg({_HEX}, '' ORDER BY key))) AS digest FROM s")
def state_digest(spark, d):
    return digest.state_digest(state(spark, d))


@query(f"SELECT sha256(unhex(string_agg({_HEX}, '' ORDER BY key))) AS digest, true AS digest_match FROM s")
def digest_compare_replicas(spark, d):
    a, b = _halves(spark, d)
    left, right = digest.state_digest(merge.merge(a, b)), digest.state_digest(merge.merge(b, a))
    return left.crossJoin(right.withColumnRenamed("digest", "other")).select("digest", (F.col("digest") == F.col("other")).alias("digest_match"))


_ROUNDS = "r AS (SELECT (event_id % 5)::bigint AS peer, event_id::bigint AS round, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::bigint AS merged, event_id % 11 <> 0 AS peer_delta_empty, event_id % 17 = 0 AS digest_match FROM events)"


@query(f"""# {_ROUNDS}, q AS (SELECT *, merged = 0 AND peer_delta_empty AS quiet FROM r),
i AS (SELECT *, sum(CASE WHEN quiet AND digest_match THEN 1 ELSE 0 END) OVER (PARTITION BY peer ORDER BY round) AS island FROM q),
t AS (SELECT peer, round, quiet AND NOT digest_match AS hit, sum(CASE WHEN quiet AND NOT digest_match THEN 1 ELSE 0 END) OVER (PARTITION BY peer, island ORDER BY round) AS streak FROM i)
SELECT peer, round, streak::bigint AS streak, hit AND streak > 0 AND streak % 3 = 0 AS repair FROM t""")
def divergence_streaks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    r = e.select((F.col("event_id") % 5).cast("long").alias("peer"), F.col("event_id").cast("long").alias("round"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("merged"), (F.col("event_id") % 11 != 0).alias("peer_delta_empty"), (F.col("event_id") % 17 == 0).alias("digest_match"))
    return digest.streaks(r).select("peer", "round", "streak", "repair")


@query("""# f AS (SELECT node AS dir_id, key AS name, coalesce(value, '') AS content FROM e QUALIFY row_number() OVER (PARTITION BY node, key ORDER BY timestamp DESC, seq DESC) = 1)
SELECT name, count(*) AS copies, count(DISTINCT md5(content)) AS versions, count(*) = 3 AND count(DISTINCT md5(content)) = 1 AS consistent FROM f GROUP BY name""")
def replica_consistency(spark, d):
    e = entries(spark, d)
    f = e.groupBy(F.col("node").alias("dir_id"), F.col("key").alias("name")).agg(F.max_by(F.struct(F.coalesce("value", F.lit("")).alias("content")), F.struct("timestamp", "seq")).alias("x"))
    return consistency.replica_consistency(f.select("dir_id", "name", "x.content"), 3)


@query("SELECT count(*) AS n_kvs, count(*) FILTER (value IS NULL) AS n_tombstones, sum(strlen(key) + coalesce(strlen(value), 0))::bigint AS storage_bytes FROM s")
def node_status(spark, d):
    return members.node_status(state(spark, d))


@query("SELECT * FROM (VALUES (2::bigint, 'v1', 2::bigint, 0::bigint), (3, 'v2', 0, 0)) t(node_id, protocol, mismatches, failures)")
def link_status(spark, d):
    links = spark.createDataFrame([(2, "v1", 2, None)], "peer long, protocol string, mismatches long, failures long")
    return members.link_status(members.members(spark, 1, [2, 3]), 1, links)


@query("SELECT substr(key, 6) AS name, coalesce(strlen(value), 0)::int AS value_size, value IS NULL AS is_tombstone, timestamp, seq, node AS origin FROM s WHERE starts_with(key, 'user/')")
def debug_projection(spark, d):
    return consistency.debug_state(state(spark, d), "user/")


@query("SELECT key, CASE WHEN strlen(value) > 4 THEN left(value, 4) || '...' ELSE value END AS value_preview, value IS NULL AS is_tombstone, timestamp, seq, node AS origin FROM s")
def debug_raw(spark, d):
    return consistency.debug_raw(state(spark, d), 4)


@query("""# f AS (SELECT key AS name, value AS content FROM e WHERE node <> 3 AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC) = 1),
k AS (SELECT key AS name, value FROM s WHERE node <> 2), j AS (SELECT name, CASE WHEN k.name IS NULL THEN 'not_in_kv' WHEN f.name IS NULL THEN CASE WHEN value IS NOT NULL THEN 'missing_on_fs' END
WHEN value IS NULL THEN 'tombstone' WHEN content = value THEN 'match' ELSE 'mismatch' END AS status FROM f FULL JOIN k USING (name)) SELECT * FROM j WHERE status IS NOT NULL""")
def reconcile_outer(spark, d):
    e = entries(spark, d)
    listing = merge.last_arrival(e.filter("node <> 3 and value is not null")).select(F.col("key").alias("name"), F.col("value").alias("content"))
    return consistency.reconcile(listing, state(spark, d).filter("node <> 2").select(F.col("key").alias("name"), "value"))


@query("SELECT sum(strlen(key) + coalesce(strlen(value), 0))::bigint AS storage_bytes FROM s")
def storage_bytes(spark, d):
    return state(spark, d).agg(F.sum(size_bytes()).alias("storage_bytes"))


@query("SELECT key, count(*) AS signals FROM e WHERE starts_with(key, 'user/1') GROUP BY key")
def watch_prefix_hits(spark, d):
    return reads.by_prefix(entries(spark, d), "user/1", tombstones=True).groupBy("key").agg(F.count("*").alias("signals"))


@query("SELECT * FROM s")
def streaming_lww(spark, d):
    from .streaming.lww import run_once

    return run_once(spark, d)


@query("SELECT key, arg_max(value, arrival) AS value, max(arrival) AS last FROM (SELECT key, coalesce(value, '-') AS value, arrival FROM e) GROUP BY key")
def store_recovered_state(spark, d):
    """Two commits and a snapshot between them, reopened: what the log and the snapshot give together."""
    import uuid

    from .sources.files import shared_folder
    from .sources.store import Store

    url = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    e = entries(spark, d).withColumn("timestamp", F.col("arrival"))  # keeps the order of the log visible
    with Store(spark, url, 1) as s:
        s.append(e.filter("arrival < 500000"))
        s.persist(*s.load())
        s.append(e.filter("arrival >= 500000"))
    found, _, _ = Store(spark, url, 1).load()
    return found.select("key", F.coalesce(F.col("value").cast("string"), F.lit("-")).alias("value"), F.col("timestamp").alias("last"))


@query("""SELECT coalesce(m.peer, a.peer) AS peer, coalesce(a.ack, 0)::bigint AS local_ack, coalesce(m.ack, 0)::bigint AS peer_ack
  FROM (SELECT n AS peer, CASE n WHEN 2 THEN 3000 WHEN 3 THEN 1500 ELSE 0 END AS ack FROM (VALUES (1), (2), (3)) v(n)) m
  FULL JOIN (SELECT node + 1 AS peer, max(seq) AS ack FROM e GROUP BY node) a ON m.peer = a.peer""")
def legacy_peers(spark, d):
    from .sources.store import legacy_peers as table

    acks = entries(spark, d).groupBy((F.col("node") + 1).alias("origin")).agg(F.max("seq").alias("ack"))
    return table(members.members(spark, 1, [2, 3]), acks, _peer_acks(spark), 1)


@query("""SELECT '__file/' || coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'delete' ELSE 'put' END AS change
  FROM (SELECT * FROM s WHERE node <> 1 AND value IS NOT NULL) a FULL JOIN (SELECT * FROM s WHERE node <> 2 AND value IS NOT NULL) b ON a.key = b.key
  WHERE a.key IS NULL OR b.key IS NULL OR a.value <> b.value""")
def directory_changes(spark, d):
    from .sources.directories import changes

    live = reads.live(state(spark, d)).select(F.col("key").alias("name"), F.col("value").alias("content"), "node")
    return changes(live.filter("node <> 2").drop("node"), live.filter("node <> 1").drop("node")).select("key", "change")


def _binary(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("binary"))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("string"))


def _sides(spark, d, **config):
    """Two replicas: node 1 holds the entries of nodes 1 and 3, node 2 those of node 2. Nothing is refused."""
    from .plans.sync import Config, Replica

    limits = UNLIMITED
    e = _binary(entries(spark, d).drop("arrival"))
    make = lambda where, node, peer: Replica.of(merge.lww(e.filter(where)), node, [peer], config=Config(limits=limits, **config))
    return make("node <> 2", 1, 2), make("node = 2", 2, 1)


_SIDES = """a AS (SELECT key, value, node, seq, timestamp FROM e WHERE node <> 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, node DESC, seq DESC) = 1),
b AS (SELECT key, value, node, seq, timestamp FROM e WHERE node = 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, seq DESC) = 1)"""
_NEWER = "(b.timestamp, b.node, b.seq) > (a.timestamp, a.node, a.seq)"


@query(f"""# {_SIDES}, w AS (SELECT count(*) AS n FROM b LEFT JOIN a USING (key) WHERE a.key IS NULL OR {_NEWER}), p AS (SELECT count(*) <= 4096 AS one FROM a)
SELECT 0 AS round, w.n AS merged, 0::bigint AS rejected, true AS complete, one AS equal FROM w, p
UNION ALL SELECT 1, CASE WHEN one THEN 0 END, 0, true, true FROM p""")
def sync_round_convergence(spark, d):
    """Each side asks the other once: what each round merged, and whether the digests agree then. A request has a
    page of what the peer lacks, so a small side has told all it knows in the first round. As in the twin, what the
    second round merged is only told of a small side; the round itself is whole."""
    from .plans.sync import sync_round

    a, b = _sides(spark, d)
    small, rows = a.state.count() <= a.config.max_entries, []
    for i, (x, y) in enumerate(((a, b), (b, a))):
        o = sync_round(x, y)
        rows.append((i, o.merged if i == 0 or small else None, o.rejected, o.complete, a.digest() == b.digest()))
    return spark.createDataFrame(rows, "round int, merged long, rejected long, complete boolean, equal boolean")


@query("SELECT * FROM s")
def sync_paged_state(spark, d):
    """The state of a node after one round of many pages."""
    from .plans.sync import sync_round

    a, b = _sides(spark, d, max_entries=400, loose_rows=300)
    sync_round(a, b)
    return _text(a.state)


@query(f"# {_SIDES} SELECT key, value, node, seq, timestamp FROM a WHERE seq > CASE node WHEN 1 THEN 2000 ELSE 0 END ORDER BY node, seq LIMIT 50")
def sync_request(spark, d):
    """What a request carries: the first page of what the peer last said it lacks."""
    a, _ = _sides(spark, d, max_entries=50)
    a.peer_acks[2] = {1: 2000}
    return _text(a.prepare_sync(2).entries)


@query(f"""# {_SIDES}, m AS (SELECT key, value, node, seq, timestamp FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE seq > 0 ORDER BY node, seq)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, node DESC, seq DESC) = 1)
SELECT * FROM m WHERE seq > CASE node WHEN 1 THEN (SELECT max(seq) FROM a WHERE node = 1) ELSE 0 END""")
def sync_served_answer(spark, d):
    """What the asked side sends back: its state with the request merged, behind the acks of the request. Both
    messages are whole, whatever their size."""
    a, b = _sides(spark, d, max_entries=None, max_bytes=None)
    return _text(b.handle(a.prepare_sync(2)).entries)


@query(f"""# {_SIDES} SELECT (SELECT count(*) FROM b LEFT JOIN a USING (key) WHERE a.key IS NULL OR {_NEWER}) AS merged, 0::bigint AS rejected, true AS complete,
  true AS acks_adopted, (SELECT max(seq) FROM b) AS ack, (SELECT count(*) FROM s) AS n_kvs""")
def sync_applied_answer(spark, d):
    """The outcome of an answer at the asking side, and what it covers then. Request and answer are whole."""
    a, b = _sides(spark, d, max_entries=None, max_bytes=None)
    o = a.apply(b.handle(a.prepare_sync(2)))
    rows = [(o.merged, o.rejected, o.complete, o.acks_adopted, a.acks.get(2, 0), a.state.count())]
    return spark.createDataFrame(rows, "merged long, rejected long, complete boolean, acks_adopted boolean, ack long, n_kvs long")


@query("""# f AS (SELECT key, row_number() OVER (ORDER BY key) AS n FROM s QUALIFY n <= 6)
SELECT key, CASE WHEN n = 6 THEN NULL ELSE 'new' END AS value, 1::bigint AS node, (SELECT max(seq) FROM e WHERE node = 1 AND (key, timestamp, seq) IN (SELECT key, timestamp, seq FROM s)) + n AS seq, 5::bigint AS timestamp FROM f""")
def push_message(spark, d):
    """Local writes that wait for a push, and a delete."""
    from .plans.sync import Replica

    a = Replica.of(_binary(state(spark, d)), 1, [2])
    keys = [r["key"] for r in state(spark, d).select("key").orderBy("key").limit(6).collect()]
    for k in keys[:5]:
        a.put(k, b"new", 5)
    a.delete(keys[5], 5)
    return _text(a.take_push().entries)


@query("SELECT count(*) AS n_kvs, 0::bigint AS covered FROM s")
def push_merged(spark, d):
    """Pushed entries land, but a push covers nothing."""
    a, b = _sides(spark, d)
    b.handle(type(a.prepare_sync(2))(1, a.uuid, dict(a.acks), a.state, push_only=True))
    return spark.createDataFrame([(b.state.count(), b.acks.get(1, 0))], "n_kvs long, covered long")


@query("SELECT key, value, node, seq, timestamp FROM s WHERE seq > CASE node WHEN 2 THEN 1000 ELSE 0 END")
def older_served(spark, d):
    """The older protocol answers with all that its asker lacks, unpaged."""
    from .plans.sync import Replica

    b = Replica.of(_binary(state(spark, d)), 2, [1])
    return _text(b.handle_v1(1, b.state.limit(0), {2: 1000})[0])


@query("SELECT n.snapshot, n.ok AS adopted, CASE WHEN n.ok THEN 7 ELSE 0 END::bigint AS ack FROM (VALUES (false, false), (true, true)) n(snapshot, ok)")
def older_consumed(spark, d):
    """Progress is only adopted from a snapshot."""
    from .plans.sync import Replica

    rows = []
    for snapshot in (False, True):
        a = Replica(spark, 1, [2])
        o = a.apply_v1(_binary(state(spark, d)).limit(0), {2: 7}, snapshot)
        rows.append((snapshot, o.acks_adopted, a.acks.get(2, 0)))
    return spark.createDataFrame(rows, "snapshot boolean, adopted boolean, ack long")


@query("SELECT count(*) AS n_kvs, (SELECT max(seq) FROM e WHERE node = 2 AND (key, timestamp, seq) IN (SELECT key, timestamp, seq FROM b)) AS ack FROM s".replace("SELECT count", f"# {_SIDES} SELECT count", 1))
def older_round(spark, d):
    from .plans.sync import sync_v1

    a, b = _sides(spark, d)
    sync_v1(a, b)
    return spark.createDataFrame([(a.state.count(), a.acks.get(2, 0))], "n_kvs long, ack long")


@query("SELECT * FROM (VALUES (1::bigint, true), (3, false), (4, true)) t(sender, known)")
def identity_check(spark, d):
    """Known senders must have their uuid; unknown ones pass."""
    from .plans.sync import IdentityError, Replica

    b, rows = Replica(spark, 2, [1, 3], known={1: b"one", 3: b"three"}), []
    for sender, uuid in ((1, b"one"), (3, b"other"), (4, b"four")):
        try:
            b.check_identity(sender, uuid)
            rows.append((sender, True))
        except IdentityError:
            rows.append((sender, False))
    return spark.createDataFrame(rows, "sender long, known boolean")


@query("SELECT * FROM (VALUES (0::bigint, 'older'), (100, 'older'), (400, 'newer'), (500, 'newer')) t(clock, spoken)")
def protocol_choice(spark, d):
    """A peer that lacks the newer protocol is asked by the older one, until the re-probe finds it."""
    from .plans.sync import Replica, talk_to
    from .plans.transport import InProcess

    a, b, rows = Replica(spark, 1, [2]), Replica(spark, 2, [1]), []
    for at, older in ((0, (2,)), (100, ()), (400, ()), (500, ())):
        talk_to(a, 2, InProcess([b], older), now=at)
        rows.append((at, "older" if 2 in a.legacy else "newer"))
    return spark.createDataFrame(rows, "clock long, spoken string")


@query(f"# {_SIDES} SELECT 2::bigint AS peer, (SELECT count(*) FROM b LEFT JOIN a USING (key) WHERE a.key IS NULL OR {_NEWER}) AS merged, 0::bigint AS failures UNION ALL SELECT 9, NULL, 2")
def fan_out(spark, d):
    """Rounds with all peers at once: one answers, one does not."""
    from .plans.sync import talk_to_all
    from .plans.transport import InProcess

    a, b = _sides(spark, d)
    first = talk_to_all(a, [2, 9], InProcess([b]))
    talk_to_all(a, [9], InProcess([b]))
    return spark.createDataFrame([(p, o.merged if o else None, a.failures[p]) for p, o in first.items()], "peer long, merged long, failures long")


@query("SELECT 3 AS id, max(seq) + 1 AS next_seq, (SELECT count(*) FROM s) AS n_kvs FROM s WHERE node = 3")
def bootstrapped(spark, d):
    """An empty node that comes back gets its entries from its peers, and never uses a seq again."""
    from .plans.sync import Config, Replica, bootstrap

    c = Replica(spark, 3, [1, 2], config=Config(limits=UNLIMITED))
    bootstrap(c, list(_sides(spark, d)))
    return spark.createDataFrame([(3, c.next_seq, c.state.count())], "id int, next_seq long, n_kvs long")


@query("SELECT count(*) AS n_kvs, true AS equal FROM s")
def loops_converge(spark, d):
    """Rounds on a clock, as a streaming query, until both sides agree. It ends before only where rounds fail."""
    import time

    from .streaming.loops import start_rounds

    a, b = _sides(spark, d, interval_s=0.5)
    running = [start_rounds(a, [b]), start_rounds(b, [a])]
    going = lambda: all(q.isActive for q in running) and max(a.failures.get(2, 0), b.failures.get(1, 0)) < 5
    while going() and a.digest() != b.digest():
        time.sleep(0.5)
    for q in running:
        q.stop()
    return spark.createDataFrame([(a.state.count(), a.digest() == b.digest())], "n_kvs long, equal boolean")


@query("""SELECT * FROM (SELECT 'key' AS watched, (SELECT count(*) > 0 FROM s WHERE key = 'user/1/4') AS signal UNION ALL SELECT 'prefix', (SELECT count(*) > 0 FROM s WHERE starts_with(key, 'user/1'))
  UNION ALL SELECT 'other', false UNION ALL SELECT 'again', false)""")
def watch_signals(spark, d):
    """Many entries are one signal for a watcher, and none for one whose keys were not set; taken, it is gone."""
    from .plans.sync import Replica

    a = Replica(spark, 1, [])
    one, some, other = a.watch_key("user/1/4"), a.watch_prefix("user/1"), a.watch_prefix("none/")
    a.merge_batch(_binary(state(spark, d)), now_ms=1 << 62)
    rows = [("key", one.wait(0)), ("prefix", some.wait(0)), ("other", other.wait(0)), ("again", some.wait(0))]
    return spark.createDataFrame(rows, "watched string, signal boolean")


@query("SELECT 'user/1' AS prefix, count(*) > 0 AS signal FROM e WHERE starts_with(key, 'user/1')")
def watch_stream(spark, d):
    """A watcher on a stream: one signal a micro-batch that touches the prefix."""
    from .streaming.lww import read_events, watch

    seen: list = []
    q = watch(read_events(spark, f"{d}/events.parquet"), seen.append, prefix="user/1", trigger={"availableNow": True})
    q.awaitTermination()
    return spark.createDataFrame([("user/1", len(seen) > 0)], "prefix string, signal boolean")


@query("SELECT count(*) AS merged, 0::bigint AS rejected, true AS complete FROM s".replace("FROM s", "FROM s WHERE strlen(key) <= 9").replace("0::bigint", "(SELECT count(*) FROM s WHERE strlen(key) > 9)").replace("true AS", "(SELECT count(*) = 0 FROM s WHERE strlen(key) > 9) AS"))
def merge_outcome(spark, d):
    """One batch into an empty node: what landed, what was refused, and whether its acks may be adopted."""
    from .plans.sync import Config, Replica

    a = Replica(spark, 1, [], Config(limits=admission.Limits(max_key_bytes=9)))
    o = a.merge_batch(_binary(state(spark, d)), now_ms=1 << 62)
    return spark.createDataFrame([(o.merged, o.rejected, o.complete)], "merged long, rejected long, complete boolean")


@query("SELECT 'landed' AS what, count(*) AS n FROM s UNION ALL SELECT 'changed', 0 UNION ALL SELECT 'landed now', 1")
def merge_one(spark, d):
    """An entry that is there already changes nothing; a newer one does."""
    base = _binary(state(spark, d))
    first = base.orderBy("key").limit(1)
    again, newer = merge.decided(base, first.withColumn("arrival", F.lit(0))), merge.decided(base, first.withColumn("timestamp", F.col("timestamp") + 1).withColumn("arrival", F.lit(0)))
    return spark.createDataFrame([("landed", base.count()), ("changed", again.count()), ("landed now", newer.count())], "what string, n long")


@query(f"""# r AS (SELECT *, {_REASON} AS why, CASE WHEN starts_with(key, 'user/1') THEN 'not allowed' END AS rule FROM e),
p AS (SELECT key, min(arrival) AS a FROM r WHERE why IS NULL AND rule IS NULL GROUP BY key ORDER BY a LIMIT 50), t AS (SELECT max(a) AS last, count(*) AS n FROM p)
SELECT key, arrival, coalesce(why, CASE WHEN key NOT IN (SELECT key FROM p) AND (SELECT n FROM t) = 50 AND arrival > (SELECT last FROM t) THEN 'max_keys reached' END, rule) AS reason FROM r""")
def admission_policy(spark, d):
    """A user's rule is asked last, and what it refuses takes no place of max_keys."""
    empty = spark.createDataFrame([], "key string, value string, node long, seq long, timestamp long")
    limits = admission.Limits(LIMITS.max_key_bytes, LIMITS.max_value_bytes, 50, 1 << 40, LIMITS.max_drift_ms)
    rule = lambda: F.when(F.col("key").startswith("user/1"), "not allowed")
    return admission.admit(empty, entries(spark, d), limits, NOW, rule).select("key", "arrival", "reason")


@query("SELECT 1024::bigint AS max_key_bytes, 1048576::bigint AS max_value_bytes, 1000000::bigint AS max_keys, 1073741824::bigint AS max_total_bytes, 300000::bigint AS max_drift_ms, 4096::bigint AS max_entries, 4194304::bigint AS max_bytes, 200::bigint AS coalesce_ms, 30::bigint AS interval_s, 300::bigint AS reprobe_s")
def config_defaults(spark, d):
    from .plans.sync import Config

    c = Config()
    row = (*(getattr(c.limits, k) for k in ("max_key_bytes", "max_value_bytes", "max_keys", "max_total_bytes", "max_drift_ms")), c.max_entries, c.max_bytes, int(c.coalesce_s * 1000), int(c.interval_s), int(c.reprobe_s))
    return spark.createDataFrame([row], "max_key_bytes long, max_value_bytes long, max_keys long, max_total_bytes long, max_drift_ms long, max_entries long, max_bytes long, coalesce_ms long, interval_s long, reprobe_s long")


@query("SELECT * FROM (VALUES ('all', 1::bigint), ('all', 2), ('all', 3), ('peers', 2), ('peers', 3), ('added', 1), ('added', 2), ('added', 3), ('added', 7), ('removed', 1), ('removed', 3), ('self stays', 1), ('self stays', 2), ('self stays', 3)) t(what, node_id)")
def membership(spark, d):
    """Members: own node first and each once, its peers, and additions and removals; nobody removes itself."""
    m = members.members(spark, 1, [2, 3, 2, 1])
    parts = {"all": m, "peers": members.peers_of(m, 1), "added": members.add(members.add(m, 7), 2), "removed": members.remove(m, 2, 1), "self stays": members.remove(m, 1, 1)}
    out = None
    for k, v in parts.items():
        part = v.select(F.lit(k).alias("what"), "node_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""# seen AS (SELECT node AS origin, max(seq) AS ack FROM s GROUP BY node)
SELECT o.origin::bigint AS origin, coalesce(ack, 0) AS ack FROM (VALUES (1), (2), (3), (4)) o(origin) LEFT JOIN seen USING (origin)""")
def ack_for_origins(spark, d):
    seen = state(spark, d).groupBy(F.col("node").alias("origin")).agg(F.max("seq").alias("ack"))
    out = None
    for n in (1, 2, 3, 4):
        part = coverage.ack_for(seen, n).select(F.lit(n).cast("long").alias("origin"), "ack")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'acks' AS kind, node AS peer, max(seq) AS ack FROM s WHERE node <> 2 GROUP BY node UNION ALL SELECT 'said', 3, a FROM (VALUES (1500), (3333)) t(a)")
def peer_coverage_reset(spark, d):
    """Repair forgets what a peer covers here and what it said."""
    seen = state(spark, d).groupBy(F.col("node").alias("origin")).agg(F.max("seq").alias("ack"))
    left = coverage.reset(seen, 2).select(F.lit("acks").alias("kind"), F.col("origin").alias("peer"), "ack")
    return left.unionByName(coverage.forget_peer(_peer_acks(spark), 2).select(F.lit("said").alias("kind"), "peer", "ack"))


@query("SELECT 'own writes' AS what, 4::bigint AS ack, 5::bigint AS next_seq, 3::bigint AS queued UNION ALL SELECT 'queue full', 7, 8, 2")
def own_writes(spark, d):
    """Own writes cover themselves and queue their keys; a full queue is emptied first, the next round brings it."""
    from .plans.sync import Config, Replica

    a = Replica(spark, 1, [2], Config(max_entries=4))
    for k in ("a", "b", "a"):
        a.put(k, b"v", 5)
    a.delete("c", 6)
    a.queue.pop()
    rows = [("own writes", a.acks[1], a.next_seq, len(a.queue))]
    for k in ("d", "e", "f"):
        a.put(k, b"v", 7)
    return spark.createDataFrame([*rows, ("queue full", a.acks[1], a.next_seq, len(a.queue))], "what string, ack long, next_seq long, queued long")


@query("""SELECT key, CASE WHEN value IS NULL THEN 'Clear' ELSE 'Set' END AS op FROM s WHERE value IS NOT NULL OR starts_with(key, 'user/1')
  UNION ALL SELECT NULL, 'AddPeer' UNION ALL SELECT NULL, 'RemovePeer'""")
def log_without_noops(spark, d):
    """Records that would change nothing never get into the log."""
    from .sources.store import as_ops, drop_noops

    s = state(spark, d)
    ops = as_ops(s.select(F.when(F.col("value").isNull(), "Clear").otherwise("Set").alias("op"), "key", F.col("value").cast("binary").alias("value")))
    ops = ops.unionByName(as_ops(spark.createDataFrame([("AddPeer", 1), ("AddPeer", 9), ("RemovePeer", 2), ("RemovePeer", 8)], "op string, peer_id long")))
    return drop_noops(ops, _binary(s.filter("value IS NOT NULL OR startswith(key, 'user/1')")), [1, 2]).select("key", "op")


@query(f"""# d AS ({_DELTA}), p AS (SELECT (row_number() OVER (ORDER BY node, seq) - 1) // 100 AS page FROM d)
SELECT page, count(*) AS entries, page = (SELECT max(page) FROM p) AS adoptable FROM p GROUP BY page""")
def page_adoptable(spark, d):
    """Only the last page of a delta lets its acks be adopted."""
    pages = delta.pages_by_count(state(spark, d), ACKS, 100).groupBy("page").agg(F.count("*").alias("entries"))
    last = pages.agg(F.max("page").alias("_last"))
    return pages.crossJoin(F.broadcast(last)).select("page", "entries", (F.col("page") == F.col("_last")).alias("adoptable"))  # last is one row


@query(f"SELECT substr(sha256(unhex(string_agg({_HEX}, '' ORDER BY key))), 1, 16) AS short FROM s")
def digest_short(spark, d):
    return digest.state_digest(state(spark, d)).select(digest.short("digest").alias("short"))


@query(f"""# w AS (SELECT * FROM (VALUES (2, 1, 3000), (2, 2, 2500), (2, 3, 900), (3, 1, 1500), (3, 2, 3333)) t(peer, origin, ack))
SELECT m.id::bigint AS id, coalesce(a.ack, 0)::bigint AS ack, coalesce((SELECT max(ack) FROM w WHERE peer = m.id AND origin = 1), 0)::bigint AS peer_ack, m.id IN (SELECT peer FROM w) AS heard_from
FROM (VALUES (1), (2), (3), (4)) m(id) LEFT JOIN (VALUES (1, 2000), (2, 3000)) a(o, ack) ON a.o = m.id""")
def peer_status(spark, d):
    return members.peer_status(members.members(spark, 1, [2, 3, 4]), 1, acks_table(spark), _peer_acks(spark))


@query(f"SELECT 1::bigint AS id, 42::bigint AS next_seq, 7::bigint AS merged, 2::bigint AS rejected, true AS dirty, false AS log, count(*) AS n_kvs, sha256(unhex(string_agg({_HEX}, '' ORDER BY key))) AS digest, 3::bigint AS peers FROM s")
def node_report(spark, d):
    out = members.node_report(state(spark, d), 1, members.members(spark, 1, [2, 3]), acks_table(spark), _peer_acks(spark), 42, True, False, 7, 2)
    return out.withColumn("peers", F.size("peers").cast("long"))


@query("SELECT * FROM (VALUES (2::bigint, 3000::bigint, 3000::bigint), (3, 0, 1500)) t(peer, ack, peer_ack)")
def debug_acks(spark, d):
    return consistency.debug_acks(members.members(spark, 1, [2, 3]), 1, acks_table(spark), _peer_acks(spark))


def _store(spark, name: str, **more):
    import uuid

    from .sources.files import shared_folder
    from .sources.store import Store

    url = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return url, Store(spark, url, 1, **more)


@query("SELECT 2::bigint AS commits, 1::bigint AS held, count(*) AS last, false AS after FROM e")
def store_commits(spark, d):
    """Appends within the window are held and committed together; an idle store commits nothing."""
    _, s = _store(spark, "commits", sync_window_s=3600)
    e = _binary(entries(spark, d))
    s.append(e.filter("arrival < 500000"))
    s.sync()
    s.append(e.filter("arrival >= 500000"))
    held = int(s.has_unsynced())
    s.sync()
    s.sync()
    return spark.createDataFrame([(s.commits, held, s.last, s.has_unsynced())], "commits long, held long, last long, after boolean")


@query("SELECT count(*) AS kept, count(*) AS last FROM e WHERE arrival < 500000")
def store_truncated(spark, d):
    """A commit that was cut off is gone when the store is opened again, and its numbers are free."""
    from .sources.store import Store

    url, s = _store(spark, "cut")
    e = _binary(entries(spark, d))
    s.append(e.filter("arrival < 500000"))
    s.append(e.filter("arrival >= 500000"))
    s.folder.delete(f"log/{s._commits()[1][0]}/_SUCCESS")
    again = Store(spark, url, 1)
    return spark.createDataFrame([(again.log().count(), again.last)], "kept long, last long")


@query("SELECT count(*) FILTER (arrival >= 500000) AS logged, count(*) AS last, 2::bigint AS generation, (SELECT count(DISTINCT key) FROM e) AS n_kvs, true AS idle FROM e")
def store_rotated(spark, d):
    """After two snapshots the log keeps what the older one lacks; with nothing new, none is written."""
    from .sources.store import Store

    url, s = _store(spark, "rotated")
    e = _binary(entries(spark, d))
    s.append(e.filter("arrival < 500000"))
    s.persist(*s.load())
    s.append(e.filter("arrival >= 500000"))
    generation, idle = s.persist(*s.load()), s.persist(*s.load()) is None
    s.close()
    again = Store(spark, url, 1)
    return spark.createDataFrame([(again.log().count(), again.last, generation, again.load()[0].count(), idle)], "logged long, last long, generation long, n_kvs long, idle boolean")


@query("SELECT key, arg_max(value, arrival) AS value FROM (SELECT key, coalesce(value, '-') AS value, arrival FROM e) GROUP BY key")
def store_older_generation(spark, d):
    """The newest snapshot is lost: the one before it and the log give the same state."""
    from .sources.store import Store

    url, s = _store(spark, "older")
    e = _binary(entries(spark, d))
    for part in ("arrival < 500000", "arrival >= 500000"):
        s.append(e.filter(part))
        s.persist(*s.load())
    s.folder.delete("snapshot-000000000002")
    found = Store(spark, url, 1).load()[0]
    return found.select("key", F.coalesce(F.col("value").cast("string"), F.lit("-")).alias("value"))


@query(f"# {_SIDES} SELECT key, value, node, seq, timestamp FROM b WHERE seq > 0 ORDER BY node, seq LIMIT 200")
def envelope_round_trip(spark, d):
    """An answer as bytes and back."""
    from .plans import codec

    _, b = _sides(spark, d, max_entries=200)
    b.acks, message = {2: 1}, b.prepare_sync(1)
    return _text(codec.decode(spark, codec.encode(message)).entries)


@query(f"# {_SIDES} SELECT (SELECT count(*) FROM b LEFT JOIN a USING (key) WHERE a.key IS NULL OR {_NEWER}) AS merged, (SELECT count(*) FROM s) AS n_kvs, true AS adopted")
def mailbox_round(spark, d):
    """A round of many pages over files in a shared folder."""
    import threading
    import uuid

    from .plans.sync import round_with
    from .plans.transport import Mailbox
    from .sources.files import shared_folder

    a, b = _sides(spark, d, max_entries=700)
    box, done = Mailbox(spark, f"{shared_folder(spark)}/box-{uuid.uuid4().hex}", wait_s=120), threading.Event()

    def serve():
        while not done.wait(0.02):
            box.serve(b)

    server = threading.Thread(target=serve)
    server.start()
    try:
        o = round_with(a, 2, box)
    finally:
        done.set()
        server.join()
    return spark.createDataFrame([(o.merged, a.state.count(), o.acks_adopted)], "merged long, n_kvs long, adopted boolean")


@query("""# f AS (SELECT key, value, row_number() OVER (ORDER BY key) AS n FROM s WHERE value IS NOT NULL QUALIFY n <= 20)
SELECT '__file/' || replace(key, '/', '.') AS key, value FROM f""")
def directory_round_trip(spark, d):
    """Twenty entries written to a directory as files and read back as entries."""
    import uuid

    from .sources.directories import as_entries, read_directory, write_directory
    from .sources.files import shared_folder

    url = f"{shared_folder(spark)}/dir-{uuid.uuid4().hex}"
    some = reads.live(state(spark, d)).orderBy("key").limit(20)
    rows = _binary(some.withColumn("key", F.concat(F.lit("__file/"), F.translate("key", "/", "."))))
    write_directory(rows, url)
    return _text(as_entries(read_directory(spark, url), 1, 1, 5).select("key", "value"))


@query("SELECT 'host:' || count(*)::varchar AS address FROM s")
def peer_address(spark, d):
    from .sources.directories import peer_address as address

    n = state(spark, d).count()
    book = spark.createDataFrame([("__peer_addr/2", bytearray(f"host:{n}".encode()), 1, 1, 1), ("__peer_addr/3", None, 1, 2, 1)], "key string, value binary, node long, seq long, timestamp long")
    return address(book, 2).unionByName(address(book, 3))


@query("SELECT op, count(*) AS n FROM (SELECT CASE WHEN (i * 37) % 100 < 40 THEN 'create' WHEN (i * 37) % 100 < 70 THEN 'modify' ELSE 'delete' END AS op FROM range(1000) r(i)) GROUP BY op")
def churn_mix(spark, d):
    return churn.churn(spark, 1000).groupBy("op").agg(F.count("*").alias("n"))


@query("""# c AS (SELECT i, (i * 37) % 100 AS t, 'file-' || ((i * 104729) % 50)::varchar AS name FROM range(1000) r(i))
SELECT '__file/' || name AS key, arg_max(coalesce(content, '-'), i) AS value FROM (SELECT *, CASE WHEN t < 40 THEN 'create ' || name || ' ' || i::varchar WHEN t < 70 THEN 'modify ' || name || ' ' || i::varchar END AS content FROM c) GROUP BY name""")
def churn_state(spark, d):
    """Random changes, merged in any order."""
    out = merge.lww(churn.as_entries(churn.churn(spark, 1000)).orderBy(F.xxhash64("seq")))
    return out.select("key", F.coalesce(F.col("value").cast("string"), F.lit("-")).alias("value"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
