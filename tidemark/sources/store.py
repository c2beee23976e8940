"""A durable store: an append-only log of operations and snapshots in generations.

    log-header.json             format, version, owner
    log/<first wal_seq>/        one commit: Parquet rows (OPS and crc), complete once it has _SUCCESS
    snapshot-<generation>/      Parquet rows of a state
    generation-<n>.json         manifest: counts, members, next_seq, and the last wal_seq it covers

A commit is one Parquet write, so a batch of any size costs one. It is written under a name of its own
and then renamed, so it is in the log as a whole or not at all, and a failed one takes nothing along.
One lock orders appends, commits and snapshots of a store's threads. Log and snapshots stay DataFrames; the
driver holds manifests only. The log keeps what the generation before the newest lacks, so a damaged
newest snapshot loses nothing."""

from __future__ import annotations

import json
import threading
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import ENTRY, FIELDS
from ..operators import merge
from .files import Folder, shared_folder

OPS = "op string, key string, value binary, node long, seq long, timestamp long, peer_id long, ack_seq long"
_NAMES = [c.split()[0] for c in OPS.split(", ")]
LOG = "wal_seq long, " + OPS + ", crc long"
#: Kinds of operations that a log keeps.
DURABLE = ["Set", "Clear", "AddPeer", "RemovePeer"]
_HEADER = {"format": "tidemark-log", "version": 1}
_MANIFEST = {"format": "tidemark-generation", "version": 1}


class StoreError(RuntimeError):
    pass


def row_crc():
    return merge.record_crc(["wal_seq", *_NAMES])


def as_ops(rows: DataFrame) -> DataFrame:
    """rows with the columns of OPS; those that they lack are null, and op is Set."""
    have = set(rows.columns)
    if "op" not in have:
        rows = rows.withColumn("op", F.lit("Set"))
        have.add("op")
    typed = [c.split() for c in OPS.split(", ")]
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in typed], *([F.col("arrival")] if "arrival" in have else []))


def number(rows: DataFrame, first: int) -> DataFrame:
    """rows with wal_seq from `first` without gaps, in order of arrival (where they have one). Sorted by
    range, then counted by partition: no task sees all rows."""
    if "arrival" in rows.columns:
        rows = rows.orderBy("arrival")
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    out = rows.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part")
    return out.withColumn("wal_seq", F.col("_before") + place + F.lit(first)).drop("_part", "_before", "_id", "arrival")


def replay_members(members: list[int], ops: DataFrame) -> list[int]:
    """Members after AddPeer and RemovePeer records: each peer's last record counts."""
    last = ops.filter(F.col("op").isin("AddPeer", "RemovePeer")).groupBy("peer_id").agg(F.max_by("op", "wal_seq").alias("op"), F.max("wal_seq").alias("_at"))
    rows = last.orderBy("_at").collect()  # a row a node of the cluster
    gone = {r["peer_id"] for r in rows if r["op"] == "RemovePeer"}
    return list(dict.fromkeys([m for m in members if m not in gone] + [r["peer_id"] for r in rows if r["op"] == "AddPeer"]))


def replay_acks(ops: DataFrame) -> DataFrame:
    """(origin, ack) that records of older logs claim: maxima, but nothing from before a peer's removal."""
    gone = ops.filter("op = 'RemovePeer'").groupBy(F.col("peer_id").alias("origin")).agg(F.max("wal_seq").alias("_gone"))
    said = ops.filter(F.col("op").isin("UpdateLocalAck", "PushPeerLog")).select(F.col("peer_id").alias("origin"), F.when(F.col("op") == "PushPeerLog", F.col("seq")).otherwise(F.col("ack_seq")).alias("ack"), "wal_seq")
    kept = said.join(gone, "origin", "left").filter("_gone IS NULL OR wal_seq > _gone")
    return kept.groupBy("origin").agg(F.max("ack").alias("ack"))


def replay_next_seq(ops: DataFrame, node: int, floor: int = 1) -> DataFrame:
    """One row: next_seq after all records in any order of Set and SetNextSeq, then IncrementSeq. Own
    seqs are never used again, even where their key was overwritten; to skip some does no harm."""
    used = F.when((F.col("op") == "Set") & (F.col("node") == node), F.col("seq") + 1).when(F.col("op") == "SetNextSeq", F.col("ack_seq"))
    return ops.agg((F.greatest(F.lit(floor).cast("long"), F.coalesce(F.max(used), F.lit(0))) + F.count_if(F.col("op") == "IncrementSeq")).alias("next_seq"))


def drop_noops(ops: DataFrame, state: DataFrame, members: list[int]) -> DataFrame:
    """ops without those that would change nothing: Clear of an absent key, adding a member, removing a stranger."""
    kept = ops.filter(~((F.col("op") == "AddPeer") & F.col("peer_id").isin(members)) & ~((F.col("op") == "RemovePeer") & ~F.col("peer_id").isin(members)))
    clears = kept.filter("op = 'Clear'").join(state.select("key"), "key", "left_semi").select(*kept.columns)
    return kept.filter("op <> 'Clear'").unionByName(clears)


class Store:
    """The store of one node in a folder that driver and executors share. sync_window_s: appends within
    that time of the last commit are held and committed together (0: each append is a commit)."""

    def __init__(self, spark: SparkSession, url: str, node: int, sync_window_s: float = 0.0):
        self.spark, self.node, self.window = spark, node, sync_window_s
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        self._lock = threading.RLock()
        self.folder = Folder(spark, url)
        self.commits = self.rewritten = 0
        self.dirty = self.closed = self._snapshotting = False
        self._held: list[DataFrame] = []
        self.acks: dict[int, int] = {}
        self._last_sync = time.monotonic()
        self._check("log-header.json", _HEADER, create=True)
        self.last = self._repair()

    def _check(self, name: str, want: dict, create: bool = False) -> dict:
        if create and not self.folder.exists(name):
            self.folder.write(name, json.dumps(want | {"node": self.node, "created_ms": int(time.time() * 1000)}).encode())
        try:
            found = json.loads(self.folder.read(name))
        except ValueError as e:
            raise StoreError(f"{name} is damaged") from e
        if {k: found.get(k) for k in want} != want:
            raise StoreError(f"{name} is of another format or version")
        if found.get("node") != self.node:
            raise StoreError(f"{name} belongs to node {found.get('node')}")
        return found

    # log
    def _commits(self) -> list[tuple[str, bool]]:
        return [(n, self.folder.exists(f"log/{n}/_SUCCESS")) for n, _ in self.folder.names("log") if n.isdigit()]

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[self.folder.at(f"log/{n}") for n in names])

    def _readable(self, name: str) -> bool:
        try:
            self._read([name]).agg(F.count("wal_seq"), F.max("crc"), F.max("key"), F.max("value")).collect()
            return True
        except Exception as e:  # damaged Parquet only; a lost cluster must not look like a damaged log
            if "parquet" in str(e).lower() or "FAILED_READ_FILE" in str(e):
                return False
            raise

    def _repair(self) -> int:
        """Cut the log behind its valid prefix (a commit without end, an unreadable one, a wrong crc), so
        that later appends can be reached; the last valid wal_seq."""
        good: list[str] = []
        cut = False
        for name, _ in self.folder.names():
            if name.startswith("commit-"):  # never got into the log
                self.folder.delete(name)
        for name, whole in self._commits():
            cut = cut or not whole
            if cut:
                self.folder.delete(f"log/{name}")
            else:
                good.append(name)
        if not good:
            return self._floor()
        try:
            bad = self._read(good).filter(F.col("crc") != row_crc()).agg(F.min("wal_seq")).first()[0]
        except Exception:  # some commit is unreadable: find the first
            readable = next((i for i, n in enumerate(good) if not self._readable(n)), None)
            if readable is None:
                raise
            for name in good[readable:]:
                self.folder.delete(f"log/{name}")
            return self._repair()
        if bad is not None:
            at = max(n for n in good if int(n) <= bad)
            for name in good:
                if name > at:
                    self.folder.delete(f"log/{name}")
            self.rewritten += 1
            if int(at) < bad:
                self._read([at]).filter(F.col("wal_seq") < bad).write.mode("overwrite").parquet(self.folder.at("rewritten"))
                self.folder.delete(f"log/{at}")
                self.folder.rename("rewritten", f"log/{at}")
            else:
                self.folder.delete(f"log/{at}")
            good = [n for n in good if n < at or (n == at and int(at) < bad)]
        top = self._read(good).agg(F.max("wal_seq")).first()[0] if good else None
        return max(self._floor(), top or 0)

    def _floor(self) -> int:
        """wal_seqs up to those that manifests cover are never given again."""
        return max([m["wal_last"] for m in self._manifests()], default=0)

    def append(self, ops: DataFrame) -> None:
        """Durable operations to the log, in order of arrival: one commit, or held for the sync window."""
        with self._lock:
            if self.closed:
                raise StoreError("the store is closed")
            mine = as_ops(ops).filter(F.col("op").isin(DURABLE))
            self._held.append(mine)
            if self.window <= 0 or time.monotonic() - self._last_sync >= self.window:
                try:
                    self.sync()
                except Exception:
                    self._held = [h for h in self._held if h is not mine]  # refused; what was held before stays for the next try
                    raise
            self.dirty = True

    def has_unsynced(self) -> bool:
        return bool(self._held)

    def sync(self) -> None:
        """Commit what is held. If that fails, it stays held, and nothing of it is in the log."""
        with self._lock:
            self._commit()

    def _commit(self) -> None:
        held = list(self._held)
        if not held:
            return
        arrivals = [h if "arrival" in h.columns else h.withColumn("arrival", F.monotonically_increasing_id()) for h in held]
        tagged = [h.withColumn("arrival", F.struct(F.lit(i).alias("i"), F.col("arrival").cast("long").alias("a"))) for i, h in enumerate(arrivals)]
        rows = number(reduce(DataFrame.unionByName, tagged), self.last + 1).checkpoint()
        n = rows.count()
        self._last_sync = time.monotonic()
        if n:
            written = f"commit-{uuid.uuid4().hex}"
            try:
                rows.withColumn("crc", row_crc()).select(*[c.split()[0] for c in LOG.split(", ")]).write.parquet(self.folder.at(written))
                self.folder.rename(written, f"log/{self.last + 1:020d}")
            except Exception:
                self.folder.delete(written)
                raise
            self.last += n
            self.commits += 1
        del self._held[: len(held)]

    def sync_if_due(self) -> bool:
        """Commit if something is held and the window since the last commit is over. Idle: no commit."""
        with self._lock:
            if self._held and time.monotonic() - self._last_sync >= self.window:
                self._commit()
                return True
            return False

    def log(self) -> DataFrame:
        return self._read([n for n, whole in self._commits() if whole])

    def reset(self) -> None:
        """Drop all log records. Their numbers are not given again."""
        with self._lock:
            self.folder.delete("log")

    # snapshots
    def _manifests(self) -> list[dict]:
        """Readable manifests of this node, newest first."""
        out = []
        for name, _ in sorted(self.folder.names(), reverse=True):
            if name.startswith("generation-") and name.endswith(".json"):
                try:
                    out.append(self._check(name, _MANIFEST))
                except StoreError:
                    if out or self._foreign(name):
                        raise
        return out

    def _foreign(self, name: str) -> bool:
        try:
            return json.loads(self.folder.read(name)).get("node") not in (None, self.node)
        except ValueError:
            return False

    def persist(self, state: DataFrame, members: list[int] | None = None, next_seq: int = 1, force: bool = False, acks: dict[int, int] | None = None) -> int | None:
        """A new generation, unless nothing was appended since the last (force: in any case). Then the log
        keeps only what the generation before it lacks. If the write fails, the log stays as it was."""
        with self._lock:
            if self._snapshotting:
                raise StoreError("a snapshot is being written")
            if not (self.dirty or force):
                return None
            self._commit()
            covered = self.last
            self._snapshotting = True
        try:  # appends go on meanwhile; their records lie behind what the manifest covers
            old = self._manifests()
            taken = [int(n.split("-")[1]) for n, _ in self.folder.names() if n.startswith("snapshot-")]
            generation = max([m["generation"] for m in old] + taken, default=0) + 1
            name = f"snapshot-{generation:012d}"
            state.select(*FIELDS).withColumn("value", F.col("value").cast("binary")).write.parquet(self.folder.at(name))
            rows = self._snapshot(name).count()
            manifest = _MANIFEST | {"node": self.node, "generation": generation, "rows": rows, "wal_last": covered, "members": members or [self.node], "next_seq": next_seq, "acks": acks or {}}
            self.folder.write(f"generation-{generation:012d}.json", json.dumps(manifest).encode())
            with self._lock:
                self.dirty = bool(self._held) or self.last > covered
                for m in old[1:]:
                    self.folder.delete(f"generation-{m['generation']:012d}.json")
                    self.folder.delete(f"snapshot-{m['generation']:012d}")
                self._trim(old[0]["wal_last"] if old else 0)
            return generation
        finally:
            self._snapshotting = False

    def _trim(self, low: int) -> None:
        names = [n for n, whole in self._commits() if whole]
        for name, following in zip(names, [*names[1:], None], strict=True):
            last = int(following) - 1 if following else self.last
            if last <= low:
                self.folder.delete(f"log/{name}")

    def _snapshot(self, name: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self.folder.at(name))

    def load(self, peers: list[int] | None = None) -> tuple[DataFrame, list[int], int]:
        """(state, members, next_seq): the newest generation that is whole, else the one before, else
        nothing; then the log behind it. peers: members where there is no generation. Sets acks: the
        coverage that the generation kept, without peers that were removed since."""
        base, members, floor, low, acks = self.spark.createDataFrame([], ENTRY), list(dict.fromkeys([self.node, *(peers or [])])), 1, 0, {}
        for m in self._manifests():
            name = f"snapshot-{m['generation']:012d}"
            try:
                found = self._snapshot(name)
                if found.select(F.count("key"), F.count("*").alias("n"), F.max("value")).first()["n"] != m["rows"]:
                    continue
            except Exception as e:  # damaged or missing files
                if not any(s in str(e) for s in ("parquet", "Parquet", "FAILED_READ_FILE", "PATH_NOT_FOUND")):
                    raise
                continue
            base, members, floor, low, acks = found, m["members"], m["next_seq"], m["wal_last"], {int(k): v for k, v in m.get("acks", {}).items()}
            break
        ops = self.log().filter(F.col("wal_seq") > low)
        gone = {r["peer_id"] for r in ops.filter("op = 'RemovePeer'").select("peer_id").distinct().collect()}  # a row a node at most
        self.acks = {n: a for n, a in acks.items() if n not in gone}
        own = base.filter(F.col("node") == self.node).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        return merge.replay(base, ops), replay_members(members, ops), replay_next_seq(ops, self.node, max(floor, own + 1)).first()["next_seq"]

    def close(self) -> None:
        with self._lock:
            if not self.closed:
                self._commit()
                self.closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def legacy_peers(members: DataFrame, acks: DataFrame, peer_acks: DataFrame, node: int) -> DataFrame:
    """(peer, local_ack, peer_ack) of the older container: every member, and every origin with an ack;
    peer_ack is what a member has covered of this node's entries (origins that are no members: 0)."""
    seen = peer_acks.filter(F.col("origin") == node).select(F.col("peer").alias("node_id"), F.col("ack").alias("_p"))
    m = members.select("node_id").distinct().join(seen, "node_id", "left").select(F.col("node_id").alias("peer"), F.coalesce("_p", F.lit(0)).alias("peer_ack"))
    a = acks.select(F.col("origin").alias("peer"), F.col("ack").alias("local_ack"))
    return m.join(a, "peer", "full").select("peer", F.coalesce("local_ack", F.lit(0)).alias("local_ack"), F.coalesce("peer_ack", F.lit(0)).alias("peer_ack"))


def from_legacy_peers(peers: DataFrame, logs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, acks): every row is a member; its ack is local_ack, raised by log entries that the peer
    itself wrote (logs: peer, node, seq)."""
    acks = peers.select(F.col("peer").alias("origin"), F.col("local_ack").alias("ack"))
    if logs is not None:
        acks = acks.unionByName(logs.filter("node = peer").join(peers.select("peer"), "peer", "left_semi").select(F.col("peer").alias("origin"), F.col("seq").alias("ack")))
    return peers.select(F.col("peer").alias("node_id")), acks.groupBy("origin").agg(F.max("ack").alias("ack"))
