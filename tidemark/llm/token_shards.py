"""Token files compressed by Re-Pair grammars, one for each shard, with random access.

Documents in ascending doc_id order are encoded, an end id is put after each, and runs of documents
become shards. In a shard the most frequent pairs of neighbouring symbols are replaced by new
symbols (nonterminals), again and again, until no pair occurs LEAST_PAIRS times. Pairs never cross a document's
end, so each document begins at a symbol of its own. A shard stores its rules, the expansion length
of every rule, and for each document its first symbol and its first id, so any span of ids of any
document is decoded from the symbols that cover it alone.

File format: a table of shards (part int, shard int, n_docs long, n_tokens long, payload binary),
written by Spark's own committed writer to the shared folder, so lost executors leave no half files.
The payload is laid out by `encode_shard`."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._bpe import Encoder, with_end
from ._io import stage
from ._text import batch, blocks, ranges

#: A pair is frequent if it occurs so often: a rule takes 12 bytes, and each use of it saves 2 or 4.
LEAST_PAIRS = 8
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIII")  # magic, first nonterminal, documents, rules, symbols, bytes a symbol
_FILES = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
_DOCS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class Pairs:
    """A sequence in place, with links over what was taken out, and its frequent pairs of neighbours.

    All occurrences of a pair come up in one round, that in which the younger of its symbols is made, and
    then only get fewer. So a pair that is too rare then never needs another look, and a round costs no
    more than the places that it changes."""

    def __init__(self, symbols: np.ndarray, firsts: np.ndarray, least: int):
        n = len(symbols)
        self.s, self.least = symbols.astype(np.uint32), least
        self.next, self.prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.last, self.out = np.zeros(n, bool), np.zeros(n, bool)  # last of its document; taken out
        self.last[firsts[1:][firsts[1:] > firsts[:-1]] - 1] = True
        self.of = np.full(n, -1, np.int32)  # number of the pair that begins here
        self.places, self.used = np.empty(3 * n, np.int32), 0  # of each pair; a replacement adds two at most
        self.begin, self.size, self.count, self.pair = (np.zeros(0, np.int64) for _ in range(4))
        self.top, self.place_bits = int(symbols.max(initial=0)), max(1, n.bit_length())
        self._add(np.flatnonzero(~self.last).astype(np.int32))

    def _add(self, at: np.ndarray) -> None:
        """Number the frequent ones among the pairs that begin at these places, none of them last."""
        bits = max(1, self.top.bit_length())
        key = self.s[at].astype(np.uint64)
        key <<= np.uint64(bits)
        key |= self.s[self.next[at]]
        if 2 * bits + self.place_bits <= 64:  # pair and place in one number sort faster than by reference
            key <<= np.uint64(self.place_bits)
            key |= at.astype(np.uint64)
            key.sort()
            at = (key & np.uint64((1 << self.place_bits) - 1)).astype(np.int32)
            key >>= np.uint64(self.place_bits)
        else:
            order = np.argsort(key)
            at, key = at[order], key[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(key)))
        often = size >= self.least
        at = at[np.repeat(often, size)]
        edge, size = edge[often], size[often]
        left = (key[edge] >> np.uint64(bits)).astype(np.int64)
        self.pair = np.append(self.pair, left << 32 | (key[edge] & np.uint64((1 << bits) - 1)).astype(np.int64))
        self.of[at] = np.repeat(np.arange(len(self.size), len(self.size) + len(size), dtype=np.int32), size)
        self.places[self.used : self.used + len(at)] = at
        self.begin = np.append(self.begin, self.used + np.cumsum(size) - size)
        self.size, self.count = np.append(self.size, size), np.append(self.count, size)
        self.used += len(at)

    def replace(self, symbol: int) -> np.ndarray:
        """One round: the pairs with more than half the count of the top one become symbol, symbol + 1, ...
        Where occurrences overlap, every second one from the left of the run is replaced. The pairs, as
        (n, 2); none where no pair is frequent any more."""
        top = int(self.count.max(initial=0))
        if top < self.least:
            return np.zeros((0, 2), np.int64)
        chosen = np.flatnonzero(self.count >= max(self.least, top // 2 + 1))
        hits, own = self.places[ranges(self.begin[chosen], self.size[chosen])], np.repeat(chosen, self.size[chosen])
        still = self.of[hits] == own
        hits = np.sort(hits[still])
        fresh = np.append(True, self.next[hits[:-1]] != hits[1:])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run) & 1 == 0]
        second, before = self.next[hits], self.prev[hits]
        which = np.flatnonzero(np.bincount(self.of[hits], minlength=len(self.count)))
        number = np.zeros(len(self.count), np.uint32)
        number[which] = np.arange(symbol, symbol + len(which))
        number = number[self.of[hits]]
        rules = np.stack([self.pair[which] >> 32, self.pair[which] & 0xFFFFFFFF], axis=1)
        self.top = max(self.top, symbol + len(which))
        for changed in (hits, second, before[before >= 0]):  # a place may be in two of them, and counts in the first
            own = self.of[changed]
            self.count -= np.bincount(own[own >= 0], minlength=len(self.count))
            self.of[changed] = -1
        self.s[hits] = number
        self.out[second] = True
        self.last[hits] = self.last[second]
        after = self.next[second]
        self.next[hits] = after
        inside = after < len(self.s)
        self.prev[after[inside]] = hits[inside]
        before = self.prev[hits]
        before = before[before >= 0]
        before = before[self.s[before] < symbol]  # the others are hits too
        at = np.concatenate([hits, before])
        self._add(at[~self.last[at]])
        return rules


def repair(symbols: np.ndarray, firsts: np.ndarray, base: int, least: int = LEAST_PAIRS):
    """(symbols, firsts, rules): pairs replaced by nonterminals base, base+1, ..., the most frequent ones
    first, until no pair of neighbours occurs `least` times. firsts: where documents begin, and the end."""
    firsts = firsts.astype(np.int64)
    pairs, rules = Pairs(symbols, firsts, least), [np.zeros((0, 2), np.int64)]
    made = 0
    while len(found := pairs.replace(base + made)):
        rules.append(found)
        made += len(found)
    gone = np.append(0, np.cumsum(pairs.out))
    return pairs.s[~pairs.out], firsts - gone[firsts], np.concatenate(rules).astype(np.uint32)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule uses earlier rules only."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < base else out[a - base]) + (1 if b < base else out[b - base]))
    return np.array(out, np.uint32)


def encode_shard(doc_ids: list, ids: np.ndarray, at: np.ndarray) -> bytes:
    """header, rules, their lengths, doc ids with a null mask, first symbol and first id of each
    document (one more than documents), symbols (2 bytes each where they fit, else 4)."""
    base = int(ids.max()) + 1 if len(ids) else 1
    s, firsts, rules = repair(ids, at, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    known = np.array([d is not None for d in doc_ids], np.uint8)
    number = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [_HEAD.pack(MAGIC, base, len(doc_ids), len(rules), len(s), width), rules.astype("<u4"), rule_lengths(rules, base).astype("<u4"), number, known, firsts.astype("<i8"), at.astype("<i8"), s.astype("<u2" if width == 2 else "<u4")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A shard's payload, read without decoding it."""

    def __init__(self, payload: bytes):
        magic, self.base, docs, rules, symbols, width = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            x = np.frombuffer(payload, kind, n, at)
            at += x.nbytes
            return x

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        number, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(number, known, strict=True)]
        self.firsts, self.at = take("<i8", docs + 1), take("<i8", docs + 1)
        self.symbols = take("<u2" if width == 2 else "<u4", symbols)

    def expand(self, s: np.ndarray) -> np.ndarray:
        """Symbols to ids. Rule lengths say where everything goes, so each pass only handles what is still open."""
        s = s.astype(np.int64)
        size = self.sizes(s)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        rules, lengths = self.rules.astype(np.int64), np.concatenate([[1], self.lengths])  # a plain id has length 1
        while len(s):
            done = s < self.base
            out[at[done]] = s[done]
            at, pair = at[~done], rules[s[~done] - self.base]
            s = pair.T.ravel()
            at = np.concatenate([at, at + lengths[np.maximum(pair[:, 0] - self.base + 1, 0)]])
        return out

    def sizes(self, s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), np.int64)
        big = s >= self.base
        out[big] = self.lengths[s[big] - self.base]
        return out

    def span(self, doc: int, start: int, end: int) -> np.ndarray:
        """Ids start to end-1 of the doc-th document: only symbols that cover them are expanded."""
        s = self.symbols[self.firsts[doc] : self.firsts[doc + 1]]
        ends = np.cumsum(self.sizes(s))
        lo = int(np.searchsorted(ends, start, "right"))
        hi = int(np.searchsorted(ends, end, "left")) + 1
        skip = int(ends[lo - 1]) if lo else 0
        return self.expand(s[lo:hi])[start - skip : end - skip]


def write_shards(docs: DataFrame, end_id: int = 0, path: str = VOCABULARY, tokens: int = 1 << 20) -> DataFrame:
    """The written table of shards. docs needs doc_id and text; a null text is empty; null ids come
    first; rows with equal ids are ordered by a hash of their text. tokens: ids after which a shard
    is closed; a longer document is a shard of its own."""
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
    ranged = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def run(batches):
        from pyspark import TaskContext

        part, n, coder = TaskContext.get().partitionId(), 0, Encoder.of(path)
        doc_ids: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close():
            nonlocal n, doc_ids, held, sizes
            ids, at = np.concatenate(held), np.append(0, np.cumsum(np.concatenate(sizes)))
            yield batch(_FILES, [part], [n], [len(doc_ids)], [len(ids)], [encode_shard(doc_ids, ids, at)])
            n, doc_ids, held, sizes = n + 1, [], [], []

        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                ids, at = with_end(*coder.encode(data, offs), end_id)
                doc_ids += b.column(0).slice(i, j - i).to_pylist()
                held.append(ids)
                sizes.append(np.diff(at))
                if sum(map(len, held)) >= tokens:
                    yield from close()
        if doc_ids:
            yield from close()

    return stage(ranged.mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, payload binary"), "tokens")


def read_shards(files: DataFrame) -> DataFrame:
    """part, shard, doc_id, _start (in its shard), n_tokens, ids_crc32: from the decoded ids."""

    def run(batches):
        for b in batches:
            for part, n, payload in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("payload"), strict=True):
                x = Shard(payload.as_py())
                raw = memoryview(np.ascontiguousarray(x.expand(x.symbols), "<u4")).cast("B")
                at = x.at.tolist()
                crc = [zlib.crc32(raw[4 * p : 4 * q]) for p, q in zip(at, at[1:], strict=False)]
                k = len(crc)
                yield batch(_DOCS, np.full(k, part), np.full(k, n), x.doc_ids, x.at[:-1], np.diff(x.at), crc)

    return files.mapInArrow(run, "part int, shard int, doc_id long, _start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as its shard's file holds it; start counts
    the ids of all documents before it. No rows give no rows; repeated rows stay."""
    files = write_shards(docs, **options)
    by_part = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = by_part.withColumn("_before", F.sum("_n").over(W.orderBy("part")) - F.col("_n")).drop("_n")  # a row a partition
    inside = files.select("part", "shard", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("_in"))
    base = inside.join(parts, "part").select("part", "shard", (F.col("_before") + F.col("_in")).alias("_base"))
    return read_shards(files).join(base, ["part", "shard"]).select("doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def op3(spark, sf_dir: str) -> DataFrame:
    return token_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
