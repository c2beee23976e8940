"""Removal of repeated byte spans, by interval expansion on a Burrows-Wheeler transform.

Which texts to compare. Every window of `least` bytes has an anchor: the leftmost smallest hash among
its grams of GRAM bytes. Equal windows have equal anchors at equal places, so only contexts (the
bytes that an anchor's windows cover) with the same anchor need comparing. Contexts
that are equal as a whole are settled by their smallest position, by aggregation, and only one of
each goes on; so a text copied a million times is compared once.

Where very many contexts share an anchor, their windows are told apart by longer anchors (see
repeated_spans), so no comparison grows with the corpus.

Comparing. Many contexts are laid end to end in one array. Its suffixes are sorted to the depth that
matters, and from the transform intervals of strings of length 0, 1, 2, ... are extended backwards by
one byte, breadth first: a right border that is reached for the first time at length l has a common
prefix of l with its neighbour. The expansion stops at `least`; borders that are still unset join
suffixes that share a prefix of `least` bytes or more."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import map_arrow, stage
from ._text import Rolling, batch, blocks, mix, ranges, whole_runs

LEAST, GRAM = 100, 24
_ANCHORS = pa.schema([("hash", pa.int64()), ("ctx", pa.int64()), ("o", pa.int64()), ("at", pa.int64()), ("settled", pa.bool_())])
ANCHORS = "hash long, ctx long, o long, at long, settled boolean"
_SPANS = pa.schema([("o", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def anchors(data: np.ndarray, offs: np.ndarray, least: int, gram: int = GRAM):
    """(text, where the anchor's windows begin in it, bytes that they cover, where the anchor is in those, its hash,
    the bytes' hash)."""
    n, reach = len(data), least - gram + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none, none, none
    rolling = Rolling(data)
    p = np.arange(n - gram + 1)
    h = rolling.spans(p, p + gram)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | p.astype(np.uint64)
    width, best = 1, low
    while width * 2 <= reach:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if reach > width:
        best = np.minimum(best[: len(best) - (reach - width)], best[reach - width :])
    inside = np.zeros(n + 1, np.int64)  # windows that end in their text
    size = np.diff(offs)
    long_ = size >= least
    np.add.at(inside, offs[:-1][long_], 1)
    np.add.at(inside, offs[1:][long_] - least + 1, -1)
    own = np.flatnonzero(np.cumsum(inside)[: len(best)] > 0)
    if not len(own):
        return none, none, none, none, none, none
    place = (best[own] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    place, start, end = place[edge], own[edge], own[np.append(edge[1:], len(own)) - 1] + least
    text = np.searchsorted(offs, place, "right") - 1
    ctx = rolling.spans(start, end) ^ mix((place - start).astype(np.uint64))
    return text, start - offs[text], end - start, place - start, h[place].view(np.int64), ctx.view(np.int64)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s (symbols under 512) in the order of their first `depth` symbols."""
    n = len(s)
    pad = np.append(s.astype(np.int64), np.zeros(7, np.int64))
    first = np.zeros(n, np.int64)
    for k in range(7):
        first = first << 9 | pad[k : k + n]
    order = np.argsort(first)
    same = np.append(False, first[order][1:] == first[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    k, tied = 7, order[same | np.append(same[1:], False)]
    while k < depth and len(tied):
        after = np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)], -1)
        key = rank[tied] * (n + 1) + after + 1
        o = np.argsort(key)
        tied, key = tied[o], key[o]
        old = rank[tied]
        at = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        same = np.append(False, key[1:] == key[:-1])
        rank[tied] = old + np.maximum.accumulate(np.where(same, 0, at)) - begin
        tied = tied[same | np.append(same[1:], False)]
        k *= 2
    return np.argsort(rank, kind="stable")


def unset_borders(s: np.ndarray, array: np.ndarray, least: int) -> np.ndarray:
    """For each rank, whether its common prefix with the rank before is `least` or more, for suffixes
    whose first `least` symbols hold no separator (symbol 0)."""
    n = len(s)
    bwt = s[array - 1]
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n - 1])
    owner = np.full(n, -1, np.int64)
    for _ in range(least):
        if not len(lo):
            break
        size = hi - lo + 1
        rows = ranges(lo, size)
        of = np.repeat(np.arange(len(lo)), size)
        real = bwt[rows] != 0
        rows, of = rows[real], of[real]
        owner[lf[rows]] = of  # the rows of one symbol and interval stay in order, side by side
        to = np.sort(lf[rows])
        if not len(to):
            break
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (bwt[order[to[1:]]] != bwt[order[to[:-1]]])
        begin = np.flatnonzero(new)
        lo, hi = to[begin], to[np.append(begin[1:], len(to)) - 1]
        fresh = unset[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        unset[hi + 1] = False
    return unset[:n]


def repeats(contexts: list[np.ndarray], doc: np.ndarray, start: np.ndarray, least: int):
    """(doc, start, end) spans of the contexts that are covered by windows which also start earlier in
    another of them. doc, start: where each context lies."""
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    s = np.zeros(int((size + 1).sum()), np.uint16)
    s[ranges(begin, size)] = np.concatenate(contexts).astype(np.uint16) + 1
    array = suffix_array(s, least)
    joined = unset_borders(s, array, least)
    which = np.searchsorted(begin, array, "right") - 1
    ok = array + least <= begin[which] + size[which]
    group = np.cumsum(~joined)[ok]
    array, which = array[ok], which[ok]
    if not len(array):
        return np.zeros((3, 0), np.int64)
    _, rank = np.unique(doc, return_inverse=True)
    where = (rank[which] << 40) + start[which] + array - begin[which]
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(np.minimum.reduceat(where, edge), np.diff(np.append(edge, len(group))))
    later = array[where > first]
    depth = np.zeros(len(s) + 1, np.int64)
    np.add.at(depth, later, 1)
    np.add.at(depth, later + least, -1)
    covered = np.append(False, np.cumsum(depth) > 0)  # one place to the right; the last symbol is a separator
    on = np.flatnonzero(covered[1:] & ~covered[:-1])
    off = np.flatnonzero(covered[:-1] & ~covered[1:])
    w = np.searchsorted(begin, on, "right") - 1
    return np.stack([doc[w], start[w] + on - begin[w], start[w] + off - begin[w]])


def numbered(docs: DataFrame) -> DataFrame:
    """(o, text, row): a number of its own for each row, in the order of doc_id; its text (null: empty); and
    all columns of docs as one struct, so that no name can clash. Where ids are unique and never null, the
    number is doc_id itself; else rows are numbered by doc_id (null last) and a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("o"), F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))
    if rows.groupBy("o").count().filter("count > 1 or o is null").isEmpty():
        return rows
    order = [F.col("o").isNull(), F.col("o"), F.xxhash64("text")]
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("o", F.monotonically_increasing_id()), "numbered")


class _At:
    """Where a context lies in its text, in one number: its start, its size over `least`, and its anchor's place."""

    def __init__(self, least: int):
        self.least, self.bits = least, least.bit_length() + 1

    def pack(self, start, size, place):
        return start << 2 * self.bits | size - self.least << self.bits | place

    def columns(self):
        """s, e and p (the anchor's place) of a column `at`."""
        low = (1 << self.bits) - 1
        s = F.shiftright("at", 2 * self.bits)
        return s.alias("s"), (s + F.shiftright("at", self.bits).bitwiseAND(low) + self.least).alias("e"), F.col("at").bitwiseAND(low).alias("p")


def _anchor_rows(at_of: _At, find, carry: bool):
    """A map over batches to ANCHORS, with the context's bytes if they are to be carried. find(batch) gives
    (o, start, size, place, hash, ctx) arrays and a function from rows to contexts. Of equal contexts in a batch
    only the first goes on: the others start later, so they are settled, and travel under keys of
    their own. So a hot context is one row a batch."""
    schema = pa.schema([*_ANCHORS, ("context", pa.binary())]) if carry else _ANCHORS

    def run(b):
        for o, start, size, place, h, ctx, bytes_of in find(b):
            at, again = at_of.pack(start, size, place), np.zeros(len(h), bool)
            order = np.argsort(ctx)
            same = ctx[order][1:] == ctx[order][:-1]
            twice = order[np.append(same, False) | np.append(False, same)] if len(order) else order
            twice = twice[np.lexsort((at[twice], o[twice], ctx[twice]))]
            again[twice[1:][ctx[twice][1:] == ctx[twice][:-1]]] = True
            own = mix((o ^ at << 20).view(np.uint64)).view(np.int64)
            more = [bytes_of(np.arange(len(h)))] if carry else []
            yield batch(schema, np.where(again, own, h), ctx, o, at, again, *more)

    return run


def _settle(every: DataFrame, at_of: _At):
    """(spans of contexts that are equal to an earlier one, the first of each of the others that share their
    anchor: hash, o, s, e, p, and context where it is carried)."""
    more = [c for c in every.columns if c == "context"]
    met = every.withColumn("n", F.count("*").over(W.partitionBy("hash"))).filter("n > 1 or settled").drop("n")
    met = stage(met, "anchors")
    first = met.filter("not settled").groupBy("hash", "ctx").agg(F.min(F.struct("o", "at")).alias("f"), *[F.first(c).alias(c) for c in more])
    first = stage(first.select("hash", "ctx", F.col("f.o").alias("o"), F.col("f.at").alias("at"), *more), "contexts")
    s, e, p = at_of.columns()
    earlier = first.select("hash", "ctx", F.col("o").alias("o1"), F.col("at").alias("at1"))
    copies = met.filter("not settled").select("hash", "ctx", "o", "at").join(earlier, ["hash", "ctx"]).filter("o <> o1 or at <> at1")
    copies = copies.select("o", "at").unionByName(met.filter("settled").select("o", "at"))
    return copies.select("o", s, e), first.select("hash", "o", s, e, p, *more)


def _shared_part(hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, least: int, gram: int):
    """(begin, size) of what of each context may have a window in common with another one of its hash; size 0
    where nothing may. A window reaches `half` bytes to one side of its anchor at least, so without a
    partner for those bytes on a side, only windows that reach less far there are left."""
    half = -(-(least - gram) // 2)
    rolling, at, end = Rolling(data), begin + place, begin + size
    lo, hi = begin.copy(), end - least  # first and last start of a window
    for a, z, left in ((at - half, at, True), (at + gram, at + gram + half, False)):
        alone = np.ones(len(begin), bool)
        inside = np.flatnonzero((a >= begin) & (z <= end))
        key = rolling.spans(a[inside], z[inside]) ^ mix(hashes[inside].view(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        if len(order):
            alone[inside[order[np.append(same, False) | np.append(False, same)]]] = False
        if left:
            lo = np.where(alone, np.maximum(lo, at - half + 1), lo)
        else:
            hi = np.where(alone, np.minimum(hi, at + gram + half - least - 1), hi)
    return lo, np.where(hi >= lo, hi + least - lo, 0)


def _compare(rows: DataFrame, least: int, gram: int, load: int) -> DataFrame:
    """Spans among rows (hash, o, s, p, context) of one hash each that start earlier in another of them."""

    def compare(batches):
        for b, at in whole_runs(batches, 1):
            hashes, o, s, p = (np.asarray(b.column(k)) for k in range(4))
            c = b.column(4).cast(pa.large_binary())
            offs = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
            data, offs = np.frombuffer(c.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]
            begin, size = _shared_part(hashes, data, offs[:-1], np.diff(offs), p, least, gram)
            total, i = np.append(0, np.cumsum(size)), 0
            while i < len(at) - 1:  # runs of about `load` bytes together
                j = max(i + 1, int(np.searchsorted(total[at], total[at[i]] + load, "right")) - 1)
                k = at[i] + np.flatnonzero(size[at[i] : at[j]])
                if len(k) > 1:
                    found = repeats([data[x : x + n] for x, n in zip(begin[k].tolist(), size[k].tolist(), strict=True)], o[k], s[k] + begin[k] - offs[k], least)
                    if found.shape[1]:
                        yield batch(_SPANS, *found)
                i = j

    return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(compare, "o long, s long, e long")


def repeated_spans(docs: DataFrame, least: int = LEAST, most: int = 1 << 12, load: int = 1 << 20) -> DataFrame:
    """(o, s, e): bytes s to e-1 of text o are covered by strings of `least` bytes that start earlier too.
    docs: (o, text). Spans may overlap.

    most: different contexts that one comparison takes. An anchor that more of them share is split by
    anchors of longer grams (twice the length, three times, ... up to `least` bytes), which equal windows
    share as well; a gram of `least` bytes is a whole window, whose contexts are all equal, so nothing is
    left to compare. load: bytes that a task compares at once."""
    at_of = _At(least)
    docs = docs.select("o", "text")

    def of_texts(b):
        for i, _, data, offs in blocks(b.column(1)):
            text, *rest = anchors(data, offs, least)
            yield np.asarray(b.column(0))[i + text], *rest, None

    every = map_arrow(docs, _anchor_rows(at_of, of_texts, False), ANCHORS)
    out, gram = None, GRAM
    while True:
        spans, first = _settle(every, at_of)
        several = first.groupBy("hash").agg(F.count("*").alias("d")).filter("d > 1")
        shared = first.join(several, "hash").withColumn("hot", F.col("d") > most)
        if gram == GRAM:  # the bytes are fetched once; those of longer grams lie in them
            asked = shared.select("o", F.struct("hash", "s", "e", "p", "hot").alias("x")).groupBy("o").agg(F.collect_list("x").alias("x"))  # one a place of a text at most
            got = map_arrow(docs.join(asked, "o"), _cut, "hash long, o long, s long, p long, context binary, hot boolean")
        else:
            got = shared.select("hash", "o", "s", "p", "context", "hot")
        got = stage(got, "bytes")
        spans = spans.unionByName(_compare(got.filter("not hot").select("hash", "o", "s", "p", "context"), least, gram, load))
        out = spans if out is None else out.unionByName(spans)
        hot = got.filter("hot").select("o", "s", "context")
        if gram >= least or hot.isEmpty():
            return out
        gram = min(least, gram + GRAM)
        every = map_arrow(hot, _anchor_rows(at_of, _of_contexts(least, gram), True), ANCHORS + ", context binary")


_CONTEXT = pa.schema([("hash", pa.int64()), ("o", pa.int64()), ("s", pa.int64()), ("p", pa.int64()), ("context", pa.binary()), ("hot", pa.bool_())])


def _cut(b):
    for k, (o, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
        raw, rows = text.as_py().encode(), b.column(2)[k].as_py()
        yield batch(_CONTEXT, *zip(*((x["hash"], o, x["s"], x["p"], raw[x["s"] : x["e"]], x["hot"]) for x in rows), strict=True))


def _of_contexts(least: int, gram: int):
    def find(b):
        c = b.column(2).cast(pa.large_binary())
        offs = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data = np.frombuffer(c.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        which, start, size, place, h, ctx = anchors(data, offs - offs[0], least, gram)
        at = offs[which] - offs[0] + start

        def bytes_of(rows):
            size_of = np.append(0, np.cumsum(size[rows])).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(size_of), pa.py_buffer(data[ranges(at[rows], size[rows])].tobytes())])

        yield np.asarray(b.column(0))[which], np.asarray(b.column(1))[which] + start, size, place, h, ctx, bytes_of

    return find


def remove_repeats(docs: DataFrame, least: int = LEAST, **options) -> DataFrame:
    """docs with text cut (characters that a cut broke are dropped from it), and n_bytes, n_removed, n_spans
    and kept_sha256 (of the remaining bytes). One row a row; a null text is empty. Rows with equal doc_id
    count as documents in the order of a hash of their text; a null doc_id comes last. Columns of docs by
    the new names are replaced, all others stay, whatever their names. options: see repeated_spans."""
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*made)
    rows = numbered(docs)
    spans = repeated_spans(rows, least, **options).groupBy("o").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    joined = rows.join(spans, "o", "left").select("row", "text", "x")

    def cut(b):
        out = []
        for text, x in zip(b.column(1), b.column(2), strict=True):
            raw = text.as_py().encode()
            n, runs = len(raw), 0
            if x.is_valid:
                parts, begin, end = [], 0, -1
                for s, e in sorted((y["s"], y["e"]) for y in x.as_py()):
                    if s > end:
                        parts.append(raw[begin:s])
                        runs += 1
                    begin = end = max(end, e)
                raw = b"".join([*parts, raw[begin:]])
            out.append((raw.decode("utf-8", "ignore"), n, n - len(raw), runs, hashlib.sha256(raw).hexdigest()))
        text, *rest = zip(*out, strict=True)
        columns = [b.column(0), pa.array(text, pa.string()), *(pa.array(r, pa.int64()) for r in rest[:3]), pa.array(rest[3], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "text", *made])

    more = [T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in made[:3]), T.StructField(made[3], T.StringType())]
    out = map_arrow(joined, cut, T.StructType([joined.schema["row"], *more]))
    kept = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*kept, *made)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("text")
