"""Benchmark decontamination by SimHash windows of the items' sizes.

A window of as many words as an item gets a 64-bit SimHash of its shingles (five words; all words of a
shorter item), each weighted by how often it occurs. If two fingerprints differ in at most RADIUS =
8 * (ERRORS + 1) - 1 bits, one of their 8 bytes differs in at most ERRORS bits (pigeonhole), so items
are indexed under every byte within ERRORS bits of theirs, and all items within RADIUS of a window
are found. Those are confirmed by the exact weighted similarity of their shingles. A window without
any shingle of an item cannot be similar to it, so windows slide only where a shingle of some item is.

Items are the stated query set: they go to the tasks in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import map_arrow, stage
from ._text import LOWER, Rolling, Sequence, batch, blocks, distinct, mix, ranges, words

SHINGLE, ERRORS = 5, 2
RADIUS = 8 * (ERRORS + 1) - 1
_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32()), ("similarity", pa.float64())])
MATCH = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"


def _votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    raw = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1


def fingerprints(votes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """SimHash bytes (windows, 8) of runs of n shingles."""
    total = np.zeros((len(votes) + 1, 64), np.int32)
    np.cumsum(votes, axis=0, out=total[1:])
    return np.packbits(total[start + n] - total[start] > 0, axis=1)


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets as (sorted values, counts): what they share over what either has."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][x], b[1][y]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


#: All bytes by their number of bits; those of up to ERRORS bits are what a byte's error may be.
_ERRORS = np.array([x for x in range(256) if bin(x).count("1") <= ERRORS], np.uint8)


class MultiIndex:
    """Items by each byte of their fingerprints: eight sorted lists, so eight numbers an item."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.order = np.argsort(prints, axis=0, kind="stable").astype(np.int32)
        ranked = np.take_along_axis(prints, self.order, axis=0)
        self.begin = np.stack([np.searchsorted(ranked[:, k], np.arange(257)) for k in range(8)])

    def near(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS bits: every byte's list is looked up under all allowed errors."""
        found = []
        for k in range(8):
            value = (own[:, k, None] ^ _ERRORS[None]).astype(np.int64)
            lo, n = self.begin[k][value], self.begin[k][value + 1] - self.begin[k][value]
            window = np.repeat(np.repeat(np.arange(len(own)), len(_ERRORS)), n.ravel())
            found.append(window * len(self.prints) + self.order[ranges(lo.ravel(), n.ravel()), k])
        pair = distinct(np.concatenate(found))
        window, item = np.divmod(pair, len(self.prints))
        close = _BITS[own[window] ^ self.prints[item]].sum(1) <= RADIUS
        return window[close], item[close]


class Items:
    """Items by size, with their shingles and a multi-index. What it holds grows with the items' shingles
    (at most one a word), about forty bytes each, and with the items, about a hundred bytes each."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        by_size: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            s, e, _ = words(data, np.array([0, len(data)]))
            if n := len(s):
                g = min(n, SHINGLE)
                own = Sequence(Rolling(data).spans(s, e)).runs(np.arange(n - g + 1), g)
                by_size.setdefault(n, []).append((item_id, own))
        self.sizes = {}
        grams: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, items in by_size.items():
            prints = np.concatenate([fingerprints(_votes(x), np.array([0]), len(x)) for _, x in items])
            self.sizes[n] = ([i for i, _ in items], [np.unique(x, return_counts=True) for _, x in items], MultiIndex(prints))
            grams.setdefault(min(n, SHINGLE), []).append((n, distinct(np.concatenate([x for _, x in items]))))
        self.grams = {}
        for g, tables in grams.items():
            every, size = np.concatenate([x for _, x in tables]), np.concatenate([np.full(len(x), n, np.int32) for n, x in tables])
            order = np.lexsort((size, every))
            h, begin = np.unique(every[order], return_index=True)
            seen = np.zeros(1 << 20, bool)
            seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.grams[g] = (h, np.append(begin, len(every)), size[order], seen)

    def matches(self, h: np.ndarray, first: np.ndarray, similarity: float):
        """(text, item, start word, words, distance, similarity) of each item's best window in each text;
        h: hashes of the words of texts laid end to end, first: where texts begin, and the end."""
        starts: dict[tuple[int, int], set[int]] = {}
        seq = Sequence(h)
        runs = {}
        for g, (table, begin, sizes, seen) in self.grams.items():
            if len(h) < g:
                continue
            run = runs[g] = seq.runs(np.arange(len(h) - g + 1), g)
            at = np.flatnonzero(seen[(run & np.uint64((1 << 20) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(table, run[at]), len(table) - 1)
            at, k = at[table[k] == run[at]], k[table[k] == run[at]]
            text = np.searchsorted(first, at, "right") - 1
            ok = at + g <= first[text + 1]
            for p, x, d in zip(at[ok].tolist(), k[ok].tolist(), text[ok].tolist(), strict=True):
                for n in sizes[begin[x] : begin[x + 1]].tolist():
                    lo, hi = max(int(first[d]), p + g - n), min(p, int(first[d + 1]) - n)
                    starts.setdefault((d, n), set()).update(range(lo, hi + 1) if hi >= lo else [int(first[d])])
        for (d, n), found in sorted(starts.items()):
            ids, counts, index = self.sizes[n]
            g = min(n, SHINGLE)
            m = min(n, int(first[d + 1] - first[d])) - g + 1  # a text shorter than the item is one window
            s = np.array(sorted(found))
            low = int(s[0])
            shingles = runs[g][low : int(s[-1]) + m]
            own = fingerprints(_votes(shingles), s - low, m)
            best: dict[int, tuple] = {}
            held, window = -1, None
            for w, i in zip(*(x.tolist() for x in index.near(own)), strict=True):
                if i in best and best[i][0] == -1.0:
                    continue
                at = int(s[w])
                if w != held:
                    held, window = w, np.unique(shingles[at - low : at - low + m], return_counts=True)
                value = weighted_similarity(counts[i], window)
                if value >= similarity and (i not in best or (-value, at) < best[i][:2]):
                    best[i] = (-value, at, int(_BITS[own[w] ^ index.prints[i]].sum()))
            for i, (value, at, distance) in sorted(best.items()):
                yield d, ids[i], at - int(first[d]), m + g - 1, distance, -value


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, block_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: one row for each document and benchmark
    item that some window of the document is similar to (its most similar window, the first of equal
    ones). Documents that leak nothing have no row. Null and empty texts and items match nothing; null
    ids are kept as null; of repeated item ids every text counts; repeated rows of docs match each for
    itself; other columns are left out. block_bytes: about how many bytes of items one pass sends to the
    tasks (its index has about one and a half times as many bytes, see Items); a larger benchmark takes
    several passes, one index at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes, out = max(1, -(-size // block_bytes)), None
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        got = map_arrow(docs, _matcher(Items([(r["item_id"], r["text"]) for r in part.collect()]), similarity), MATCH)
        if passes > 1:  # one index at a time: its matches are written before the next is made
            got = stage(got, "matches")
        out = got if out is None else out.unionByName(got)
    return out


def _matcher(index: Items, similarity: float):
    def run(b):
        for i, j, data, offs in blocks(b.column(1)):
            data = LOWER[data]
            s, e, first = words(data, offs)
            if len(s) and (found := list(index.matches(Rolling(data).spans(s, e), first, similarity))):
                text, *rest = zip(*found, strict=True)
                yield batch(_MATCH, b.column(0).take(pa.array(i + np.array(text))), *rest)

    return run


def op4(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("hamming")  # of the method, not of the texts
