"""Packing of token pieces into sequences of fixed length, by minimum bin slack.

For each bin, subset sums over the lengths that are left, kept as bits of one integer, give the
fullest combination, which is then taken out. A bin's choice depends on how many pieces of each
length are left, and on nothing else; so it is made on the table of counts by length (at most
`capacity` rows, whatever the corpus), and the same choice is taken as many times at once as the
counts allow. Pieces then find their places by their number among those of their length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._bpe import Encoder, with_end
from ._io import stage
from ._text import batch, blocks

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_part", pa.int64()), ("_nth", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part long, _nth long, ids binary"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of the fullest combination within room; of equal ones, that with the longest pieces.

    reach[i] holds, as bits, the sums that the i longest lengths can make. At most as many of a
    length are offered as fit."""
    lengths = sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True)
    mask, reach, best = (1 << (room + 1)) - 1, [1], 0
    for n in lengths:
        bits, left, step = reach[-1], min(counts[n], room // n), 1
        while left:  # doubling: 1, 2, 4, ... copies
            k = min(step, left)
            bits |= (bits << (n * k)) & mask
            left -= k
            step *= 2
        reach.append(bits)
        best = bits.bit_length() - 1
        if best == room:
            break
    out, at = [], best
    for i in range(len(reach) - 1, 0, -1):
        n = lengths[i - 1]
        while not reach[i - 1] >> at & 1:
            out.append(n)
            at -= n
    return sorted(out, reverse=True)


def min_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, how many such bins), until no piece is left.

    Each bin starts with the longest piece that is left (its slack is the smallest that any bin with
    it can have), filled by the fullest combination of the rest."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        chosen = [first, *fullest(left, capacity - first)]
        left[first] += 1
        need: dict[int, int] = {}
        for n in chosen:
            need[n] = need.get(n, 0) + 1
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((chosen, times))
    return out


def pieces(docs: DataFrame, capacity: int, end_id: int, path: str, keep_ids: bool) -> DataFrame:
    """One row a piece: only documents longer than capacity are cut, and the first piece is the short one."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        coder = Encoder.of(path)
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                ids, at = with_end(*coder.encode(data, offs), end_id)
                total = np.diff(at)
                many = -(-total // capacity)
                doc = np.repeat(np.arange(i, j), many)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                short = total - capacity * (many - 1)
                start = np.where(nth == 0, 0, short[doc - i] + (nth - 1) * capacity)
                length = np.where(nth == 0, short[doc - i], capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked)
                number += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                cut = [raw[4 * x : 4 * y] for x, y in zip((at[doc - i] + start).tolist(), (at[doc - i] + start + length).tolist(), strict=True)]
                crc = [zlib.crc32(c) for c in cut]
                kept = pa.array([c.tobytes() for c in cut], pa.binary()) if keep_ids else pa.nulls(len(cut), pa.binary())
                yield batch(_PIECES, b.column(0).take(pa.array(doc)), nth, start, length, crc, np.full(len(doc), part), number, kept)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian, if asked).

    docs needs doc_id and text; other columns are left out. A null or empty text is the end id alone;
    a null doc_id stays null; repeated rows are packed each for itself. No rows give no rows.
    The pieces are written once to the shared folder. The driver sees counts by length (at most
    `capacity` rows) and the bins made of them."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, capacity, end_id, path, keep_ids), "pieces")
    counted = cut.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    bins = min_bin_slack(counts, capacity)
    used: dict[int, int] = {}
    table, first = [], 0
    for chosen, times in bins:
        at = 0
        for n in dict.fromkeys(chosen):
            k = chosen.count(n)
            table.append((n, used.get(n, 0), first, k, at))
            used[n] = used.get(n, 0) + k * times
            at += k * n
        first += times
    cols = np.array(sorted(table), np.int64).reshape(-1, 5).T  # by length, then the first number
    lows, highs = np.searchsorted(cols[0], np.arange(capacity + 1)), np.searchsorted(cols[0], np.arange(capacity + 1), "right")
    _, froms, bases, ks, ats = cols
    out_schema = pa.schema([*[_PIECES.field(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")], ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def place(b):
        length, nth = np.asarray(b.column("length")), np.asarray(b.column("_at"))
        lo, hi = lows[length], highs[length]
        while (open_ := hi - lo > 1).any():  # the last row of that length whose first number is not above
            mid = (lo + hi) // 2
            up = froms[mid] <= nth
            lo, hi = np.where(open_ & up, mid, lo), np.where(open_ & ~up, mid, hi)
        i = nth - froms[lo]
        yield batch(out_schema, *[b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")], bases[lo] + i // ks[lo], ats[lo] + i % ks[lo] * length, b.column("ids"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from place(b)

    before = counted.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    numbered = cut.join(before, ["_part", "length"]).withColumn("_at", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
    out = numbered.mapInArrow(run, schema)
    return out if keep_ids else out.drop("ids")


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
