"""Quality rules on repetition, from a suffix array over the words of each text.

Suffixes are sorted by prefix doubling (only groups that are still tied are sorted again), with the
text's number as the first sort key, so a block of many texts is one array and no match crosses
texts. Common prefixes of neighbours follow from the kept ranks. The largest common-prefix interval
that holds a suffix has its larger neighbouring value; the union of those spans is the union of all
maximal repeated substrings.

The base rule counts words in repeated windows of eight words, which is the same union from eight
words on. So the verdict of the suffix array takes in shorter repeats as well, and the share of the
text that its longest repeat has: words said over and over in short runs, and a run that overlaps itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import map_arrow
from ._text import Rolling, Sequence, batch, blocks, mix, words

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64())])
#: What only the verdict needs.
_VERDICT = pa.schema([("_covered", pa.int64()), ("_longest", pa.int64())])


def longest_repeats(symbols: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lengths): for each position whose suffix shares a prefix of `least` symbols or more
    with another suffix of the same text, the longest such prefix. bounds: where texts begin, and the end."""
    n = len(symbols)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][text] if n else np.zeros(0, np.int64)
    order = np.lexsort((symbols, text))
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [rank], 1
    tied = order[~new | ~np.append(new[1:], True)]
    while len(tied):
        after = np.where(tied + k < end[tied], rank[np.minimum(tied + k, n - 1)], -1)
        o = np.lexsort((after, rank[tied]))
        tied, after, old = tied[o], after[o], rank[tied[o]]
        group = np.append(True, old[1:] != old[:-1])
        new = group.copy()
        new[1:] |= after[1:] != after[:-1]
        at = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - first
        levels.append(rank)
        k *= 2
        tied = tied[~new | ~np.append(new[1:], True)]
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    start = min(len(levels) - 1, least.bit_length() - 1)
    near = np.flatnonzero(levels[start][array[1:]] == levels[start][array[:-1]]) if n > 1 else np.zeros(0, np.int64)
    a, b = array[near].copy(), array[near + 1].copy()
    ends_a, ends_b, common = end[a] if n else a, end[b] if n else b, np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        for _ in range(2):  # at the top level two steps may match
            live = (a < ends_a) & (b < ends_b)
            same = live.copy()
            same[live] = levels[level][a[live]] == levels[level][b[live]]
            if level == 0:
                same &= live
            step = np.where(same, 1 << level, 0)
            a, b, common = a + step, b + step, common + step
    best = np.zeros(n, np.int64)
    np.maximum.at(best, array[near], common)
    np.maximum.at(best, array[near + 1], common)
    found = np.flatnonzero(best >= least)
    return found, best[found]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions, whether a span covers it."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:-1]) > 0


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return np.diff(total[bounds])


def measure(data: np.ndarray, offs: np.ndarray, least: int, short: int) -> list[np.ndarray]:
    """The columns of SCHEMA for texts laid end to end, then the last two again for repeats of `short` words or more."""
    texts = len(offs) - 1
    s, e, first = words(data, offs)
    n_words = np.diff(first)
    if not len(data):
        return [np.zeros(texts, np.int64)] * 9
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
    word_chars = _per_text(chars[e] - chars[s], first)
    symbols = _per_text(_SYMBOLS[data], offs)
    rolling = Rolling(data)
    # lines
    edge = np.zeros(len(data) + 1, bool)
    edge[offs[:-1]] = True
    breaks = np.flatnonzero(data == 10)
    edge[breaks + 1] = True
    begin = np.flatnonzero(edge[:-1])
    stop = np.append(begin[1:], len(data))
    stop = stop - (data[stop - 1] == 10)
    begin, stop = begin[stop > begin], stop[stop > begin]
    full = np.searchsorted(s, stop) > np.searchsorted(s, begin)
    begin, stop = begin[full], stop[full]
    owner = np.searchsorted(offs, begin, "right") - 1
    lines = np.bincount(owner, minlength=texts)
    _, one = np.unique(rolling.spans(begin, stop) ^ mix(owner.astype(np.uint64)), return_index=True)
    dup_lines = lines - np.bincount(owner[one], minlength=texts)
    # words
    h = rolling.spans(s, e)
    n = len(h)
    text = np.repeat(np.arange(texts), n_words)
    at = np.flatnonzero(np.arange(n) + 8 <= first[1:][text]) if n else np.zeros(0, np.int64)
    window = Sequence(h).runs(at, 8) ^ mix(text[at].astype(np.uint64))
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = at[count[back] > 1] if len(at) else at
    repeat_words = _per_text(covered(twice, np.full(len(twice), 8), n), first)
    found, length = longest_repeats(h, first, min(short, least))
    out = [n_words, word_chars, symbols, dup_lines, repeat_words]
    for k in (least, short):
        at, size = found[length >= k], length[length >= k]
        longest = np.zeros(texts, np.int64)
        np.maximum.at(longest, text[at], size)
        out += [_per_text(covered(at, size, n), first), longest]
    return out


def repetition(docs: DataFrame, least: int = 8, most_covered: float = 0.3, most_longest: int = 100, short: int = 5, most_share: float = 0.15) -> DataFrame:
    """doc_id, the counts of SCHEMA, base_failed, kept.

    kept is false if base_failed, if repeated substrings of `short` words or more cover more than
    most_covered of the words, or if the longest of them has more than most_longest words or more
    than most_share of the text's words (said twice, it would make up most_covered). covered_words
    and longest_repeat tell of substrings of `least` words or more. A null or empty text has zero
    words and fails the base. Rows stay one to one; other columns are left out."""
    fields = [*SCHEMA, *_VERDICT]

    def run(b):
        for i, j, data, offs in blocks(b.column(1)):
            yield batch(pa.schema([("doc_id", pa.int64()), *fields]), b.column(0).slice(i, j - i), *measure(data, offs, least, short))

    out = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{f.name} long" for f in fields))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    worse = (F.col("_covered") > most_covered * F.col("n_words")) | (F.col("_longest") > most_longest) | (F.col("_longest") > most_share * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~worse).drop(*_VERDICT.names)


def op8(spark, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))
