"""Vectorised work on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_M2)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << max(20, n.bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("_POW", _BASE), ("_INV", inverse)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _POW, _INV


class Rolling:
    """Hashes of any byte spans of one array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(x + (end - start).astype(np.uint64))


def blocks(column: pa.Array, limit: int = 1 << 19):
    """(first row, end row, bytes, offsets) of consecutive rows of a string column, about limit
    bytes each and one row at least, so that work on a block has bounded memory. Null is empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    n = len(a)
    if not n:
        return
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts laid end to end: starts, ends, and for each text the number
    of words before it (one more than texts)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= edge[1:n] | ~solid[:-1]
    end[:-1] &= edge[1:n] | ~solid[1:]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values in order, by sorting (a hash table is slower here)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] entries, then the next."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Sequence:
    """Hashes of any runs of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(mix(symbols) * power[: len(symbols)], out=self.sums[1:])

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        x = (self.sums[start + length] - self.sums[start]) * self.inverse[start]
        return mix(x + np.asarray(length, np.uint64))


def whole_runs(batches, keys: int):
    """Record batches sorted by their first `keys` columns, cut so that no run of equal keys is split:
    (batch, where runs begin, and its end)."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        b = t.to_batches()[0]
        at = _starts(b, keys)
        if at[-1]:
            yield b.slice(0, at[-1]), np.asarray(at)
        held = b.slice(at[-1])
    if held is not None and held.num_rows:
        yield held, np.append(_starts(held, keys), held.num_rows)


def _starts(b: pa.RecordBatch, keys: int) -> np.ndarray:
    new = np.zeros(b.num_rows, bool)
    new[0] = True
    for k in range(keys):
        x = np.asarray(b.column(k))
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
