"""Token ids of whole texts, by the tokenizers library, with the ids of repeated pieces kept.

A byte-level BPE never merges over the borders that its pre-tokenizer sets, and those of the GPT-2
pattern lie at least at each word with the one space before it. So a text is cut there, each
different piece is encoded once by the library, and ids are laid end to end in numpy. The library
takes added tokens (such as <|endoftext|>) out of a text first and encodes what lies between them by
itself, so they are pieces of their own. Texts with white space outside ASCII are encoded whole."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from ._text import SPACE, Rolling, ranges

#: The byte alphabet of byte-level BPE: printable bytes stand for themselves, the rest follow from 256.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _PRINT]
_ALPHABET = dict(zip(_PRINT + _REST, [*_PRINT, *range(256, 256 + len(_REST))], strict=True))
_SHOWN = np.array([_ALPHABET[b] for b in range(256)], "<u4")
#: White space outside ASCII, in UTF-8 (fixed values).
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


_SPACE, _LETTER, _MARK, _LEAD, _TRAIL, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[SPACE] = _SPACE
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = _MARK
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_CLASS[0xC3], _CLASS[0x80:0xC0] = _LEAD, _TRAIL


def stems(data: np.ndarray) -> np.ndarray:
    """Which bytes of a text are part of A-Z, a-z or one of À-ÖØ-öø-ÿ."""
    kind = _CLASS[data]
    out = kind == _LETTER
    lead = np.flatnonzero((data[:-1] == 0xC3) & (kind[1:] == _TRAIL) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    out[lead] = out[lead + 1] = True
    return out


class Slots:
    """Open-addressing table from 64-bit hashes to numbers 0, 1, ... in order of arrival."""

    def __init__(self, most: int):
        self.mask = (1 << (2 * most - 1).bit_length()) - 1
        self.keys, self.values, self.n = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 where there is none."""
        at, out, open_ = (h & np.uint64(self.mask)).astype(np.int64), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(open_):
            key = self.keys[at[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Different hashes that are not in it yet."""
        at, open_ = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(open_):
            free = open_[self.keys[at[open_]] == 0]
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.keys[at[placed]], self.values[at[placed]] = h[placed], self.n + placed
            done = np.zeros(len(h), bool)
            done[placed] = True
            open_ = open_[~done[open_]]
            at[open_] = (at[open_] + 1) & self.mask
        self.n += len(h)


class Encoder:
    """At most about `kept` pieces stay in memory; when there are more, all are forgotten."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, kept: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.kept = self.tokenizer.model, kept
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("an added token that is not matched byte for byte")
        longest = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.letters = any(t.content.strip().isalpha() for t in added)  # an added token that might be in a word
        self.added = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process and vocabulary."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.slots = Slots(self.kept)
        self.flat, self.start, self.size = array("I"), array("q"), array("q")

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Keep the ids of these pieces. One of letters alone, with a space before them or not, is one pre-token."""
        raw, shown = data.tobytes(), _SHOWN[data].tobytes().decode("utf-32-le")
        if self.letters:
            stem = np.zeros(len(start), bool)
        else:
            first = start + (data[start] == 32)
            letters = np.append(0, np.cumsum(stems(data)))
            stem = (letters[end] - letters[first] == end - first) & (first < end)
        tokenize, encode, flat = self.model.tokenize, self.tokenizer.encode, self.flat
        for one, i, j in zip(stem.tolist(), start.tolist(), end.tolist(), strict=True):
            self.start.append(len(flat))
            if one:
                flat.extend([t.id for t in tokenize(shown[i:j])])
            else:
                flat.extend(encode(raw[i:j].decode("utf-8", "replace"), add_special_tokens=False).ids)
            self.size.append(len(flat) - self.start[-1])

    def _added(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens lie, from the left of each text; none crosses a text's end."""
        raw = data.tobytes()
        if not self.added or not self.added.search(raw):
            return []
        return [m.span() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) for m in self.added.finditer(raw, i, j)]

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where the pieces of texts laid end to end begin; they cover all bytes."""
        n = len(data)
        kind = _CLASS[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        added = self._added(data, offs)
        for i, j in added:
            edge[i] = edge[j] = True
        cut = edge[:n].copy()
        # a word's letters and marks other than an apostrophe never share a pre-token
        pair = kind[:-1] * np.uint8(8) + kind[1:]
        cut[1:] |= (pair == _LETTER * 8 + _MARK) | (pair == _MARK * 8 + _LETTER)
        for i in (np.flatnonzero(pair == _MARK * 8 + _LEAD) + 1, np.flatnonzero(pair == _TRAIL * 8 + _MARK) + 1):
            i = i[i < n - 1]
            first = i if len(i) and kind[i[0]] == _LEAD else i - 2
            ok = (data[first] == 0xC3) & (data[first + 1] != 0x97) & (data[first + 1] != 0xB7) & (first >= 0)
            cut[i[ok]] = True
        # a run of white space gives its last character to the word after it, if that is a space
        space = kind == _SPACE
        begin, end = space.copy(), space.copy()
        begin[1:] &= edge[1:n] | ~space[:-1]
        end[:-1] &= edge[1:n] | ~space[1:]
        runs, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        inner = ends[~edge[ends]]
        cut[runs] = True
        cut[inner - 1] = True
        cut[inner[data[inner - 1] != 32]] = True
        for i, j in added:
            cut[i + 1 : j] = False
        if odd := [m.start() for m in _ODD.finditer(data.tobytes())]:
            for k in np.unique(np.searchsorted(offs, odd, "right") - 1):
                cut[offs[k] + 1 : offs[k + 1]] = False
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and the number of ids before each text (one more than texts)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        s = self.pieces(data, offs)
        e = np.append(s[1:], len(data))
        h = Rolling(data).spans(s, e) | np.uint64(1)
        slot = self.slots.find(h)
        if len(miss := np.flatnonzero(slot < 0)):
            if self.slots.n + len(miss) > self.kept and self.slots.n:
                self._forget()
                miss, slot = np.arange(len(h)), np.full(len(h), -1)
            found, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.slots.n + len(found) > self.kept:  # one text with more pieces than are kept
                self.kept = len(found)
                self._forget()
            before = self.slots.n
            self.slots.add(found)
            self._encode(data, s[miss[first]], e[miss[first]])
            slot[miss] = before + back
        size = np.frombuffer(self.size, np.int64)[slot]
        ids = np.frombuffer(self.flat, np.uint32)[ranges(np.frombuffer(self.start, np.int64)[slot], size)]
        total = np.append(0, np.cumsum(size))
        return ids, total[np.searchsorted(s, offs)]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with end_id after them."""
    return np.insert(ids, at[1:], end_id).astype("<u4"), at + np.arange(len(at))
