"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (words seen in training often enough; all others share one) beside
the mean vector of its character trigrams, so unseen spellings still score. Texts are read in
overlapping windows of words; a text's score is the calibrated maximum over all its windows. Training
takes, for each labelled text, its currently highest windows (toxic words are few in a long text), so
hard clean windows are learnt too. Inputs are dropped at random and vectors decay, so that few texts
suffice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import LOWER, Rolling, batch, blocks, distinct, ranges, words

WIDTH, STEP = 32, 16
BUCKETS = 4096
#: Bytes of text whose words are hashed at once; work space is some fifty bytes a byte.
STRIP = 1 << 19
#: ASCII marks count as white space here, but letters are lower-cased first.
_FOLD = LOWER.copy()
_FOLD[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


class Words:
    """Different words of texts laid end to end, and where each word of the texts points."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        data = _FOLD[data]
        s, e, self.first = words(data, offs)
        hashes, ones, backs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        i = 0
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + STRIP, "right")))
            h = Rolling(data[s[i] : e[j - 1]]).spans(s[i:j] - s[i], e[i:j] - s[i])
            h, one, back = np.unique(h, return_index=True, return_inverse=True)
            hashes.append(h)
            ones.append(one + i)
            backs.append(back.astype(np.int32))
            i = j
        self.hash, one, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        place, begin = place.astype(np.int32), np.cumsum([len(h) for h in hashes])
        self.back = np.concatenate([np.zeros(0, np.int32), *(place[k:][back] for k, back in zip(begin[:-1], backs, strict=True))])
        one = np.concatenate(ones)[one]
        s, e = s[one], e[one]
        size = e - s + 2  # "<word>"
        self.at = np.append(0, np.cumsum(size))
        text = np.full(int(self.at[-1]), 60, np.uint32)
        text[self.at[1:] - 1] = 62
        text[ranges(self.at[:-1] + 1, size - 2)] = data[ranges(s, size - 2)]
        gram = text[:-2] << np.uint32(16) | text[1:-1] << np.uint32(8) | text[2:] if len(text) else text
        self.grams = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)  # 12 bits

    def gram_list(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.at[which + 1] - self.at[which] - 2
        return self.grams[ranges(self.at[which], n)], n


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the overlapping windows over all words of each text; a text without words has none."""
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(1, -(-(n - (WIDTH - STEP)) // STEP)), 0)
    text = np.repeat(np.arange(len(n)), many)
    start = first[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    return text, start, np.minimum(start + WIDTH, first[text + 1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters in self.p: vectors of words and trigrams, two gated recurrent layers, attention, output."""

    def __init__(self, vocabulary: np.ndarray, rng, dim: int = 12, hidden: int = 8):
        self.vocabulary, self.hidden = vocabulary, hidden
        f = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
        self.p = {"word": f(len(vocabulary) + 1, dim), "gram": f(BUCKETS, dim, k=0.3), "wa": f(2 * hidden, 8, k=0.3), "va": f(8, k=0.3), "wo": f(2 * hidden, k=0.3), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(2 * dim, 3 * hidden, k=0.3), f"U{d}": f(hidden, 3 * hidden, k=0.3), f"b{d}": np.zeros(3 * hidden, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def lookup(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)

    def inputs(self, w: Words, which: np.ndarray):
        grams, n = w.gram_list(which)
        total = np.zeros((len(which), self.p["gram"].shape[1]), np.float32)
        if len(grams):
            total = np.add.reduceat(self.p["gram"][grams], np.cumsum(n) - n, axis=0)
        ids = self.lookup(w.hash[which])
        return np.concatenate([self.p["word"][ids], total / n[:, None].astype(np.float32)], axis=1), (ids, grams, n)

    def _layer(self, d: str, proj, index, mask, keep):
        """States after each step (steps, windows, hidden); proj has a row for each word."""
        H, U = self.hidden, self.p[f"U{d}"]
        steps, B = index.shape
        h, out, saved = np.zeros((B, H), np.float32), np.empty((steps, B, H), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, a = proj[index[t]], h @ U
            zr = 1 / (1 + np.exp(-(x[:, : 2 * H] + a[:, : 2 * H])))
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(x[:, 2 * H :] + r * a[:, 2 * H :])
            m = mask[t][:, None]
            new = h + m * ((1 - z) * (n - h))
            if keep:
                saved.append((t, h, a[:, 2 * H :], z, r, n, m))
            h = out[t] = new
        return out, saved

    def forward(self, x, index, mask, keep=False):
        """Logits of windows; index: (steps, windows) rows of x, mask: where there is a word."""
        proj = {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}
        states = {d: self._layer(d, proj[d], index, mask, keep) for d in "fb"}
        s = np.concatenate([states["f"][0], states["b"][0]], axis=2)
        e = np.tanh(s @ self.p["wa"])
        score = np.where(mask > 0, e @ self.p["va"], -1e9)
        a = np.exp(score - score.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * s).sum(0)
        return pooled @ self.p["wo"] + self.p["bo"][0], (states, s, e, a, pooled)

    def gradients(self, x, index, mask, target):
        logit, (states, s, e, a, pooled) = self.forward(x, index, mask, True)
        H, g = self.hidden, {}
        dl = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ dl, dl.sum(keepdims=True)
        dp = dl[:, None] * self.p["wo"]
        ds = a[:, :, None] * dp
        da = (s * dp).sum(2)
        dscore = a * (da - (a * da).sum(0))
        g["va"] = np.einsum("tbk,tb->k", e, dscore)
        de = dscore[:, :, None] * self.p["va"] * (1 - e * e)
        g["wa"] = np.einsum("tbi,tbk->ik", s, de)
        ds = ds + de @ self.p["wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            U, part = self.p[f"U{d}"], ds[:, :, k * H : (k + 1) * H]
            dU, dproj, dh = np.zeros_like(U), np.zeros((len(x), 3 * H), np.float32), np.zeros((index.shape[1], H), np.float32)
            for t, h, an, z, r, n, m in reversed(states[d][1]):
                dh = dh + part[t]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                dgate = np.concatenate([dz, dr, dn], axis=1)
                da_ = np.concatenate([dz, dr, dn * r], axis=1)
                dU += h.T @ da_
                np.add.at(dproj, index[t], dgate)
                dh = dh * (1 - m * (1 - z)) + da_ @ U.T
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = dU, x.T @ dproj, dproj.sum(0)
            dx += dproj @ self.p[f"W{d}"].T
        return logit, g, dx

    def score_windows(self, w: Words, start, end, size: int = 4096) -> np.ndarray:
        out = np.empty(len(start), np.float32)
        for i in range(0, len(start), size):
            which, index, mask = pick(w, start[i : i + size], end[i : i + size])
            out[i : i + size] = self.forward(self.inputs(w, which)[0], index, mask)[0]
        return out

    def texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1; a text without words scores as the least suspicious window."""
        best = np.full(len(offs) - 1, -12.0, np.float32)
        w = Words(data, offs)
        text, start, end = windows(w.first)
        if len(text):
            np.maximum.at(best, text, self.score_windows(w, start, end))
        return _sigmoid(self.scale * best.astype(np.float64) + self.shift)


def pick(w: Words, start, end):
    """(different words, index into them (steps, windows), mask) of windows."""
    at = start + np.arange(WIDTH)[:, None]
    mask = (at < end).astype(np.float32)
    which, index = np.unique(w.back[np.minimum(at, end - 1)], return_inverse=True)
    return which, index.reshape(at.shape), mask


def train(texts: list[str], labels: np.ndarray, seed: int = 5, rounds: int = 2, least_steps: int = 300, drop: float = 0.25, decay: float = 0.02, rate: float = 0.01) -> Network:
    """Fit on whole texts. Without texts of both classes, a network whose every score is the share of toxic texts."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        net = Network(np.zeros(0, np.uint64), rng)
        share = float(labels.mean()) if len(labels) else 0.0
        net.scale, net.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    raw = [t.encode() for t in texts]
    offs = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    w = Words(np.frombuffer(b"".join(raw), np.uint8), offs)
    del raw
    df, bad = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash))
    for y, a, b in zip(labels.tolist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        own = distinct(w.back[a:b])
        df[own] += 1
        bad[own] += y
    net = Network(w.hash[(df >= 4)], rng)
    rate_all = labels.mean()
    odds = np.log((bad + 0.5 * rate_all) / (df - bad + 0.5 * (1 - rate_all)))
    odds[df < 3] = -9
    text, start, end = windows(w.first)
    peak = np.maximum.reduceat(odds[w.back], start) if len(start) else np.zeros(0)  # up to the next start
    value = peak + 1e-3 * rng.random(len(start))
    m, v, steps = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for _ in range(rounds):
        order = np.lexsort((-value, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        pos = order[(rank < 1) & (labels[text[order]] == 1)]
        neg = order[(rank < 2) & (labels[text[order]] == 0)]
        for _ in range(max(3, -(-least_steps * 64 // (rounds * (6 * len(pos) + 64))))):
            extra = rng.choice(np.flatnonzero(labels[text] == 0), len(pos))
            good = rng.permutation(np.concatenate([neg, extra]))[: 4 * len(pos) + 64]
            use = rng.permutation(np.concatenate([pos, pos, good]))
            for i in range(0, len(use), 64):
                u = use[i : i + 64]
                which, index, mask = pick(w, start[u], end[u])
                x, (ids, grams, n) = net.inputs(w, which)
                kept = (rng.random(x.shape) >= drop).astype(np.float32) / np.float32(1 - drop)
                _, g, dx = net.gradients(x * kept, index, mask, labels[text[u]])
                dx = dx * kept
                D = net.p["word"].shape[1]
                g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
                np.add.at(g["word"], ids, dx[:, :D])
                np.add.at(g["gram"], grams, np.repeat(dx[:, D:] / n[:, None], n, axis=0).astype(np.float32))
                steps += 1
                for k in net.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    if k in ("word", "gram"):
                        net.p[k] *= 1 - rate * decay
                    net.p[k] -= (rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
        value = net.score_windows(w, start, end)
    best = np.full(len(texts), -12.0)
    np.maximum.at(best, text, value)
    a, b = 1.0, 0.0  # Platt scaling by Newton steps
    for _ in range(50):
        p = _sigmoid(a * best + b)
        gr = np.array([((p - labels) * best).sum() + 1e-2 * a, (p - labels).sum()])
        q = p * (1 - p) + 1e-6
        hess = np.array([[(q * best * best).sum() + 1e-2, (q * best).sum()], [(q * best).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(hess, gr)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    net.scale, net.shift = float(max(a, 0.0)), float(b)
    return net


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 800, clean_rows: int = 1600, sample_bytes: int = 1 << 26) -> Network:
    """A network from a bounded sample of labelled rows outside the held-out third: at most toxic_rows
    and clean_rows whole texts, those with the smallest hash of their doc_id, and of each class only as
    many of them, in that order, as have sample_bytes together (the first one in any case).

    Null labels, ids and texts are left out. A doc_id that is labelled more than once is toxic if any label
    says so; of its texts, where they differ, the one that sorts first counts. So the sample does not depend
    on the order of rows. No rows, or rows of one class, give a network whose every score is the same."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).dropna().groupBy("doc_id").agg(F.max("_toxic").alias("_toxic")).filter(~held_out(F.col("doc_id")))
    texts = docs.select("doc_id", "text").dropna()
    few = []
    for y, n in ((1, toxic_rows), (0, clean_rows)):
        order = W.orderBy(F.xxhash64("doc_id"), "doc_id")  # over at most n rows
        own = marked.filter(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).join(texts, "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))
        sized = own.withColumn("_sum", F.sum(F.octet_length("text").cast("long")).over(order)).withColumn("_nth", F.row_number().over(order))
        few.append(sized.filter((F.col("_sum") <= sample_bytes) | (F.col("_nth") == 1)).select("doc_id", "_toxic", "text"))
    rows = sorted(few[0].unionByName(few[1]).collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], np.array([r["_toxic"] for r in rows], np.float32))


def score(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold), from whole texts. Null and empty
    texts get the lowest score; columns by these names are replaced, all others, whatever their names, and
    all rows stay."""
    docs = docs.drop("score", "predicted")
    rows = docs.select(F.struct("*").alias("row"), "text")  # one column, so no name can clash

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = np.concatenate([net.texts(data, offs) for _, _, data, offs in blocks(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])).select("row.*", "score", "predicted")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
