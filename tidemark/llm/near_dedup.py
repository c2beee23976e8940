"""MinHash near-duplicates by a multi-index Hamming join, confirmed on whole shingle sets.

A signature is CHUNKS chunks of SYMBOLS b-bit symbols (b = 16), each the low bits of one min-hash. If
two signatures differ in at most RADIUS = 2 * CHUNKS - 1 symbols, some chunk holds at most one of the
differences (pigeonhole). So each chunk is indexed once for each place of that one error: the key is
the other symbols. All pairs within RADIUS meet under a key. At a similarity of 0.75 a symbol differs
with probability 0.25, and more than 23 of 48 do with probability below 2e-4 (fewer above it).

Documents with equal sets stand behind one representative. Under a key, pairs within RADIUS are
looked for in blocks of bounded size, and members with a partner fetch their whole sets; there the
exact test is made and only a spanning star of each linked group leaves the task. A key of many
blocks is settled in two rounds: in the first, some members (pivots) visit all blocks, so that copies
of one text hang together whatever their block; in the second, only members outside the key's
largest component meet the other blocks, and only pairs of different components are tested. So what is
shuffled grows with the members, not with the pairs, unless most members of a hot key are linked with
nothing; no partner is dropped. What is joined here has no size bound, so nothing is broadcast, at any size."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import components, map_arrow, release, stage
from ._text import LOWER, Rolling, Sequence, batch, blocks, distinct, mix, whole_runs, words

CHUNKS, SYMBOLS, SHINGLE = 12, 4, 5
SIZE = CHUNKS * SYMBOLS
RADIUS = 2 * CHUNKS - 1
#: RADIUS and the size filter of _close are made for this similarity.
LEAST_PERCENT = 75
_A = (mix(np.arange(1, SIZE + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)[:, None]
_B = mix(np.arange(101, SIZE + 101, dtype=np.uint64)).astype(np.uint32)[:, None]
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])


def shingle_sets(data: np.ndarray, offs: np.ndarray):
    """The sorted set of 64-bit shingle hashes of each text: distinct runs of five words (A-Z lower-cased);
    the whole of fewer words; nothing without words."""
    data = LOWER[data]
    s, e, first = words(data, offs)
    if not len(s):
        for _ in range(len(offs) - 1):
            yield np.zeros(0, np.uint64)
        return
    seq = Sequence(Rolling(data).spans(s, e))
    n = len(s)
    full = seq.runs(np.arange(max(0, n - SHINGLE + 1)), SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield distinct(full[a : b - SHINGLE + 1])
        else:
            yield seq.runs(np.array([a]), b - a) if b > a else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        y = x[None, i : i + 2048] ^ _B
        y *= _A
        np.minimum(low, y.min(1), out=low)
    return ((low * np.uint32(2654435761)) >> np.uint32(16)).astype("<u2")


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), digest (of the set), sig; digest and sig are null for an empty set."""

    def run(b):
        for i, j, data, offs in blocks(b.column(1)):
            sets = list(shingle_sets(data, offs))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield batch(_SKETCH, b.column(0).slice(i, j - i), [len(x) for x in sets], digests, [signature(x).tobytes() if len(x) else None for x in sets])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, digest binary, sig binary")


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SIZE)


def keys(reps: DataFrame) -> DataFrame:
    """(key, code, rep): one row for each chunk and place of its one allowed error."""
    schema = pa.schema([("key", pa.int64()), ("code", pa.int32()), ("rep", pa.int64())])

    def run(b):
        sig, rep = _signatures(b.column(1)).astype(np.uint64), np.asarray(b.column(0))
        out = []
        for c in range(CHUNKS):
            for v in range(SYMBOLS):
                h = np.full(len(sig), c * SYMBOLS + v + 1, np.uint64)
                for k in range(SYMBOLS):
                    if k != v:
                        h = h << np.uint64(16) | sig[:, c * SYMBOLS + k]
                out.append(mix(h))
        yield batch(schema, np.concatenate(out).view(np.int64), np.repeat(np.arange(SIZE), len(sig)), np.tile(rep, SIZE))

    return map_arrow(reps.select("rep", "sig"), run, "key long, code int, rep long")


def _close(sig, n, code, i, j) -> np.ndarray:
    """Of pairs i, j: within RADIUS, of sizes that allow the similarity, and first met under this code."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 17):
        a, b = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
        ok = np.flatnonzero(4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        same = (sig[a] == sig[b]).reshape(-1, CHUNKS, SYMBOLS)
        right = same.sum(2)
        chunk = (right >= SYMBOLS - 1).argmax(1)
        own = same[np.arange(len(a)), chunk]
        place = np.where(own.all(1), 0, own.argmin(1))
        out[k + ok] = (right.sum(1) >= SIZE - RADIUS) & (chunk * SYMBOLS + place == code[a])
    return out


def _pairs(at: np.ndarray):
    """All pairs of rows inside runs, in bounded pieces: runs of one size together, large runs in strips."""
    size = np.diff(at)
    for g in np.unique(size[size > 1]).tolist():
        begin = at[:-1][size == g]
        if g <= 64:
            a, b = np.triu_indices(g, 1)
            for k in range(0, len(begin), max(1, (1 << 20) // len(a))):
                s = begin[k : k + max(1, (1 << 20) // len(a))]
                yield (s[:, None] + a).ravel(), (s[:, None] + b).ravel()
        else:
            for s in begin.tolist():
                for r in range(0, g, 256):
                    a, b = np.meshgrid(np.arange(r, min(g, r + 256)), np.arange(g), indexing="ij")
                    up = b > a
                    yield s + a[up], s + b[up]


def _crossings(at: np.ndarray, visits: np.ndarray):
    """Pairs of a resident and a visitor (last in a run), in bounded pieces."""
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        m = s + int(np.searchsorted(visits[s:e], 1))
        for r in range(s, m, 256):
            a, b = np.meshgrid(np.arange(r, min(m, r + 256)), np.arange(m, e), indexing="ij")
            yield a.ravel(), b.ravel()


def _find_members(across: bool):
    """Of sorted rows (key, bi, bj, code, rep, comp, visits, n, sig), those with a partner under their key and
    block. across: partners are of the other kind (visits) and of another component."""
    schema = pa.schema([("key", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("rep", pa.int64())])

    def run(batches):
        for b, at in whole_runs(batches, 3):
            code, rep, comp, visits, n = (np.asarray(b.column(k)) for k in range(3, 8))
            sig, hit = _signatures(b.column(8)), np.zeros(b.num_rows, bool)
            for i, j in _crossings(at, visits) if across else _pairs(at):
                if across:
                    other = comp[i] != comp[j]
                    i, j = i[other], j[other]
                ok = _close(sig, n, code, i, j)
                hit[i[ok]] = hit[j[ok]] = True
            if hit.any():
                yield batch(schema, *(np.asarray(b.column(k))[hit] for k in range(3)), rep[hit])

    return run


def link_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets reach the similarity with which, exactly: common shingles are counted by sparse pairs
    where few sets share one and by a matrix product where many do."""
    g = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    h, who = np.concatenate(sets), np.repeat(np.arange(g), size)
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    df = np.diff(np.append(begin, len(h)))
    common = np.zeros(g * g, np.int64)
    for d in np.unique(df[(df > 1) & (df <= 48)]).tolist():
        a, b = np.triu_indices(d, 1)
        rows = begin[df == d]
        for k in range(0, len(rows), max(1, (1 << 20) // len(a))):
            s = rows[k : k + max(1, (1 << 20) // len(a)), None]
            common += np.bincount((who[s + a] * g + who[s + b]).ravel(), minlength=g * g)
    many = np.flatnonzero(df > 48)
    common = common.reshape(g, g)
    common = common + common.T
    for k in range(0, len(many), 1024):
        part = many[k : k + 1024]
        dense = np.zeros((g, len(part)), np.float32)
        for c, r in enumerate(part.tolist()):
            dense[who[begin[r] : begin[r] + df[r]], c] = 1
        common = common + np.rint(dense @ dense.T).astype(np.int64)
    out = 100 * common >= percent * (size[:, None] + size[None] - common)
    np.fill_diagonal(out, False)
    return out


def star(linked: np.ndarray):
    """(node, centre) for all nodes that a centre reaches, each group once."""
    left = linked.any(1)
    while left.any():
        c = int(left.argmax())
        reach = np.zeros(len(left), bool)
        edge = reach.copy()
        edge[c] = reach[c] = True
        while edge.any():
            edge = linked[edge].any(0) & ~reach
            reach |= edge
        left &= ~reach
        reach[c] = False
        for x in np.flatnonzero(reach).tolist():
            yield x, c


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b, at in whole_runs(batches, 3):
            rep, sets, out = np.asarray(b.column(3)), b.column(4), []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                own = [np.frombuffer(sets[k].as_buffer(), np.uint64) for k in range(s, e)]
                if e - s == 2:
                    both = len(np.intersect1d(*own, assume_unique=True))
                    if 100 * both >= percent * (len(own[0]) + len(own[1]) - both):
                        out.append((rep[s], rep[s + 1]))
                else:
                    out += [(rep[s + x], rep[s + c]) for x, c in star(link_matrix(own, percent))]
            if out:
                yield batch(schema, *np.array(out, np.int64).T)

    return run


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, set) of the documents whose ids are wanted; of repeated ids one."""
    schema = pa.schema([("rep", pa.int64()), ("set", pa.binary())])

    def run(b):
        for i, j, data, offs in blocks(b.column(1)):
            yield batch(schema, b.column(0).slice(i, j - i), [x.tobytes() for x in shingle_sets(data, offs)])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return map_arrow(rows, run, "rep long, set binary")


def _partners(rows: DataFrame, reps: DataFrame, across: bool) -> DataFrame:
    """Of rows (key, bi, bj, code, rep, comp, visits), those with a partner under their key and blocks."""
    full = rows.join(reps.select("rep", "n", "sig").hint("merge"), "rep").select("key", "bi", "bj", "code", "rep", "comp", "visits", "n", "sig")
    full = full.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "visits")
    return stage(full.mapInArrow(_find_members(across), "key long, bi int, bj int, rep long"), "members")


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), a spanning star of each group of members that share key and blocks."""
    fetched = members.join(sets.hint("merge"), "rep").select("key", "bi", "bj", "rep", "set").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
    return stage(fetched.mapInArrow(_confirm(percent), "a long, b long"), "edges")


def _visitors(busy: DataFrame, pivots: int) -> DataFrame:
    """Of each busy key `pivots` members or fewer, in all its blocks but their own."""
    some = busy.groupBy("key", "nb").agg(F.first("code").alias("code"), F.array_distinct(F.array(*[F.min_by("rep", F.xxhash64("rep", F.lit(j))) for j in range(pivots)])).alias("reps"))
    out = some.select("key", "nb", "code", F.explode("reps").alias("rep")).withColumn("b", _block_of("rep", "key", "nb"))
    return out.select("key", "b", "code", "rep", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bi")).filter("bi <> b")


def _block_of(rep: str, key: str, many: str):
    return F.pmod(F.xxhash64(rep, key), F.col(many)).cast("int")


def _strays(busy: DataFrame, found: DataFrame, wide: int, block: int) -> DataFrame:
    """Rows for the second round, staged: what is outside its key's largest component, in blocks of its own,
    against all members of the key. Only signatures meet here, so `wide` blocks of the first round are one."""
    placed = busy.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    known = placed = stage(placed, "placed")  # read several times below, so joined once
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    top = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), (F.sum("c") - F.max("c")).alias("others")).filter("others > 0")
    placed = placed.join(top.hint("merge"), "key").withColumn("ns", F.ceil(F.col("others") / (wide * block)).cast("int"))
    placed = placed.withColumn("b", F.floor(F.col("b") / wide).cast("int")).withColumn("nb", F.ceil(F.col("nb") / wide).cast("int"))
    of_stray = F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("bj")
    stay = placed.select("key", F.col("b").alias("bi"), of_stray, "code", "rep", "comp", F.lit(0).alias("visits"))
    go = placed.filter("comp <> top").withColumn("bj", F.pmod(F.xxhash64("rep"), F.col("ns")).cast("int"))
    go = go.select("key", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bi"), "bj", "code", "rep", "comp", F.lit(1).alias("visits"))
    out = stage(stay.unionByName(go), "strays")
    release(known)
    return out


def _same_id(sk: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links (a, b) between the representatives of different texts under one doc_id; None where there are none."""
    known = sk.filter("n > 0 and doc_id is not null")
    several = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("doc_id")
    if several.isEmpty():
        return None
    theirs = known.join(several, "doc_id").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep")
    low = theirs.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return theirs.join(low, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75, block: int = 128, pivots: int = 8, wide: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs (doc_id, text; other columns are left
    out). Documents are linked where 100 * common >= percent * union of their shingle sets; documents
    without words are linked with nothing. component_id is the smallest doc_id that links reach. A null
    doc_id is linked with nothing, has no component, and is kept. Repeated rows of one doc_id are one
    document that has all their texts: a link of any of them is its link.

    percent: 75 at least; signatures and the size filter are made for that, and lower ones would lose pairs.
    block: about how many members of one key a task compares at once. pivots: members of a larger key that
    are compared with all its blocks in the first round. wide: how many blocks the second round takes as one."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent is {percent}; pairs below {LEAST_PERCENT} percent are not all found")
    sk = stage(sketch(docs), "sketch")
    reps = sk.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = stage(reps, "reps")
    all_keys = keys(reps)
    shared = all_keys.groupBy("key").count().filter("count > 1")
    met = all_keys.join(shared.hint("merge"), "key").withColumn("nb", F.ceil(F.col("count") / block).cast("int"))
    met = stage(met.select("key", "code", "rep", "nb", _block_of("rep", "key", "nb").alias("b")), "met")
    busy = met.filter("nb > 1")
    first = met.select("key", F.col("b").alias("bi"), "code", "rep")
    if hot := not busy.isEmpty():
        first = first.unionByName(_visitors(busy, pivots).select("key", "bi", "code", "rep"))
    first = first.select("key", "bi", F.lit(0).alias("bj"), "code", "rep", F.lit(0).cast("long").alias("comp"), F.lit(0).alias("visits"))
    members = _partners(first, reps, False)
    wanted = members.select("rep")
    if hot:
        wanted = wanted.unionByName(busy.select("rep"))
    sets = stage(whole_sets(docs, wanted.distinct()), "sets")  # texts are read and shuffled once for both rounds
    edges = _links(members, sets, percent)
    if (ids := _same_id(sk, reps)) is not None:
        edges = edges.unionByName(ids)
    found = stage(components(edges), "components")
    if hot:
        strays = _strays(busy, found, wide, block)
        if not strays.isEmpty():
            more = _partners(strays, reps, True)
            found = stage(components(edges.unionByName(_links(more, sets, percent))), "components")
            release(more)
        release(strays)
    placed = sk.join(reps.select("digest", "rep"), "digest", "left").join(found, F.col("rep") == found["node"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    out = placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    release(met, members, sets)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
