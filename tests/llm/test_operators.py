"""Text operators against brute force, on fixtures with nulls, empties, long texts, ties and copies."""

import base64
import collections
import hashlib
import random
import re
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontam, html_extract, near_dedup, packing, quality, sharding, span_dedup, token_shards, toxicity, warc
from tidemark.llm._bpe import Encoder
from tidemark.llm._text import blocks

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def prose(rng, n, alphabet=400):
    return " ".join(f"w{rng.randrange(alphabet)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(1, 200)) for _ in range(30)]
    texts = [*base, base[0], base[0], base[1] + " tail", "X " + base[2], None, "", "   ", "a", "one two", "one two", "=" * 700, base[3] * 8, "é " * 300, prose(rng, 6000)]
    for k in range(6):  # a chain of small edits
        w = base[5].split()
        w[k * 3 % len(w)] = "edit"
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, shard long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, lower=True):
    w = (t or "").encode().translate(LOWER if lower else None).split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_tokens_equal_the_library():
    rng = random.Random(1)
    parts = ["a", "b", "Zé", "é", ",", ".", "'", "'s", " ", "  ", "\n", "\t", "×", "1", "_", "中", "　", "don't", "<|endoftext|>", "\r\n", "÷"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    coder = Encoder(packing.VOCABULARY, kept=200)
    for i, j, data, offs in blocks(pa.array(texts), 2000):
        ids, at = coder.encode(data, offs)
        for r in range(i, j):
            assert ids[at[r - i] : at[r - i + 1]].tolist() == coder.tokenizer.encode(texts[r], add_special_tokens=False).ids


def test_new_pieces_cost_no_python_call_each():
    letters = "abcdefghijklmnopqrstéÖßÿ"
    rng = random.Random(4)
    text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(4000)) + " × ÷ a×b é÷ö \u017f 12 don't"
    coder, calls = Encoder(token_shards.VOCABULARY), collections.Counter()
    data = np.frombuffer(text.encode(), np.uint8)
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        ids, _ = coder.encode(data, np.array([0, len(data)]))
    finally:
        sys.setprofile(None)
    assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert calls["call"] < 1000 < coder.slots.n


def test_added_tokens_equal_a_fresh_library():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(packing.VOCABULARY)
    end = "<|endoftext|>"
    assert fresh.encode(f"x {end} y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    rng = random.Random(6)
    parts = ["a", "don", "'t", "é", ".", "<", "|>", " ", "  ", "\n", "\u3000", "中", "7", end, end, "<|endo", "ftext|>"]
    texts = [f"x {end} y", end, end * 3, "<|endo", "ftext|>", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000))]
    coder = Encoder(packing.VOCABULARY, kept=300)
    for i, j, data, offs in blocks(pa.array(texts), 2000):
        ids, at = coder.encode(data, offs)
        for r in range(i, j):
            assert ids[at[r - i] : at[r - i + 1]].tolist() == fresh.encode(texts[r], add_special_tokens=False).ids


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingles(t).keys() for i, t in rows}
    group = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    for block, pivots in ((512, 16), (2, 1)):
        got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, block=block, pivots=pivots, wide=2).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == group
        assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (group[i] == i) for i, r in got.items())
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_null_id_is_kept(spark):
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r["kept"] for r in got)


def test_near_duplicates_refuse_what_they_would_lose(docs):
    with pytest.raises(ValueError, match="60"):
        near_dedup.near_duplicates(docs, percent=60)


def test_radius_is_guaranteed():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.SIZE)
        b = a.copy()
        b[rng.choice(near_dedup.SIZE, near_dedup.RADIUS, replace=False)] += 1
        assert ((a == b).reshape(near_dedup.CHUNKS, near_dedup.SYMBOLS).sum(1) >= near_dedup.SYMBOLS - 1).any()


def test_shards(docs, rows, empty):
    got = sharding.shard(docs, 7).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows]
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1 and sharding.shard(empty, 7).count() == 0


def test_matrix_margins():
    m = sharding.communication_matrix([5, 0, 100, 17], 8, 1)
    assert [sum(r) for r in m] == [5, 0, 100, 17]
    totals = [sum(c) for c in zip(*m, strict=True)]
    assert max(totals) - min(totals) <= 1 and sum(totals) == 122
    rng = random.Random(1)
    draws = [sharding._hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / 4000 - 6) < 0.15


def ids_of(t, end):
    return [*Encoder.of(packing.VOCABULARY).tokenizer.encode(t or "", add_special_tokens=False).ids, end]


def test_token_shards_round_trip(docs, rows, empty):
    at, want = 0, {}
    for i, t in rows:
        ids = ids_of(t, 0)
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = token_shards.token_index(docs, tokens=3000).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    assert token_shards.token_index(empty).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(1, 40, 500), 30).astype(np.uint32)
    at = np.array([0, 0, 4000, 4001, len(ids)])
    payload = token_shards.encode_shard([3, None, 5, 6], ids, at)
    x = token_shards.Shard(payload)
    assert len(x.symbols) < len(ids) // 4 and x.doc_ids == [3, None, 5, 6] and (x.expand(x.symbols) == ids).all()
    for d, a, b in ((1, 0, 4000), (1, 17, 23), (3, 999, 1000), (3, 5, 9000)):
        assert (x.span(d, a, b) == ids[at[d] + a : at[d] + b]).all()


def test_packing(docs, rows, empty):
    got = packing.pack(docs, capacity=256, keep_ids=True).collect()
    bins, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by[r["doc_id"]].append(r)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    for i, t in rows:
        own = sorted(by[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in own) == np.array(ids_of(t, 2), "<u4").tobytes()
        assert all(r["length"] == 256 for r in own[1:]) and [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
    assert len(bins) <= -(-sum(r["length"] for r in got) // 256) + 2 and packing.pack(empty).count() == 0


def test_fullest_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(50):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
        room, sums = rng.randrange(1, 60), {0}
        for n, c in counts.items():
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(n) <= counts[n] for n in got)


def test_repetition(docs, rows, empty):
    got = {r["doc_id"]: r for r in quality.repetition(docs).collect()}
    for i, t in rows:
        w = words(t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {x for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["covered_words"]) == (len(w), sum(map(len, w)), len(cover), len(cover))
        order, longest = sorted(range(len(w)), key=lambda k: w[k:]) if len(w) < 2000 else [], 0
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
                k += 1
            longest = max(longest, k)
        assert len(w) >= 2000 or r["longest_repeat"] == (longest if longest >= 8 else 0)
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and (not r["base_failed"] or not r["kept"])
    assert quality.repetition(empty).count() == 0


def test_only_the_suffix_array_rejects(spark):
    plain = " ".join(f"a{k}" for k in range(300))
    texts = [
        plain,
        " ".join(f"b{k} " * 7 for k in range(12)),  # all in short runs: no window of eight words repeats
        plain + " again" * 51,  # a run of 50 repeated words that overlaps itself, 51 of 351 words
        plain + " again" * 71,  # the same of 70, 71 of 371 words
        " ".join(f"c{k}" for k in range(5)) + " " + plain + " " + " ".join(f"c{k}" for k in range(5)),
    ]
    got = {r["doc_id"]: r for r in quality.repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [got[i]["kept"] for i in range(5)] == [True, False, True, False, True]
    assert [got[i]["longest_repeat"] for i in range(5)] == [0, 0, 50, 70, 0] and got[0].asDict().keys() == {"doc_id", *quality.SCHEMA.names, "base_failed", "kept"}


def brute_spans(texts, least):
    seen = set()
    for raw in texts:
        cover = np.zeros(len(raw), bool)
        for k in range(len(raw) - least + 1):
            x = raw[k : k + least]
            if x in seen:
                cover[k : k + least] = True
            seen.add(x)
        yield cover


@pytest.mark.parametrize("most", [1 << 14, 1])
def test_span_removal(docs, rows, empty, most):
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(docs, most=most).collect()}
    raws = [(t or "").encode() for _, t in rows]
    for (i, _), raw, cover in zip(rows, raws, brute_spans(raws, 100), strict=True):
        kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.append(False, cover).astype(int)) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert r["text"] == kept.decode("utf-8", "ignore") and r["lang"] == "en"
    assert span_dedup.remove_repeats(empty).count() == 0


def test_span_removal_numbers_repeated_and_null_ids(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=300))
    got = span_dedup.remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 300, 300] and [r["n_removed"] for r in got if r["doc_id"] is None] == [300]


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(8)
    items = [(0, " ".join(rows[4][1].split()[:30])), (1, rows[6][1].upper()), (2, "one two"), (3, prose(rng, 40)), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        for k, x in items:
            a, n, best = shingles(x), len((x or "").split()), None
            if not n or not w:
                continue
            for s in range(max(1, len(w) - n + 1)):
                b = shingles(b" ".join(w[s : s + n]).decode())
                v = sum((a & b).values()) / sum((a | b).values())
                if v >= 0.75 and (best is None or v > best[1]):
                    best = (s, v)
            if best:
                want[i, k] = best
    for size in (1 << 25, 300):
        got = decontam.contaminated(docs, bench, block_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in got} == want
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.filter("false")).count() == 0


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>%s<aside>side</aside><footer>foot</footer></body></html>'


def test_main_text(spark):
    art = "<article class='post-17'><h1>A &amp; B</h1><p>One <b>two</b>\n  three.<br><p>Caf&eacute; &#8212; four five six seven.<div class='comments'><p>reader</p></div><form>x</form><script>var a='</p>';</script></article>"
    rows = [(1, "http://h/1", PAGE % art), (2, "http://h/2", PAGE % "<article class='post-9'><p>Short.</p></article><div class='ad'><p>" + "buy " * 80 + "</p></div>"), (3, None, None), (4, "x", ""), (5, "http://h/3", "plain text only"), (6, "http://h/4", PAGE % "<article class='post-1'><p>cut &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (100, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, most_broadcast=most).collect()}
        assert got[1] == "A & B\nOne two three.\nCafé — four five six seven." and got[2] == "Short." and got[3] == got[4] == "" and got[6] == "cut &am"
    assert html_extract.extract(df.filter("false")).count() == 0


def test_main_text_nested_and_mixed_layouts(spark):
    para = "<p>" + "body text of the article " * 20 + "</p>"
    text = ("body text of the article " * 20).strip()
    nested = f"<article><h1>T</h1><p>lead</p><div class=wrap><div class=content>{para}</div></div></article>"
    sections = f"<article><p>lead</p><section class=a>{para}</section><section class=b>{para}</section></article>"
    whole = f"T\nlead\n{text}"
    cases = {  # host and body -> text
        1: ("nested", PAGE % nested, whole),
        2: ("linked", PAGE % nested.replace("T</h1>", "<a href='/'>T</a></h1>"), whole),
        3: ("sections", PAGE % sections, f"lead\n{text}\n{text}"),
        4: ("bare", PAGE % f"<h1>T</h1><p>lead</p><div class=content>{para}</div>", whole),
        5: ("articles", PAGE % f"<article class=a>{para}</article><article class=b>{para}</article>", f"{text}\n{text}"),
        6: ("beside", PAGE % f"{nested}<div class=legal>All rights</div>", whole),
        7: ("fragment", f"<h1>T</h1><p>lead</p><div class=content>{para}</div>", whole),
        # three pages of one layout, and others of their host with something at that path
        11: ("mixed", PAGE % f"<div class=post>{para}</div>", text),
        12: ("mixed", PAGE % f"<div class=post>{para}</div>", text),
        13: ("mixed", PAGE % f"<div class=post>{para}</div>", text),
        14: ("mixed", PAGE % f"<div class=post><p>note</p></div><main><p>lead</p><div class=text>{para}</div></main>", f"lead\n{text}"),
        15: ("mixed", PAGE % f"<div class=post>{para}</div><div class=more>{para}</div>", f"{text}\n{text}"),
        21: ("leads", PAGE % f"<article><div class=content>{para}</div></article>", text),
        22: ("leads", PAGE % f"<article><div class=content>{para}</div></article>", text),
        23: ("leads", PAGE % nested.replace("<div class=wrap>", "").replace("</div></div>", "</div>"), whole),
    }
    df = spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, (host, html, _) in cases.items()], "page_id long, url string, html string")
    for most in (100, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, most_broadcast=most).collect()}
        assert got == {i: want for i, (_, _, want) in cases.items()}


def test_archives(spark):
    big = "".join(random.Random(1).choices("abc é\r\n", k=50_000))
    rows = [(3, "u\r\nx", big), (1, "u", "same"), (2, None, "same"), (5, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda r: tuple((x is not None, x) for x in r)
    first = {"same": 1, "": 4}
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and to != p
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    got = warc.read_archives(warc.write_archives(df, segment=1000, chunk=77, size=3000)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.read_archives(warc.write_archives(df.filter("false"))).count() == 0


def test_missing_segment_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "x" * 9000)], "page_id long, url string, html string")
    archives = warc.write_archives(df, segment=1000, size=1)
    assert archives.count() > 5
    with pytest.raises(Exception, match="segments"):
        warc.read_archives(archives.filter("not contains(decode(archive, 'ISO-8859-1'), 'Segment-Number: 4')")).collect()


def test_toxicity_learns_held_out_words(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(400):
        w = prose(rng, rng.randrange(5, 120)).split()
        if k % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["vile", "scum", "clown"])
        texts.append(" ".join(w))
        labels.append(k % 4 == 0)
    net = toxicity.train(texts[:300], np.array(labels[:300]))
    df = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate([*texts[300:], "", None])], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in toxicity.score(df, net).collect()}
    assert sum(got[i]["predicted"] == labels[300 + i] for i in range(100)) >= 95
    assert got[100]["predicted"] == got[101]["predicted"] == 0 and got[100]["score"] == got[101]["score"]
    assert toxicity.train([], np.zeros(0)).texts(np.zeros(0, np.uint8), np.array([0, 0]))[0] < 0.7


def test_toxicity_windows_hold_every_run_of_half_a_window():
    for n in (1, 31, 32, 33, 48, 49, 200):
        text, start, end = toxicity.windows(np.array([0, n, n + 70]))
        for at, size in ((0, n), (n, 70)):
            own = (start >= at) & (end <= at + size)
            for k in range(max(1, size - 16 + 1)):
                assert ((start[own] <= at + k) & (end[own] >= at + min(k + 16, size))).any()


def test_toxicity_words_take_little_memory(monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 3 + k % 6)) for k in range(3000)]
    raw = [" ".join(rng.choice(vocabulary, 1500)).encode() for _ in range(400)]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    tracemalloc.start()
    w = toxicity.Words(data, offs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(data)
    monkeypatch.setattr(toxicity, "STRIP", len(data))
    whole = toxicity.Words(data, offs)
    for name in ("first", "hash", "back", "at", "grams"):
        assert np.array_equal(getattr(w, name), getattr(whole, name))


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    w = toxicity.Words(np.frombuffer(b"a b c d e f g h", np.uint8), np.array([0, 15]))
    net = toxicity.Network(w.hash[:4], rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    which, index, mask = toxicity.pick(w, np.array([0, 2]), np.array([5, 8]))
    y = np.array([1.0, 0.0])
    x = net.inputs(w, which)[0].astype(np.float64)
    loss = lambda: np.mean(np.logaddexp(0, (1 - 2 * y) * net.forward(x, index, mask)[0]))
    _, g, dx = net.gradients(x, index, mask, y)
    for name in ("Uf", "Wb", "wa", "va", "wo", "bf"):
        k = tuple(s // 2 for s in net.p[name].shape)
        old = net.p[name][k]
        net.p[name][k] = old + 1e-3
        up = loss()
        net.p[name][k] = old - 1e-3
        assert abs((up - loss()) / 2e-3 - g[name][k]) < 1e-4
        net.p[name][k] = old


def test_pipeline_stages(spark, tmp_path, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(rows[4][1].split()[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    left = {r["doc_id"] for r in got}
    near = {r["doc_id"] for r in near_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet")).filter("kept").collect()}
    assert left <= near and 4 not in left and len(left) >= len(near) - 3


def test_pipeline_decides_on_rows_with_null_and_repeated_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    a, b, c, leak = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b + " tail"), (7, c), (7, leak), (None, "x " + leak), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0], r[1] or "")
    near = sorted(map(tuple, pipeline.drop_near_duplicates(spark, docs, "").collect()), key=key)
    assert [r for r in near if r[1] in (a, c, leak)] == sorted([(1, a), (7, c), (7, leak)], key=key)
    assert sum((r[1] or "").startswith(b) for r in near) == 1 and not any(leak in (r[1] or "") for r in near if r[0] is None)
    assert (3, None) in near and (None, "") in near and len(near) == 6
    spark.createDataFrame([(None, leak), (4, prose(rng, 60)), (None, prose(rng, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(r for r in rows if leak not in (r[1] or ""))
    assert {r["item_id"] for r in decontam.contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()} == {None}
