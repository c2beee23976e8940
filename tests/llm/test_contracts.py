"""What the registered queries promise, by plain Python on small tables, and odd inputs of every operator."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import decontam, html_extract, near_dedup, packing, quality, sharding, span_dedup, token_shards, toxicity, warc

ODD = [(5, "one two three"), (5, "one two three"), (5, "another text of that id"), (None, "one two three"), (None, None), (7, None), (8, ""), (-3, "z " * 9000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated and null ids, null and empty texts, a long one, and columns with names that operators might use."""
    extra = "part long, id long, key long, shard string, slot string, n_bytes string, o long, x string, score string, row long, `a.b` long"
    rows = [(i, t, k, k, k, "s", "t", "u", k, "x", "y", k, k) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + extra).repartition(3)


def ids_of(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(packing.VOCABULARY).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_op2_digests_and_shards(spark, odd, tmp_path):
    got = sharding.op2(spark, write(spark, tmp_path, documents=odd)).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD]
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(want)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) == 1 and set(by) <= set(range(16))


def test_shards_keep_columns_of_any_name(odd):
    got = sharding.shard(odd, 3, group_rows=1)
    assert set(got.columns) == set(odd.columns)
    plain = [c for c in odd.columns if c not in ("shard", "slot")]
    take = lambda df: collections.Counter(tuple(r[c] for c in plain) for r in df.collect())
    assert take(got) == take(odd)
    sizes = collections.Counter(r["shard"] for r in got.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_draws_are_hypergeometric():
    from math import comb

    rng, n = random.Random(3), 20_000
    for good, bad, draws in ((3, 4, 3), (30, 70, 20), (5, 200, 100)):
        seen = collections.Counter(sharding._hypergeometric(rng, good, bad, draws) for _ in range(n))
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
            assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4
    big = [sharding._hypergeometric(rng, 10**11 // 16, 10**11 - 10**11 // 16, 160_000) for _ in range(400)]
    assert abs(np.mean(big) - 10_000) < 5 * 97 / 20 and 80 < np.std(big) < 115


def test_op3_repeated_and_null_ids(odd):
    got = token_shards.token_index(odd, tokens=50).orderBy("start").collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((i, len(x := ids_of(t, 0)), crc(x)) for i, t in ODD)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert [r["doc_id"] for r in got[:2]] == [None, None] and known == sorted(known)


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(4)
    for size, alphabet in ((3000, 4), (20_000, 300), (40, 2), (1, 1), (0, 1)):
        ids = rng.integers(0, alphabet, size).astype(np.uint32)
        cuts = np.sort(rng.integers(0, size + 1, 5))
        firsts = np.concatenate([[0], cuts, [size]])
        s, at, rules = token_shards.repair(ids, firsts, alphabet, least=4)
        full = token_shards.Shard(token_shards.encode_shard([0] * (len(firsts) - 1), ids, firsts))
        assert (full.expand(full.symbols) == ids).all()
        pairs = collections.Counter()
        for a, b in itertools.pairwise(at.tolist()):
            pairs.update(itertools.pairwise(s[a:b].tolist()))
        assert max(pairs.values(), default=0) < 4
        lengths = token_shards.rule_lengths(rules, alphabet)
        one = np.where(s < alphabet, 1, lengths[np.maximum(s.astype(int) - alphabet, 0)] if len(lengths) else 1)
        assert [one[a:b].sum() for a, b in itertools.pairwise(at.tolist())] == np.diff(firsts).tolist()


def test_op4_repeated_ids_and_items(spark):
    leak = " ".join(f"v{k}" for k in range(20))
    docs = spark.createDataFrame([(1, leak), (1, leak), (None, "a " + leak + " b"), (2, None), (3, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, leak), (9, leak), (None, leak)], "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == {(1, 9): 4, (1, None): 2, (None, 9): 2, (None, None): 1}


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 256, (300, 8)).astype(np.uint8)
    own = prints[rng.integers(0, 300, 200)].copy()
    for k in range(len(own)):
        bits = np.unpackbits(own[k])
        bits[rng.choice(64, rng.integers(0, 30), replace=False)] ^= 1
        own[k] = np.packbits(bits)
    w, i = decontam.MultiIndex(prints).near(own)
    apart = np.unpackbits(own[:, None] ^ prints[None], axis=2).sum(2)
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == {tuple(x) for x in np.argwhere(apart <= decontam.RADIUS).tolist()}


PARA = "<p>" + "body text of the article " * 20 + "</p>"
TEXT = ("body text of the article " * 20).strip()
ZONE = "<div class=zone><p>" + "see our other offers now " * 12 + "</p></div>"


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _path string")).collect()}


def test_the_vote_decides_where_no_class_tells(spark):
    page = "<body><nav><a href=/>x</a></nav><div class=story-%d>" + PARA + "</div>%s</body>"
    rows = [(i, f"http://host/{i}", page % (i, ""), "h", "p") for i in range(1, 4)] + [(4, "http://host/4", page % (4, ZONE), "h", "p"), (5, "http://alone/5", page % (5, ZONE), "h", "p")]
    got = texts_of(spark, rows)
    assert got[4] == TEXT  # the host's path leaves out what only this page has beside it
    assert got[5].startswith(TEXT + "\nsee our")  # without other pages the same page is read whole
    assert all(got[i] == TEXT for i in (1, 2, 3))


def test_equal_votes_and_odd_pages(spark):
    a, b = f"<body><div class=a>{PARA}</div></body>", f"<body><div class=b>{PARA}</div></body>"
    rows = [(1, "http://t/1", a, None, None), (2, "http://t/2", b, None, None), (None, "http://t/3", a, None, None), (1, "http://t/1", a, None, None), (7, None, "<p>" + "long \u2003\u00a0 text " * 50_000, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, x string, y string")).collect()
    assert len(got) == 5 and all(r["text"] == TEXT for r in got if r["page_id"] != 7)
    assert next(r["text"] for r in got if r["page_id"] == 7) == " ".join(["long text"] * 50_000)


def test_attributes_by_the_rules_of_html():
    read = lambda h: [b[2] for b in html_extract.text_blocks(h)]
    assert read("<p title=don't>Hello world</p><p>More text</p>") == ["Hello world", "More text"]
    assert read("<p title='a>b' class = x>one</p><p data-x=\"class=nav\">two</p><div class=nav>no</div><p a=\">three</p>") == ["one", "two", "three"]


def test_damage_never_swallows_what_follows():
    rng = random.Random(7)
    for _ in range(300):
        junk = "".join(rng.choice(["=", "'", '"', " ", "x", "a=", "='", "/", "&", "\n"]) for _ in range(rng.randrange(12)))
        tail = [b[2] for b in html_extract.text_blocks(f"<p>first</p><p {junk}>second</p><p>third</p>")]
        closed = not re.search("=\\s*['\"]", junk)
        assert tail[0] == "first" and (tail[-1] == "third" or not closed)


def test_op6_repeated_pages_and_records_that_exist(spark):
    big = "x" * 5000
    rows = [(3, "u", big), (3, "u", big), (1, "v", big), (1, "v", big), (1, "w", "other"), (2, "u", "other"), (None, "u", big), (None, None, None), (4, "u", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, sha string")
    archives = warc.write_archives(df, segment=1000, chunk=300, size=2000)
    records = [h for a in archives.collect() for h, _ in warc.records(bytes(a["archive"]))]
    names = [h["warc-record-id"] for h in records]
    assert len(set(names)) == len(names)
    assert all(h["warc-refers-to"] in names for h in records if h["warc-type"] == "revisit")
    assert all(h["warc-segment-origin-id"] in names for h in records if h["warc-type"] == "continuation")
    first = {big: 1, "other": 1, "": 4}
    want = collections.Counter()
    for p, _, h in rows:
        raw, to = (h or "").encode(), first[h or ""]
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == to else "revisit", None if p == to else to] += 1
    assert collections.Counter(map(tuple, warc.read_archives(archives).collect())) == want


def test_op6_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(df, least=3)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def labelled(spark, n=240):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if k % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["vile", "scum"])
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    return docs, labels


def test_op7_fit_learns_and_does_not_depend_on_row_order(spark):
    docs, labels = labelled(spark)
    held = {k for k, _ in docs if zlib.crc32(str(k).encode()) % 3 == 1}
    messy = [*labels, (3, 0), (4, 0), (None, 1), (5, None), (9999, 1)]  # repeated, null and unknown ones
    d, y = spark.createDataFrame(docs + docs[:20] + [(None, "vile"), (11, None)], "doc_id long, text string"), spark.createDataFrame(messy, "doc_id long, toxic int")
    nets = [toxicity.fit(a, b) for a, b in ((d, y), (d.repartition(5), y.orderBy("toxic", ascending=False)))]
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(d.filter("doc_id is not null"), nets[0]).collect()}
    right = [got[k] == y for k, y in labels if k in held]
    assert sum(right) >= 0.95 * len(right)
    flipped = [(k, 1 - t if k in held else t) for k, t in labels]  # held-out labels are never read
    again = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(flipped, "doc_id long, toxic int"))
    plain = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all((again.p[k] == plain.p[k]).all() for k in plain.p)


def test_op7_empty_tables_and_bytes(spark, odd):
    docs, labels = labelled(spark, 40)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for a, b in ((d.filter("false"), y), (d, y.filter("false")), (d, y.withColumn("toxic", y["toxic"] * 0))):
        got = toxicity.score(odd, toxicity.fit(a, b)).collect()
        assert len(got) == len(ODD) and {r["predicted"] for r in got} == {0}
    assert toxicity.score(odd.filter("false"), toxicity.fit(d, y, sample_bytes=1)).count() == 0


def test_op8_counts_and_verdict(spark):
    rng = random.Random(12)
    texts = [None, "", "# a\n# a\n\n  \nb #*$%&|<>\n# a ", "é\u00a0ü x"]
    for _ in range(60):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(3)):
            at, n = rng.randrange(len(base)), rng.randrange(1, 20)
            base[rng.randrange(len(base)):0] = base[at : at + n]
        texts.append("".join(w + rng.choice([" ", "\n", " ", "  "]) for w in base))
    got = {r["doc_id"]: r for r in quality.repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def runs(w, k):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return {x for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for x in range(i, i + k)}

    for i, t in enumerate(texts):
        w, r = re.findall(r"[^\x20\x09-\x0D]+", t or ""), got[i]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(runs(w, 8))
        longest = max((k for k in range(1, len(w)) if runs(w, k)), default=0)
        failed = len(w) < 20 or 100 * len(runs(w, 8)) > 30 * len(w)
        longest = longest if longest >= 5 else 0
        bad = len(runs(w, 5)) > 0.3 * len(w) or longest > 100 or longest > 0.15 * len(w)
        assert r["base_failed"] == failed and r["kept"] == (not failed and not bad)


def test_op9_repeated_and_null_ids(odd):
    got = packing.pack(odd, capacity=1024).collect()
    want = collections.Counter()
    for i, t in ODD:
        x = ids_of(t, 2)
        many = -(-len(x) // 1024)
        cuts = [0, *(len(x) - 1024 * k for k in range(many - 1, -1, -1))]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, b - a, crc(x[a:b])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_op1_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (4, "c")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == {(1, 1, True): 1, (2, 1, False): 1, (3, 1, False): 2, (4, 4, True): 1}


def test_op1_many_members_of_one_key(spark):
    """Chains of small edits and unrelated texts around a passage, in many small blocks."""
    rng = random.Random(21)
    same = [f"s{k}" for k in range(60)]
    texts = []
    for c in range(4):
        w = same[:45] + [f"c{c}.{k}" for k in range(15)]
        for k in range(14):
            w = list(w)
            w[rng.randrange(60)] = f"e{c}.{k}"
            texts.append(" ".join(w))
    texts += [" ".join(same[:30] + [f"u{k}.{j}" for j in range(30)]) for k in range(20)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for _ in sets:
        for i, j in itertools.combinations(range(len(sets)), 2):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[i] = group[j] = min(group[i], group[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, pivots in ((512, 16), (8, 2), (3, 1)):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, block=block, pivots=pivots, wide=2).collect()}
        assert [got[i] for i in range(len(texts))] == group


def test_op1_places_the_members_of_large_keys_once(spark, monkeypatch):
    busy = spark.createDataFrame([(k, k, r, 2, r % 2) for k in (1, 2) for r in range(6)], "key long, code int, rep long, nb int, b int")
    found = spark.createDataFrame([(r, 0) for r in range(4)], "node long, component long")
    plans, keep = [], near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name: (plans.append(df), keep(df, name))[1])
    out = near_dedup._strays(busy, found, 16, 128)
    joins = sum(df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") for df in [*plans, out])
    rows = {(r["key"], r["rep"], r["comp"], r["visits"]) for r in out.collect()}
    both = [(r, 0 if r < 4 else r) for r in range(6)]
    assert rows == {(k, r, c, 0) for k in (1, 2) for r, c in both} | {(k, r, c, 1) for k in (1, 2) for r, c in both if r >= 4}
    assert joins == 1


def test_op10_keeps_columns_of_any_name(spark, odd):
    got = span_dedup.remove_repeats(odd).collect()
    assert len(got) == len(ODD)
    by = collections.Counter((r["doc_id"], r["n_bytes"], r["o"], r["x"], r["row"], r["a.b"], r["key"]) for r in got)
    assert by == collections.Counter((i, len((t or "").encode()), k, "x", k, k, k) for k, (i, t) in enumerate(ODD))
    assert {r["shard"] for r in got} == {"s"} and sum(r["n_removed"] > 0 for r in got) == 1
