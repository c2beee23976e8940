"""DuckDB twins of the queries that SQL can express, over the same tables."""

from __future__ import annotations

#: Words [^\x20\x09-\x0D]+ of a text, and a text with A-Z (and nothing else) in lower case.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN [w[i:i + 4] FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [w] ELSE [] END"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
g AS (SELECT doc_id, list_distinct([md5(array_to_string(x, ' ')) FOR x IN {_SHINGLES}]) AS s FROM d),
sized AS (SELECT doc_id, len(s)::bigint AS n FROM g),
one AS (SELECT doc_id, unnest(s) AS h FROM g),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT ways.b, reach.low FROM reach JOIN ways ON ways.a = reach.node WHERE reach.low < ways.b)
SELECT doc_id, n AS n_shingles, min(low) AS component_id, doc_id = min(low) AS kept FROM sized JOIN reach ON node = doc_id GROUP BY doc_id, n"""

OP4 = f"""
WITH i AS (SELECT *, len(w) AS n, least(len(w), 5) AS g FROM (SELECT row_number() OVER () AS r, item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT r, h, count(*) AS c FROM (SELECT r, unnest([array_to_string(w[k:k + g - 1], ' ') FOR k IN range(1, n - g + 2)]) AS h FROM i) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS x, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
grams AS (SELECT x, g, p, array_to_string(w[p + 1:p + g], ' ') AS h FROM (SELECT x, w, g, unnest(range(len(w) - g + 1)) AS p FROM d, (SELECT DISTINCT g FROM i) WHERE len(w) >= g)),
starts AS (SELECT DISTINCT x, r, g, n, m, first FROM (SELECT grams.x, s.r, grams.g, n, least(n, len(d.w)) - i.g + 1 AS m,
    unnest(CASE WHEN len(d.w) >= n THEN range(greatest(0, p + i.g - n), least(p, len(d.w) - n) + 1) ELSE [0] END) AS first
  FROM grams JOIN s USING (h) JOIN i ON i.r = s.r AND i.g = grams.g JOIN d ON d.x = grams.x)),
windows AS (SELECT starts.x, r, first, any_value(n) AS n, any_value(m) AS m, any_value(starts.g) AS g, h, count(*) AS c
  FROM starts JOIN grams ON grams.x = starts.x AND grams.g = starts.g AND p BETWEEN first AND first + m - 1 GROUP BY starts.x, r, first, h),
alike AS (SELECT x, r, first, any_value(m + g - 1) AS n_words, sum(least(windows.c, s.c)) AS b, any_value(n - g + 1 + m) AS total FROM windows JOIN s USING (r, h) GROUP BY x, r, first)
SELECT doc_id, item_id, first::bigint AS start_word, n_words::bigint AS n_words, b::double / (total - b)::double AS similarity
FROM alike JOIN d USING (x) JOIN i USING (r) WHERE b >= 0.75 * (total - b) QUALIFY row_number() OVER (PARTITION BY x, r ORDER BY b::double / (total - b)::double DESC, first) = 1"""

#: The alphabet of base32 (a fixed value).
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five bits at a time of the 160 bits of a digest that is given in hex digits.
_DIGEST = f"""list_aggregate([substr('{_BASE32}', 1 + (('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2))::bigint >> (3 - (5 * i) % 4)) % 32, 1) FOR i IN range(32)], 'string_agg', '')"""

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, strlen(h)::bigint AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def _repeated(k: int) -> str:
    """Words of each text (table w: doc_id, i, word) in runs of k words that are found twice or more in it."""
    return f"""SELECT doc_id, count(DISTINCT i + j) AS n FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times FROM (
    SELECT doc_id, i, string_agg(word, ' ') OVER u AS run, count(*) OVER u AS size FROM w WINDOW u AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING))
  WHERE size = {k}), range({k}) t(j) WHERE times > 1 GROUP BY doc_id"""


#: ranks(level, doc_id, i, r): places of words whose next 2**level words are alike have equal r. Level by level a
#: text's neighbours in the last order are compared from the longest runs down, which gives their common prefix.
OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
levels AS (SELECT ceil(log2(greatest(2, max(len(ws)))))::int AS top FROM d),
ranks AS (
  SELECT 0 AS level, doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY word) AS r FROM w
  UNION ALL
  SELECT level + 1, doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY r, coalesce(other, 0)) FROM (
    SELECT level, doc_id, i, r, lead(r, 1) OVER (PARTITION BY doc_id, i % (1::bigint << level) ORDER BY i) AS other FROM ranks) WHERE level < (SELECT top FROM levels)),
pairs AS (SELECT doc_id, i AS a, lag(i) OVER (PARTITION BY doc_id ORDER BY r) AS b FROM ranks WHERE level = (SELECT top FROM levels)),
common AS (
  SELECT doc_id, a, b, 0::bigint AS n, (SELECT top FROM levels) AS level FROM pairs WHERE b IS NOT NULL
  UNION ALL
  SELECT c.doc_id, c.a, c.b, c.n + CASE WHEN x.r = y.r AND greatest(c.a, c.b) + c.n + (1::bigint << (c.level - 1)) - 1 <= len(d.ws) THEN 1::bigint << (c.level - 1) ELSE 0 END, c.level - 1
  FROM common c JOIN d ON d.doc_id = c.doc_id LEFT JOIN ranks x ON x.level = c.level - 1 AND x.doc_id = c.doc_id AND x.i = c.a + c.n
  LEFT JOIN ranks y ON y.level = c.level - 1 AND y.doc_id = c.doc_id AND y.i = c.b + c.n WHERE c.level > 0),
long AS (SELECT doc_id, max(n) AS n FROM common WHERE level = 0 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
eight AS ({_repeated(8)}), five AS ({_repeated(5)}),
m AS (SELECT doc_id, len(ws)::bigint AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::bigint AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols, coalesce(lines.n, 0)::bigint AS n_dup_lines, coalesce(eight.n, 0)::bigint AS n_repeat_words,
  coalesce(eight.n, 0)::bigint AS covered_words, CASE WHEN long.n >= 8 THEN long.n ELSE 0 END::bigint AS longest_repeat,
  coalesce(five.n, 0) AS short_words, CASE WHEN long.n >= 5 THEN long.n ELSE 0 END AS longest
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN eight USING (doc_id) LEFT JOIN five USING (doc_id) LEFT JOIN long USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, base_failed,
  NOT base_failed AND short_words <= 0.3 * n_words AND longest <= 100 AND longest <= 0.15 * n_words AS kept FROM v"""

#: Texts as hex digits, in blocks of 256 bytes and what their windows reach beyond, so that windows are cut from short strings.
OP10 = """
WITH d AS (SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS x FROM documents),
c AS (SELECT doc_id, 256 * k AS begin_at, substr(x, 512 * k + 1, 2 * (256 + 99)) AS y FROM (SELECT doc_id, x, unnest(range(greatest(0, (strlen(x) // 2 - 100) // 256 + 1))) AS k FROM d WHERE strlen(x) >= 200)),
h AS (SELECT doc_id, begin_at + j AS p, md5_number(substr(y, 2 * j + 1, 200)) AS h FROM (SELECT doc_id, begin_at, y, unnest(range(least(256, strlen(y) // 2 - 99))) AS j FROM c)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS again FROM h),
e AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM f WHERE again),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM e),
s AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM i GROUP BY doc_id, span),
k AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS b, s AS e FROM s UNION ALL SELECT doc_id, max(e), NULL FROM s GROUP BY doc_id),
r AS (SELECT doc_id, string_agg(substr(x, 2 * b + 1, 2 * (coalesce(e, strlen(x) // 2) - b)), '' ORDER BY b) AS x FROM k JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(e - s)::bigint AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, (strlen(d.x) // 2)::bigint AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(r.x, d.x))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op4_decontaminate": OP4, "op6_warc": OP6, "op8_quality": OP8, "op10_span_dedup": OP10}
