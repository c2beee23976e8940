"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text that their blocks hold; a container's path is its tags
and classes from the body down, with numbers taken out. From its best container a page climbs to the
smallest one that holds all text of the article or main element around it; without such an element,
or if that holds too little of the page, all text of the page that is not skipped. Pages vote for the
path they come to, hosts count the votes in Spark, and each page is read again at its host's winning
path, after the same climb inside its article (at its own one, where the host's holds too little)."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import map_arrow, stage
from ._text import batch

#: Elements by what they mean for text.
SKIPPED = frozenset("head script style noscript template title nav header footer aside form button select textarea iframe object svg math menu dialog canvas audio video".split())
RAW = frozenset("script style noscript template title textarea iframe svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address center details summary fieldset hgroup".split()) | SKIPPED
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary address".split())
FRAMES = frozenset("article main".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
UNWANTED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|nav\w*|menu|breadcrumbs?|header|masthead|footer|notices?|cookies?|consent|popup|modal|newsletter|subscri\w*|share|social|related|recommend\w*|comments?|respond|replies|disqus|widget|pagination|pager|toolbar|skip)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

#: Quotes hold a value only right after an equals sign, and only if they are closed; elsewhere they are
#: characters like others, so a stray one swallows nothing.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_GAPS = re.compile(r"\s+")


def host_of(column):
    """Host of a URL column in lower case, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(column, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def text_blocks(page: str):
    """(path, text, characters in links) of each block in page order, outside what is skipped. path: the
    names of the block's ancestors from the outermost, itself last."""
    stack: list[tuple[str, str, bool]] = []  # tag, name, skipped
    held: list[str] = []
    linked = in_link = at = 0
    skipped = 0

    def flush():
        nonlocal linked, in_link
        text = _GAPS.sub(" ", entities.unescape("".join(held))).strip() if held else ""
        held.clear()
        n, linked, in_link = linked, 0, 0
        if text:
            yield [x[1] for x in stack], stack[-1][0] if stack else "", text, n

    def pop():
        nonlocal skipped
        skipped -= stack.pop()[2]

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        to = m.start() if m else end
        if to > at and not skipped:
            held.append(page[at:to])
            linked += (to - at) * (in_link > 0)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not skipped:
                held.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag == "br" and not skipped:
            held.append(" ")
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in VOID or tag not in BLOCKS:
            continue
        if not skipped:
            yield from flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in ("td", "th", "table") and tag in CLOSED_BY_BLOCK:
                    break
            continue
        if stack and stack[-1][0] in CLOSED_BY_BLOCK:
            pop()
        if tag in SAME_LEVEL:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME_LEVEL[tag]:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
        name, out = tag, tag in SKIPPED
        if m[3]:
            found: dict[str, str] = {}
            for k, x, y, z in _ATTRIBUTE.findall(m[3]):
                found.setdefault(k.lower(), x or y or z)  # of a repeated attribute the first counts
            if classes := re.sub(r"\d+", "", found.get("class", "")).split():
                name += "." + ".".join(sorted(set(classes)))
            out = out or tag not in ("html", "body", "article", "main") and bool(UNWANTED.search(found.get("class", "")) or UNWANTED.search(found.get("id", "")))
            out = out or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag in RAW:  # its content is no markup
            close = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else (end if tag in ("script", "style", "title", "textarea") else at)
            continue
        stack.append((tag, name, out))
        skipped += out
    yield from flush()


def paths(page: str) -> tuple[dict[str, float], dict[str, float], list[tuple[str, str]]]:
    """(score of each container path, text below each path, blocks as (path, text)). The empty path is
    the page. Text in links counts against both, but a page's h1 may be a link."""
    scores: dict[str, float] = {}
    below: dict[str, float] = {"": 0.0}
    blocks = []
    for names, tag, text, linked in text_blocks(page):
        path = ">".join(names)
        blocks.append((path, text))
        container = names[:-1] if tag in LEAVES else names
        while container and container[-1].split(".")[0] in ("ul", "ol", "dl", "tr", "tbody", "thead", "table"):
            container = container[:-1]
        value = max(0.0, len(text) - 2.0 * min(linked, len(text)))
        for share in (1.0, 0.4):  # the container, and the one around it
            if not container:
                break
            key = ">".join(container)
            scores[key] = scores.get(key, 0.0) + share * value
            container = container[:-1]
        value = float(len(text)) if tag == "h1" else value
        while path:
            below[path] = below.get(path, 0.0) + value
            path = path.rpartition(">")[0]
        below[""] += value
    return scores, below, blocks


def best_path(scores: dict[str, float]) -> str:
    return min(scores, key=lambda p: (-scores[p], len(p), p)) if scores else ""


def frame(path: str) -> str:
    """The outermost article or main element of a path; the empty path where there is none."""
    names = path.split(">")
    return next((">".join(names[: k + 1]) for k, n in enumerate(names) if n.split(".")[0] in FRAMES), "")


def root(path: str) -> str:
    """The html or body element that a path begins at; the empty path for part of a page."""
    first = path.split(">")[0]
    return first if first.split(".")[0] in ("html", "body") else ""


def climb(path: str, top: str, below: dict[str, float]) -> str:
    """The smallest container from path up to top that holds all text of top."""
    while path != top and below.get(path, 0.0) < below.get(top, 0.0):
        path = path.rpartition(">")[0]
    return path


def main_path(scores: dict[str, float], below: dict[str, float], nearly: float = 0.9) -> str:
    """Where a page's main text is by the page alone. An article or main element ends the climb if it
    holds `nearly` all of the page's text."""
    path = best_path(scores)
    top = root(path)
    path = climb(path, frame(path) or top, below)
    return path if below[path] >= nearly * below[top] else climb(path, top, below)


def page_path(scores: dict[str, float], below: dict[str, float], path: str | None, least: float = 0.5) -> str:
    """Where a page is read: from its host's path up, if that holds more than `least` of what its own path
    does. So what stands beside the host's path on this page alone goes, and a page of another layout,
    where the host's path has the smaller part, is read by itself."""
    own = main_path(scores, below)
    if not path or path not in below:
        return own
    path = climb(path, frame(path) or path, below)
    return path if below[path] > least * below[own] else own


def read_at(blocks: list[tuple[str, str]], path: str) -> list[str]:
    return [t for p, t in blocks if not path or p == path or p.startswith(path + ">")]


def extract(pages: DataFrame, salts: int = 16, most_broadcast: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars: one row a page. A null or empty html, or one without blocks, gives
    the empty text. Pages without a host vote together. Equal votes go to the path that sorts first.

    A page's vote is one row of host and path, added up before the shuffle, so a hot host is no hot
    task. Winners (one row a host) are broadcast up to most_broadcast hosts; beyond, pages of a host
    are spread over `salts` keys."""
    base = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("_host"))

    def vote(b):
        out = [main_path(*paths(h or "")[:2]) for h in b.column(1).to_pylist()]
        yield batch(pa.schema([("_host", pa.string()), ("_path", pa.string())]), b.column(0), out)

    votes = map_arrow(base.select("_host", "html"), vote, "_host string, _path string")
    counted = votes.filter("_path <> ''").groupBy("_host", "_path").count()
    winners = counted.groupBy("_host").agg(F.min_by("_path", F.struct(-F.col("count"), "_path")).alias("_path"))
    winners = stage(winners, "paths")
    if winners.count() <= most_broadcast:
        joined = base.join(F.broadcast(winners), "_host", "left")
    else:
        spread = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = base.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["_host", "_salt"], "left")

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def read(b):
        texts = []
        for page, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            scores, below, blocks = paths(page or "")
            texts.append("\n".join(read_at(blocks, page_path(scores, below, path))))
        yield batch(schema, b.column(0), b.column(1), texts, [len(t) for t in texts])

    return map_arrow(joined.select("page_id", "url", "html", "_path"), read, "page_id long, url string, text string, n_chars long")


def op5(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
