"""WARC archives: written with revisit records and segments, read back with segment reassembly.

Reading groups continuation records by the record they continue, orders them by segment number,
verifies the total length, and undoes chunked transfer framing. An archive is the bytes of one WARC
file; archives are cells of a table that Spark's committed writer puts in the shared folder."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import stage
from ._text import batch

EPOCH = "1970-01-01T00:00:00Z"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("_origin", pa.string()), ("_number", pa.int32()), ("_total", pa.int64()), ("_block", pa.binary())])
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, _origin string, _number int, _total long, _block binary"
OUT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def records(archive: bytes):
    """(headers in lower case, block) of every record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, block
        at = end + 8 + size


def chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head, payload) of a response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return head, dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def _id(page_id, payload_digest: str, more: str = "") -> str:
    """Record id of a page's response: it follows from page and payload, so that a revisit can name it."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{payload_digest}{more}>"


def _write(more: str, page_id, url, payload: bytes, first, kind: str, segment: int, chunk: int):
    """(record, continuation records) of one page. more: what tells its record from others of the same page."""
    said = digest(payload)
    name = _id(page_id, said, f"#revisit{more}" if kind == "revisit" else more)
    common = [("WARC-Date", EPOCH), ("WARC-Target-URI", re.sub(r"[\s\x00-\x1f]+", " ", url or "").strip()), ("WARC-Payload-Digest", f"sha1:{said}")]
    if kind == "revisit":
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Refers-To", _id(first, said)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return record([*head, *common], b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)), []
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name)]
    if len(block) <= segment:
        return record([*head, *common], block), []
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    rest = []
    for k, x in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}.{k}>"), ("WARC-Date", EPOCH), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        rest.append(record([*own, ("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else own, x))
    return record([*head, *common, ("WARC-Segment-Number", "1")], parts[0]), rest


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows (page_id, url, payload, sha) with `nth`: 0, but where a page_id has the same payload more than
    once, numbers of their own for all but the first."""
    if rows.groupBy("page_id", "sha").count().filter("count > 1").isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    low = rows.groupBy("page_id", "sha").agg(F.min("row").alias("low"), F.count("*").alias("n")).filter("n > 1")
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s"))
    out = rows.join(low.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "low"), same, "left")
    return out.select("page_id", "url", "payload", "sha", F.when(F.col("row") > F.col("low"), F.col("row") + 1).otherwise(0).alias("nth"))


def write_archives(pages: DataFrame, least: int = 0, segment: int = 1 << 14, chunk: int = 1 << 12, size: int = 1 << 22) -> DataFrame:
    """The written table of archives (archive binary). pages needs page_id, url and html; other columns
    are left out.

    Of pages with equal payloads of at least `least` bytes, the smallest page_id is a response and
    the others revisit it; repeated rows of that page_id are responses too. A null html is empty; a
    null page_id is no page to refer to, so such pages revisit only pages that have one. Records of
    over `segment` bytes are cut, and what continues them goes to other archives.

    Payloads never travel by their digest: which pages are revisits is worked out on ids and digests
    alone, and what is joined to the payloads has a key of page and digest, which is not hot."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = _told_apart(rows.withColumn("sha", F.unhex(F.sha1("payload"))))
    small = rows.filter(F.octet_length("payload") >= least).select("page_id", "sha")
    first = small.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    marks = small.distinct().join(first, "sha").filter("page_id is null or page_id <> first")
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s"))
    marked = rows.join(marks.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first"), same, "left").select("page_id", "url", "payload", "first", "nth")

    def run(batches):
        open_: dict[bool, list[bytes]] = {False: [], True: []}
        held = {False: 0, True: 0}
        schema = pa.schema([("archive", pa.binary())])

        def put(more: bool, x: bytes):
            open_[more].append(x)
            held[more] += len(x)
            if held[more] >= size:
                yield close(more)

        def close(more: bool):
            out, open_[more], held[more] = batch(schema, [b"".join(open_[more])]), [], 0
            return out

        for b in batches:
            for page_id, url, payload, first, nth in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                kind = "response" if first is None else "revisit"
                main, rest = _write(f"#{nth}" if nth else "", page_id, url, payload.as_py(), first, kind, segment, chunk)
                yield from put(False, main)
                for x in rest:
                    yield from put(True, x)
        yield from (close(k) for k in (False, True) if open_[k])

    return stage(marked.mapInArrow(run, "archive binary"), "warc")


def _page(record_id: str) -> int | None:
    found = record_id.strip("<>").removeprefix("urn:page:").split(":")[0]
    return None if found == "none" else int(found)


def _row(headers: dict, block: bytes) -> tuple:
    kind = headers["warc-type"]
    origin = headers.get("warc-segment-origin-id") or headers["warc-record-id"]
    page_id = _page(origin)
    if kind == "revisit":
        return page_id, int(re.search(rb"(?im)^content-length:\s*(\d+)", block)[1]), headers["warc-payload-digest"].removeprefix("sha1:"), kind, _page(headers["warc-refers-to"]), None, None, None, None
    number = headers.get("warc-segment-number")
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if number is None:
        return page_id, *_checked(block, said), kind, None, None, None, None, None
    total = headers.get("warc-segment-total-length")
    return page_id, None, said, kind, None, origin, int(number), total and int(total), block


def _checked(block: bytes, said: str) -> tuple[int, str]:
    payload = payload_of(block)[1]
    if (found := digest(payload)) != said:
        raise ValueError(f"payload digest {found} is not {said}")
    return len(payload), found


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page's record; digests and
    lengths are of the reassembled, decoded payload and verified against the headers."""

    def parse(batches):
        for b in batches:
            for a in b.column(0):
                rows = [_row(h, x) for h, x in records(a.as_py())]
                for i in range(0, len(rows), 2000):
                    yield batch(_RECORD, *zip(*rows[i : i + 2000], strict=True))

    def join(batches):
        held: list[tuple] = []

        def whole():
            blocks = [r[8] for r in held]
            if [r[6] for r in held] != list(range(1, len(held) + 1)) or sum(map(len, blocks)) != held[-1][7]:
                raise ValueError(f"segments of {held[0][5]} are missing or of another length")
            return (held[0][0], *_checked(b"".join(blocks), held[0][2]), held[0][3], None)

        schema = pa.schema([f for f in _RECORD if f.name in OUT])
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][5] != r[5]:
                    out.append(whole())
                    held = []
                held.append(r)
            if out:
                yield batch(schema, *zip(*out, strict=True))
        if held:
            yield batch(schema, *zip(*[whole()], strict=True))

    parsed = stage(archives.mapInArrow(parse, RECORD), "records")
    segments = parsed.filter("_number is not null").repartition("_origin").sortWithinPartitions("_origin", "_number")
    joined = segments.mapInArrow(join, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return parsed.filter("_number is null").select(*OUT).unionByName(joined)


def op6(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
