"""Directories as keyed state: listing, changes between listings, and writing a state to a directory.

Only regular files directly in the directory count. Spark's file index leaves out names with a leading
dot or underscore and empty files; those are added by the driver, up to a checked number of bytes, beyond
which reading fails. Left out are half-written files of this module (.<name>.part) and the checksum
files that a local file system keeps beside a file (.<name>.crc)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder

PREFIX = "__file/"
LISTING = "name string, content binary"


def read_directory(spark: SparkSession, url: str, most_hidden_bytes: int = 64 << 20) -> DataFrame:
    """(name, content) of each file. An empty directory has no rows."""
    folder = Folder(spark, url)
    found = folder.names(files_only=True)
    names = {n for n, _ in found}
    ours = lambda n: n[0] == "." and (n.endswith(".part") or n.endswith(".crc") and (n[1:-4] in names or n[1:-4].endswith(".part")))
    hidden = [(n, size) for n, size in found if n[0] in "._" and not ours(n)]
    if sum(size for _, size in hidden) > most_hidden_bytes:
        raise ValueError(f"hidden files of {url} have over {most_hidden_bytes} bytes")
    rows = spark.createDataFrame([(n, bytearray(folder.read(n))) for n, _ in hidden] + [(n, bytearray()) for n, size in found if not size and n[0] not in "._"], LISTING)
    if any(size for n, size in found if n[0] not in "._"):
        name = F.regexp_extract("path", "([^/]*)$", 1)  # _metadata.file_name is escaped, path is not
        rows = rows.unionByName(spark.read.format("binaryFile").load(folder.url).select(name.alias("name"), "content"))
    return rows


def as_entries(listing: DataFrame, node: int, first_seq: int, now_ms: int) -> DataFrame:
    """Puts of all files of a listing: seq follows the name's order."""
    from .store import number

    rows = number(listing.select(F.concat(F.lit(PREFIX), "name").alias("key"), F.col("content").alias("value"), F.col("name").alias("arrival")), first_seq)
    return rows.select("key", "value", F.lit(node).cast("long").alias("node"), F.col("wal_seq").alias("seq"), F.lit(now_ms).cast("long").alias("timestamp"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, value, change) from one listing to the next: put where a file is new or differs, delete (null
    value) where it is gone."""
    b, a = before.select("name", F.col("content").alias("_b"), F.lit(True).alias("_was")), after.select("name", F.col("content").alias("_a"), F.lit(True).alias("_is"))
    both = a.join(b, "name", "full")
    change = F.when(F.col("_is").isNull(), "delete").when(F.col("_was").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")), "put")
    return both.select(F.concat(F.lit(PREFIX), "name").alias("key"), F.col("_a").alias("value"), change.alias("change")).filter("change IS NOT NULL")


def news(state: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, value) of changes that the state does not have yet, so what a state wrote to the directory
    does not come back as a change of its own."""
    s = state.select("key", F.col("value").alias("_v"), F.lit(True).alias("_has"))
    fresh = F.col("_has").isNull() | ~F.col("value").eqNullSafe(F.col("_v"))
    return changes(before, after).join(s, "key", "left").filter(fresh).select("key", "value")


def due_writes(state: DataFrame, listing: DataFrame) -> DataFrame:
    """(name, content, change) that makes a directory equal to the state's files: write where it differs or
    lacks, remove where the state has a tombstone. Files that the state never had stay."""
    s = state.filter(F.col("key").startswith(PREFIX)).select(F.expr(f"substring(key, {len(PREFIX) + 1})").alias("name"), F.col("value").cast("binary").alias("content"))
    f = listing.select("name", F.col("content").alias("_f"), F.lit(True).alias("_is"))
    both = s.join(f, "name", "left")
    change = F.when(F.col("content").isNull(), F.when(F.col("_is"), "remove")).when(~F.col("content").eqNullSafe(F.col("_f")), "write")
    return both.select("name", "content", change.alias("change")).filter("change IS NOT NULL")


def write_directory(state: DataFrame, url: str, at_once: int = 8) -> int:
    """Bring a directory up to the state; how many files changed. Only changed files travel, a partition
    at a time, and `at_once` files are written side by side; names that would leave the directory are refused."""
    spark = state.sparkSession
    folder = Folder(spark, url)
    due = due_writes(state, read_directory(spark, url))

    def bring(r) -> None:
        if not r["name"] or "/" in r["name"] or r["name"] in (".", ".."):
            raise ValueError(f"no file name: {r['name']!r}")
        if r["change"] == "remove":
            folder.delete(r["name"])
        else:
            folder.write(r["name"], bytes(r["content"]))

    n, rows = 0, due.toLocalIterator()
    with ThreadPoolExecutor(at_once) as pool:
        while some := list(islice(rows, 4 * at_once)):
            n += len(list(pool.map(bring, some)))
    return n


def peer_address(state: DataFrame, peer: int) -> DataFrame:
    """The address that a node has put for a peer: no row where there is none."""
    return state.filter((F.col("key") == f"__peer_addr/{peer}") & F.col("value").isNotNull()).select(F.col("value").cast("string").alias("address"))
