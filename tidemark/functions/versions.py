"""Columns on versioned entries: key string, value binary or string (null: tombstone), node, seq,
timestamp (epoch milliseconds). A version is (timestamp, node, seq), compared in that order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = "key string, value binary, node long, seq long, timestamp long"
FIELDS = ["key", "value", "node", "seq", "timestamp"]


def version() -> Column:
    return F.struct("timestamp", "node", "seq")


def forced(now_ms: int) -> Column:
    """A timestamp above the entry's own one and not before now; the largest one stays what it is."""
    most = (1 << 63) - 1
    above = F.when(F.col("timestamp") < most, F.col("timestamp") + F.when(F.col("timestamp") < most, 1).otherwise(0)).otherwise(most)
    return F.greatest(F.lit(now_ms).cast("long"), above)


def is_tombstone() -> Column:
    return F.col("value").isNull()


def size_bytes() -> Column:
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def weight() -> Column:
    """What an entry counts against a page's byte budget."""
    return size_bytes() + 32


def little_endian_hex(column: Column, n: int) -> Column:
    """The low n bytes of an integer, lowest first, as hex digits."""
    h = F.lpad(F.hex(column.cast("long")), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(n)])


def canonical_hex() -> Column:
    """The entry's canonical, length-prefixed encoding as hex digits."""
    value = F.concat(F.lit("01"), little_endian_hex(F.octet_length("value"), 4), F.hex("value"))
    return F.concat(little_endian_hex(F.octet_length("key"), 4), F.hex("key"), little_endian_hex(F.col("node"), 4), little_endian_hex(F.col("seq"), 8), little_endian_hex(F.col("timestamp"), 8), F.when(is_tombstone(), "00").otherwise(value))
