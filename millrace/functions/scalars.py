"""Scalar functions as column expressions: all stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KIB, MIB, GIB = 1024, 1024**2, 1024**3


def is_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^\s*$")


def is_number(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^[0-9]+$")


def is_empty(c: Column) -> Column:
    """Null or empty collection."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def from_hex(c: Column) -> Column:
    """Bytes of an even-length hex text; null for anything else."""
    return F.when(c.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(c))


def to_hex(c: Column) -> Column:
    return F.hex(c)


def md5_hex(c: Column) -> Column:
    return F.upper(F.md5(c))


def sha1_hex(c: Column) -> Column:
    return F.upper(F.sha1(c))


def int_of_bytes(c: Column) -> Column:
    """Big-endian number of up to seven bytes."""
    return F.conv(F.hex(c), 16, 10).cast("bigint")


def bytes_of_int(c: Column) -> Column:
    """Four big-endian bytes."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))), 8, "0"))


def slice_bytes(c: Column, start: int, length: int) -> Column:
    """Bytes from `start` (0 is the first)."""
    return F.substring(c, start + 1, length)


def human_size(c: Column) -> Column:
    """nB, or KB / MB / GB to two decimals, halves up, in whole numbers throughout."""

    def in_unit(unit: int, name: str) -> Column:
        scaled = c.cast("bigint") * 100 + unit // 2
        h = ((scaled - F.pmod(scaled, F.lit(unit))) / unit).cast("bigint")
        return F.concat(((h - F.pmod(h, F.lit(100))) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(h, F.lit(100)).cast("string"), 2, "0"), F.lit(name))

    return (
        F.when(c < KIB, F.concat(c.cast("bigint").cast("string"), F.lit("B")))
        .when(c < MIB, in_unit(KIB, "KB")).when(c < GIB, in_unit(MIB, "MB")).otherwise(in_unit(GIB, "GB"))
    )


def magnet(infohash: Column) -> Column:
    return F.concat(F.lit("magnet:?xt=urn:btih:"), infohash)


def infohash_of(c: Column) -> Column:
    """Upper hex of a 40-digit hash, alone or in a magnet link; null otherwise (base32: functions.codecs)."""
    found = F.regexp_extract(c, r"(?:^|xt=urn:btih:)([0-9A-Fa-f]{40})(?:&|$)", 1)
    return F.when(found != "", F.upper(found))


def xor_distance(a: Column, b: Column) -> Column:
    """Byte-wise distance of two ids, over the shorter, as an array that sorts like the number."""
    size = F.least(F.length(a), F.length(b))
    byte = lambda c, i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: byte(a, i).bitwiseXOR(byte(b, i)))).otherwise(F.array().cast("array<int>"))


def dashed(infohash: Column) -> Column:
    """Upper hex of bytes, a dash between each two."""
    return F.regexp_replace(F.hex(infohash), "(..)(?=.)", "$1-")


def mixed_id(target: Column, own: Column) -> Column:
    """The first ten bytes of target and the last ten of own."""
    return F.concat(F.substring(target, 1, 10), F.substring(own, 11, 10))


def pages(total: Column, size: int) -> Column:
    """At least one."""
    return F.greatest(F.lit(1), F.ceil(total / size).cast("bigint"))


def pager(page: Column, pages_: Column, before: int = 3, window: int = 7) -> Column:
    """Page numbers to show: from `before` pages back, `window` more at most."""
    first = F.greatest(F.lit(1).cast("bigint"), page - before)
    return F.sequence(first, F.greatest(first, F.least(pages_, first + window)))


def is_crawler(agent: Column) -> Column:
    # fixed values: the four user agents
    return F.coalesce(agent, F.lit("")).rlike("(?i)googlebot|bingbot|baiduspider|sogou web spider")


def valid_route(kind: str, c: Column) -> Column:
    # fixed values: what each part of a route may hold
    return c.rlike({"hash": "^[A-Za-z0-9]{40}$", "date": r"^\d{4}-\d{2}-\d{2}$", "sort": "^(time|hot)$", "index": r"^\d+$"}[kind])


def cache_key(keyword: Column, index: Column, sort: Column) -> Column:
    return F.concat(F.lower(keyword), F.lit(":"), index.cast("string"), sort.cast("string"))


def command(y: Column, q: Column, commands: Sequence[str] = ("ping", "find_node", "get_peers", "announce_peer")) -> Column:
    """query:<command>, response, error or unknown of a message."""
    return F.when((y == "q") & q.isin(*commands), F.concat(F.lit("query:"), q)).when(y == "r", "response").when(y == "e", "error").otherwise("unknown")


def peer_port(implied: Column, stated: Column, packet: Column) -> Column:
    """The message's port, or the packet's if the message says that it is implied."""
    return F.when(F.coalesce(implied, F.lit(0)) == 0, stated).otherwise(packet)


def transaction_pool(spark: SparkSession, reserved: Sequence[int]) -> DataFrame:
    """id, hex of the two-byte ids that are free."""
    return spark.range(65536).filter(~F.col("id").isin(*reserved)).select("id", F.lpad(F.hex("id"), 4, "0").alias("hex"))
