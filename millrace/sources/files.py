"""File sources and sinks: entity JSON, counters, word and retry lists, record files, LIFO stores, metainfo, packets."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from millrace.operators.counters import parse_counter
from millrace.sources import records

ENTITY_JSON = "InfoHash string, Name string, FileSize bigint, Files string"


def entity_json(spark: SparkSession, path: str) -> DataFrame:
    """One object a file, to any folder depth; the file's time is createtime; blank and malformed files are skipped."""
    reader = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
    return reader.schema(ENTITY_JSON).json(path).withColumn("createtime", F.col("_metadata.file_modification_time")).filter("InfoHash IS NOT NULL")


def counters(spark: SparkSession, path: str, *, older_than: str | None = None) -> DataFrame:
    """key, n of counter files; older_than: only files last changed before that time (ISO)."""
    reader = spark.read.option("recursiveFileLookup", True)
    if older_than:
        reader = reader.option("modifiedBefore", older_than)
    key, n = parse_counter(F.col("value"))
    return reader.schema("value string").text(path).filter(F.trim("value") != "").select(key.alias("key"), n.alias("n"), F.col("_metadata.file_path").alias("file"))


def retry_list(spark: SparkSession, path: str, done: DataFrame) -> DataFrame:
    """Hashes of lines `hash:...` that aren't in done (infohash), of each file those above its first blank line."""
    whole = spark.read.option("pathGlobFilter", "*.retry").schema("value string").text(path, wholetext=True)
    above = F.regexp_replace("value", r"(?s)(^|\n)[ \t\r]*\n.*", "")
    lines = whole.select(F.explode(F.split(above, r"\r?\n")).alias("value")).filter(F.col("value").contains(":"))
    return lines.select(F.substring("value", 1, 40).alias("infohash")).distinct().join(done.select("infohash"), "infohash", "left_anti")


def word_list(spark: SparkSession, path: str) -> list[str]:
    """Terms, one a line; a list that a person keeps, so it fits the driver."""
    return [r.value for r in spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''").distinct().orderBy("value").collect()]


def settings(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """Nested JSON settings over typed defaults."""

    def over(base: Any, own: Any) -> Any:
        if isinstance(base, dict) and isinstance(own, dict):
            return {k: over(base[k], own[k]) if k in base and k in own else base.get(k, own.get(k)) for k in base | own}
        return type(base)(own) if base is not None and not isinstance(base, dict | list) else own

    file = Path(path)
    return over(defaults, json.loads(file.read_text())) if file.exists() else defaults


def metainfo_files(spark: SparkSession, path: str) -> DataFrame:
    from millrace.functions.codecs import metainfo

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", metainfo(F.col("content")).alias("record"))


def jdbc(spark: SparkSession, url: str, table: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database; with key and bounds it is read in that many ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write_daily_json(df: DataFrame, path: str, time: str = "createtime") -> None:
    df.withColumn("dt", F.date_format(time, "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path)


def write_hourly_counters(df: DataFrame, path: str, time: str, key: str) -> None:
    """Lines key:n in a folder an hour."""
    hours = df.groupBy(F.date_format(time, "yyyy-MM-dd-HH").alias("hour"), key).agg(F.count("*").alias("n"))
    hours.select("hour", F.concat_ws(":", key, "n").alias("value")).write.mode("append").partitionBy("hour").text(path)


def sitemap(df: DataFrame, url: str, time: str) -> DataFrame:
    """One XML text with the latest change."""
    form = F.lit("<?xml version=\"1.0\" encoding=\"utf-8\"?><urlset><url><loc>%s</loc><lastmod>%s</lastmod></url></urlset>")
    return df.agg(F.max(time).alias("t")).select(F.printf(form, F.lit(url), F.date_format("t", "yyyy-MM-dd HH:mm:ss")).alias("xml"))


LIFO_HEADER = struct.Struct("<qqq")


def lifo_push(path: str, records: list[bytes]) -> None:
    """Appends records, each with a pointer to the one before it; the header moves last."""
    file = Path(path)
    data = bytearray(file.read_bytes()) if file.exists() else bytearray(LIFO_HEADER.pack(0, 0, LIFO_HEADER.size))
    count, last, end = LIFO_HEADER.unpack_from(data)
    for record in records:
        data[end:] = struct.pack("<qi", last, len(record)) + record
        count, last, end = count + 1, end, len(data)
    LIFO_HEADER.pack_into(data, 0, count, last, end)
    file.write_bytes(bytes(data))


class LifoStore(DataSource):
    """A LIFO store, the latest record first (seq 0)."""

    @classmethod
    def name(cls) -> str:
        return "lifo_store"

    def schema(self) -> str:
        return "seq bigint, value binary"

    def reader(self, schema):
        return _LifoReader(self.options["path"])


class _LifoReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple[int, bytes]]:
        with open(self.path, "rb") as file:
            count, at, _ = LIFO_HEADER.unpack(file.read(LIFO_HEADER.size))
            for seq in range(count):
                file.seek(at)
                at, size = struct.unpack("<qi", file.read(12))
                yield seq, file.read(size)


def register(spark: SparkSession) -> None:
    records.register(spark)
    spark.dataSource.register(LifoStore)
