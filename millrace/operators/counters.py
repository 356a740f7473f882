"""Popularity counters: two-level sums, thresholds with carry-over, word counts, Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_counter(line: Column) -> tuple[Column, Column]:
    """Key and count of `key` or `key:n` (n is 1 if it is missing or no number)."""
    part = F.split(F.trim(line), ":")
    return part[0], F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("bigint"), F.lit(1).cast("bigint"))


def sum_by(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Sums by key: partial sums before the shuffle, spilled by Spark where they don't fit."""
    return df.groupBy(*keys).agg(F.sum(n).alias("total"))


def threshold(totals: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(keys to apply, keys carried over to the next run)."""
    return totals.filter(F.col("total") >= least), totals.filter(F.col("total") < least)


def hourly(df: DataFrame, time: str, key: str) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", time).alias("hour"), key).agg(F.count("*").alias("n"))


def word_frequency(words: DataFrame, column: str) -> DataFrame:
    """In how many rows each word of an array column occurs."""
    return words.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("num"))


def grouped_words(df: DataFrame, group: str, kind: str, word: str, order: str) -> DataFrame:
    """A row a group: its first type and its words by falling order."""
    return df.groupBy(group).agg(
        F.min_by(kind, F.struct(F.col(order), F.col(word))).alias("type"),
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(order, word)))), lambda x: x[word]).alias("words"),
    )


#: Filters up to this size (4 MiB) are sent to every task as one bitmap; the bits of larger ones are joined.
BITMAP_BITS = 1 << 25


def bloom_size(keys: int, rate: float = 0.01) -> tuple[int, int]:
    """(hashes, bits) with which a filter of so many distinct keys errs at about the rate; bits are whole words of 64."""
    per_key = -math.log(max(rate, 1e-12)) / math.log(2) ** 2
    return max(1, round(per_key * math.log(2))), 64 * max(1, math.ceil(keys * per_key / 64))


def bloom_places(key: Column, hashes: int, bits: int) -> list[Column]:
    """Bit places of a key, with fixed seeds."""
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in range(hashes)]


def bloom_filter(df: DataFrame, key: str, hashes: int, bits: int) -> DataFrame:
    """The filter as rows (word, set): its words of 64 bits that aren't zero."""
    place = df.select(F.explode(F.array(*bloom_places(F.col(key), hashes, bits))).alias("__bit"))
    return place.groupBy(F.floor(F.col("__bit") / 64).alias("word")).agg(F.bit_or(_bit(F.col("__bit"))).alias("set"))


def bloom_might_contain(df: DataFrame, key: str, bloom: DataFrame, hashes: int, bits: int, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """df with might_contain: whether all bits of a row's key are set; null for a null key.

    A filter of at most bitmap_bits is tested where the rows are, without a shuffle; of a larger one the words are joined
    with the distinct keys' places. Both give the same."""
    held = F.when(F.col(key).isNotNull(), F.col("__all"))
    if bits <= bitmap_bits:
        words = bloom.sparkSession.range(bits // 64).join(bloom, F.col("id") == F.col("word"), "left").select("id", F.coalesce("set", F.lit(0).cast("bigint")).alias("set"))
        bitmap = words.agg(F.array_sort(F.collect_list(F.struct("id", "set"))).alias("w")).select(F.col("w.set").alias("__words"))
        is_set = [F.get("__words", F.floor(p / 64).cast("int")).bitwiseAND(_bit(p)) != 0 for p in bloom_places(F.col(key), hashes, bits)]
        return df.join(F.broadcast(bitmap)).select(*df.columns, F.when(F.col(key).isNotNull(), reduce(Column.__and__, is_set)).alias("might_contain"))
    places = F.explode(F.array(*bloom_places(F.col("__key"), hashes, bits))).alias("__bit")
    keys = df.select(F.col(key).alias("__key")).distinct().select("__key", places).withColumn("__word", F.floor(F.col("__bit") / 64))
    joined = keys.join(bloom, F.col("__word") == F.col("word"), "left")
    hits = joined.groupBy("__key").agg(F.bool_and(F.coalesce(F.col("set").bitwiseAND(_bit(F.col("__bit"))) != 0, F.lit(False))).alias("__all"))
    return df.join(hits, df[key] == hits["__key"], "left").select(*df.columns, held.alias("might_contain"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
