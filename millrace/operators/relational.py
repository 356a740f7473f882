"""Listing, lookup, paging, joins and set operations over entity tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.storage import scratch

PAGE_SIZE, MAX_PAGES = 15, 1000


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Both ends inclusive; an end that is None is open."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    return df if end is None else df.filter(F.col(column) <= F.lit(end))


def listing_filter(df: DataFrame, *, time: str = "createtime", start=None, end=None, flag: str = "isdanger", flagged: bool | None = None) -> DataFrame:
    """Optional time range and flag; both reach the scan as pushed filters."""
    df = in_range(df, time, start, end)
    return df if flagged is None else df.filter(F.col(flag) == flagged)


def day_window(df: DataFrame, column: str, day: date) -> DataFrame:
    """A day and the instant at which it ends, both included."""
    begin = datetime(day.year, day.month, day.day)
    return in_range(df, column, begin, begin + timedelta(days=1))


def page(df: DataFrame, order: Sequence[Column], index: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows of a page (1 is the first) in a total order."""
    return df.orderBy(*order).offset((index - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: Sequence[Column], index: int, size: int = PAGE_SIZE, cap: int = PAGE_SIZE * MAX_PAGES) -> DataFrame:
    """A page, each row with the number of rows in all (at most cap): two aggregates of one scan, no window over all rows."""
    total = df.agg(F.least(F.count("*"), F.lit(cap)).alias("total"))
    return page(df, order, index, size).join(F.broadcast(total))


#: Up to so many rows, a page is taken from the first rows of each task's own sort.
NEAR = 100_000


def page_from(df: DataFrame, order: Sequence[Column], start: int, size: int, near: int = NEAR) -> DataFrame:
    """Rows start to start + size of a total order. Far from the beginning, rows are dealt by ranges of the order into a written
    table whose parts are counted, and only the parts that hold the page are sorted: no task passes all rows before it."""
    if start + size <= near:
        return df.orderBy(*order).offset(start).limit(size)
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    df.repartitionByRange(*order).select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("part")).write.parquet(path)
    parts = spark.read.parquet(path)
    before, wanted, skip = 0, [], 0
    for part, n in sorted(map(tuple, parts.groupBy("part").count().collect())):  # a row a partition
        if before < start + size and before + n > start:
            skip = skip if wanted else start - before
            wanted.append(part)
        before += n
    return parts.filter(F.col("part").isin(*wanted) if wanted else F.lit(False)).select("row.*").orderBy(*order).offset(skip).limit(size)


def clamped_page(df: DataFrame, order: Sequence[Column], index: int, size: int, near: int = NEAR) -> DataFrame:
    """The page, or the last `size` rows if it lies beyond the end. Counts the rows first (a job of its own)."""
    start, total = (index - 1) * size, df.count()
    return page_from(df, order, start if total > start else max(0, total - size), size, near)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows after a key: the scan reads only row groups beyond it."""
    return df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def sort_mode(mode: int, score: str = "score", time: str = "createtime", hot: str = "downnum", key: str = "id") -> list[Column]:
    """1: score, then time; 2: time; 3: popularity; all descending, the key breaks ties."""
    return {1: [F.desc(score), F.desc(time)], 2: [F.desc(time)], 3: [F.desc(hot)]}[mode] + [F.asc(key)]


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value)).limit(1)


def exists_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """keys with a column found."""
    return keys.join(df.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def hydrate(entities: DataFrame, files: DataFrame, on: str, flag: str | None = None) -> DataFrame:
    """Entities with their files, or null; one equi-join in place of a lookup a row. flag: only where it is true."""
    if flag is None:
        return entities.join(files, on, "left")
    f = files.withColumn("__on", F.col(on)).drop(on)
    return entities.join(f, (entities[on] == f["__on"]) & entities[flag], "left").drop("__on")


def dirty_join(dirty: DataFrame, entities: DataFrame, on: str) -> DataFrame:
    return entities.join(dirty.select(on).distinct(), on, "left_semi")


def split_known(batch: DataFrame, entities: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows to update, rows to insert)."""
    return batch.join(entities.select(on), on, "left_semi"), batch.join(entities.select(on), on, "left_anti")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Spark keeps n rows a group before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def not_blocked(df: DataFrame, blocks: DataFrame, on: str, time: str, until: str = "until") -> DataFrame:
    """Rows whose key isn't blocked at their time: blocks are first reduced to the latest end of each key."""
    b = blocks.groupBy(F.col(on).alias("__on")).agg(F.max(until).alias("__until"))
    return df.join(b, (df[on] == F.col("__on")) & (F.col("__until") > df[time]), "left_anti")


def newest(df: DataFrame, order: str, most: int = 50_000) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(most)


def _words(c: str) -> list[Column]:
    """An id of up to 21 bytes as three whole numbers of seven bytes each; what a shorter id lacks counts as zero."""
    return [F.conv(F.hex(F.rpad(F.substring(F.coalesce(F.col(c), F.lit(b"")), 7 * k + 1, 7), 7, F.lit(b"\x00"))), 16, 10).cast("bigint") for k in range(3)]


def nearest_by_xor(targets: DataFrame, nodes: DataFrame, *, target: str, node: str, n: int = 8, about: int = 32) -> DataFrame:
    """The n nodes with the smallest XOR distance to each target, each with its rank; ties by the columns of nodes.

    Ids that share a longer prefix are nearer. So nodes lie in buckets by their first bits, as many that a bucket holds about
    `about` of them, and a target needs the buckets in the order of their prefixes' distance from its own until they hold n
    nodes. Which those are comes from the buckets' counts alone: of the prefixes of its bucket the longest that n nodes share
    has all of them. Then targets meet nodes by an equi-join on the bucket. At most n nodes of one id are kept beforehand, so
    an id that very many rows share is no large bucket."""
    tie = [F.asc(c) for c in nodes.columns if c != node]
    far = nodes.withColumns({f"__n{k}": c for k, c in enumerate(_words(node))})
    far = top_per_group(far, [f"__n{k}" for k in range(3)], tie or [F.asc(node)], n).drop("rank")
    bits = max(0, min(40, int(math.log2(max(1, nodes.count()) / about))) if nodes.limit(about + 1).count() > about else 0)
    bucket = lambda word: F.shiftright(word, 56 - bits)
    far = far.withColumn("__bucket", bucket(F.col("__n0")))
    counts = far.groupBy("__bucket").agg(F.count("*").alias("__count"))  # a row for some dozens of nodes
    levels = F.sequence(F.lit(0), F.lit(bits))
    shared = counts.withColumn("__up", F.explode(levels)).withColumn("__prefix", F.expr("shiftright(__bucket, __up)"))
    enough = shared.groupBy("__up", "__prefix").agg(F.sum("__count").alias("__all")).filter((F.col("__all") >= n) | (F.col("__up") == bits))
    near = targets.withColumns({f"__t{k}": c for k, c in enumerate(_words(target))})
    own = near.select(bucket(F.col("__t0")).alias("__mine")).distinct()
    # the buckets below the longest prefix that n nodes share, nearest first, until they hold n
    asked = own.withColumn("__up", F.explode(levels)).withColumn("__prefix", F.expr("shiftright(__mine, __up)"))
    least = asked.join(enough.select("__up", "__prefix"), ["__up", "__prefix"]).groupBy("__mine").agg(F.min("__up").alias("__up"))
    least = least.withColumn("__prefix", F.expr("shiftright(__mine, __up)"))
    before = Window.partitionBy("__mine").orderBy(F.col("__bucket").bitwiseXOR(F.col("__mine"))).rowsBetween(Window.unboundedPreceding, -1)
    wanted = least.join(shared, ["__up", "__prefix"]).withColumn("__held", F.coalesce(F.sum("__count").over(before), F.lit(0))).filter(F.col("__held") < n)
    pairs = near.withColumn("__mine", bucket(F.col("__t0"))).join(wanted.select("__mine", "__bucket"), "__mine").join(far, "__bucket")
    distance = F.struct(*(F.col(f"__t{k}").bitwiseXOR(F.col(f"__n{k}")).alias(f"w{k}") for k in range(3)))
    pairs = pairs.select(*nodes.columns, *targets.columns, distance.alias("distance"))
    return top_per_group(pairs, targets.columns, [F.asc("distance"), *tie], n)


def merge_distinct(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(list(keys))


def outside_ranges(df: DataFrame, ranges: DataFrame, value: str, start: str = "start", end: str = "end", max_ranges: int = 100_000, max_blocks: int = 1_000_000) -> DataFrame:
    """Rows whose value lies in none of a checked number of ranges (both ends included); a null value lies in none.

    Overlapping ranges are merged, and each is dealt to the blocks of 2^16 values that it touches, of which there may be
    max_blocks in all: a row meets the ranges of its own block alone, by an equi-join."""
    if ranges.limit(max_ranges + 1).count() > max_ranges:
        raise ValueError(f"more than {max_ranges} ranges")
    given = ranges.select(F.col(start).cast("bigint").alias("a"), F.col(end).cast("bigint").alias("b")).filter("a <= b")
    so_far = Window.orderBy("a", "b")  # over a checked number of rows
    fresh = given.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    merged = fresh.withColumn("group", F.sum(F.col("new").cast("int")).over(so_far)).groupBy("group").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    blocks = F.shiftright("b", 16) - F.shiftright("a", 16) + 1
    if (merged.agg(F.sum(blocks)).first()[0] or 0) > max_blocks:
        raise ValueError(f"ranges of more than {max_blocks} blocks")
    dealt = merged.select("a", "b", F.explode(F.sequence(F.shiftright("a", 16), F.shiftright("b", 16))).alias("block"))
    at = df[value].cast("bigint")
    return df.join(F.broadcast(dealt), (F.shiftright(at, 16) == dealt["block"]) & (df[value] >= dealt["a"]) & (df[value] <= dealt["b"]), "left_anti")
