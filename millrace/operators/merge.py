"""Keyed merges by declared rules: upserts over plain tables as one full outer join.

Rules, a column each: overwrite (the batch wins if it gives a value), replace (the batch wins, null too), add, sticky
(true stays true), insert_only (kept once set), latest (the greater).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.storage import scratch

RULES: dict[str, Callable[[Column, Column], Column]] = {
    "overwrite": lambda old, new: F.coalesce(new, old),
    "add": lambda old, new: F.when(old.isNull() & new.isNull(), None).otherwise(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))),
    "sticky": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
    "insert_only": lambda old, new: F.coalesce(old, new),
    "latest": lambda old, new: F.greatest(old, new),
}


def fold(batch: DataFrame, keys: Sequence[str], rules: Mapping[str, str], order: str | None = None) -> DataFrame:
    """One row a key: what applying the batch's rows in order would give. Without an order the greatest value of a column
    counts as its last and the least as its first, so that a rerun gives the same."""
    if order is None:
        of = {"overwrite": F.max, "add": F.sum, "sticky": F.bool_or, "insert_only": F.min, "latest": F.max, "replace": F.max}
        return batch.groupBy(*keys).agg(*(of[rule](c).alias(c) for c, rule in rules.items()))
    by = F.col(order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), by))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), by))
    of = {
        "overwrite": last, "add": lambda c: F.sum(c), "sticky": lambda c: F.bool_or(c), "insert_only": first,
        "latest": lambda c: F.max(c), "replace": lambda c: F.max_by(c, by),
    }
    return batch.groupBy(*keys).agg(*(of[rule](c).alias(c) for c, rule in rules.items()))


def merge(target: DataFrame, batch: DataFrame, keys: Sequence[str], rules: Mapping[str, str], order: str | None = None) -> DataFrame:
    """target after the batch: an equi-join on the keys; both sides shuffle once (or not, if bucketed by the keys)."""
    new = fold(batch, keys, rules, order).withColumn("__new", F.lit(True))
    old = target.withColumn("__old", F.lit(True))
    both = old.alias("o").join(new.alias("n"), list(keys), "full_outer")
    columns = [F.col(k) for k in keys]
    for c in target.columns:
        if c in keys:
            continue
        a, rule = F.col(f"o.{c}"), rules.get(c)
        b = F.col(f"n.{c}") if rule else None
        if rule is None:
            columns.append(a)
        elif rule == "replace":
            columns.append(F.when(F.col("__new"), b).otherwise(a).alias(c))
        else:
            columns.append(F.when(F.col("__new").isNull(), a).otherwise(RULES[rule](a, b)).alias(c))
    return both.select(*columns)


#: Rules of the engine's tables.
PATCH = {"name": "overwrite", "filenum": "overwrite", "filesize": "overwrite", "downnum": "add", "createtime": "insert_only", "updatetime": "overwrite", "hasfile": "sticky", "isdanger": "sticky"}
INGEST = {"name": "replace", "filenum": "replace", "filesize": "replace", "createtime": "replace", "updatetime": "replace", "hasfile": "replace", "downnum": "insert_only"}
KEYWORD = {"num": "add", "isdanger": "replace"}
SEARCH = {"num": "add", "last_search_time": "latest"}
VISIT = {"visit_time": "latest"}
FILES = {"files": "replace"}
STATISTICS = {"num": "replace", "updatetime": "replace"}


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(batch.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def add_and_mark(target: DataFrame, counts: DataFrame, key: str, column: str, n: str) -> tuple[DataFrame, DataFrame]:
    """target with the counts of known keys added, and the keys that changed."""
    known = counts.groupBy(key).agg(F.sum(n).alias("__n"))
    joined = target.join(known, key, "left")
    changed = joined.filter("__n IS NOT NULL").select(key)
    return joined.withColumn(column, F.col(column) + F.coalesce("__n", F.lit(0))).drop("__n").select(*target.columns), changed


def delete_keys(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*on), list(on), "left_anti")


def insert_returning(target: DataFrame, batch: DataFrame, keys: Sequence[str], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows of batch that weren't in target, one a key, with new ids; every key of batch with its id, new or known).

    New ids go on from the greatest one without gaps, in order of the keys. They are ranks in a range-sorted table: each
    partition numbers its own rows, after the counts of those before it, so no task sees all rows, and as they hang on the
    keys alone, a run that is tried again gives the same ids. Rows with a null key are left out; of rows with one key the
    least one counts."""
    spark = target.sparkSession
    known = target.select(*keys, id)
    others = [c for c in batch.columns if c not in keys and c != id]
    rows = batch.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(F.struct(*others) if others else F.lit(0)).alias("__row"))
    new = rows.join(known, list(keys), "left_anti")
    path = scratch(spark, "new-keys")
    new.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()).write.parquet(path)  # the partitions are fixed from here on
    placed = spark.read.parquet(path)
    first = target.agg(F.coalesce(F.max(id), F.lit(0)).cast("bigint").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # a row a partition
    start = first.join(counts)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    numbered = placed.withColumn("__k", inside).join(F.broadcast(start), "__part")
    added = numbered.select(*keys, *(F.col("__row")[c].alias(c) for c in others), (F.col("__first") + F.col("__before") + F.col("__k")).alias(id))
    return added, rows.select(*keys).join(known.unionByName(added.select(*keys, id)), list(keys))


class VersionedTable:
    """A table that changes as a whole: each commit writes a new folder, then moves a pointer file; readers see the old
    version until then, and a failed write leaves it in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, name: str = "_current"):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> str | None:
        if not self._fs.exists(self._pointer()):
            return None
        stream = self._fs.open(self._pointer())
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version()}")

    def commit(self, df: DataFrame) -> str:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{version}")
        draft = self._pointer(f"_draft-{version}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, self._pointer(), options)
        return version
