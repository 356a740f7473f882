"""File trees as flat paths: a row a leaf, with its path as an array. Ancestors come from the path, without recursion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.storage import scratch

PADDING = "_____padding_file"


def not_padding(path: Column) -> Column:
    return ~F.element_at(path, -1).startswith(PADDING)


def from_paths(files: DataFrame, root: str, name: str, size: str) -> DataFrame:
    """root, path, size of a leaf for each name, split at slashes; of a name that a root holds twice the greatest size."""
    return files.groupBy(root, F.split(name, "/").alias("path")).agg(F.max(size).alias("size"))


def ancestors(path: Column) -> Column:
    """Every prefix of a path, the whole path last."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, 1, i))


def rollup(leaves: DataFrame, root: str, path: str, size: str) -> DataFrame:
    """root, node (path), depth, leaves, size of every node: leaves are counted and summed into all their ancestors."""
    return (
        leaves.select(root, F.explode(ancestors(F.col(path))).alias("node"), F.col(size).alias("__size"))
        .groupBy(root, "node").agg(F.count("*").alias("leaves"), F.sum("__size").alias("size"))
        .withColumn("depth", F.size("node"))
    )


def leaf_totals(leaves: DataFrame, root: str, size: str) -> DataFrame:
    """Leaf count and total size of each root."""
    return leaves.groupBy(root).agg(F.count("*").alias("leaves"), F.sum(size).alias("size"))


def shown_count(stored: Column, leaves: Column) -> Column:
    """A stored count above one, else the leaves, at least one."""
    return F.when(stored > 1, stored).otherwise(F.greatest(F.coalesce(leaves, F.lit(0)), F.lit(1)))


def leaf_names(leaves: DataFrame, root: str, path: str, order: Sequence[str]) -> DataFrame:
    """Distinct leaf names of each root in breadth-first order (depth, then `order`), joined by commas."""
    names = leaves.groupBy(root, F.element_at(path, -1).alias("name")).agg(F.min(F.struct(F.size(path).alias("d"), *order)).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    return names.groupBy(root).agg(F.array_join(listed, ",").alias("names"))


def listing(nodes: DataFrame, root: str) -> DataFrame:
    """Rows of rollup() in depth-first order, with an indent of 30 a level."""
    return nodes.withColumn("indent", (F.col("depth") - 1) * 30).orderBy(root, "node")


def flatten_json(df: DataFrame, root: str, files: str) -> DataFrame:
    """root, path, size of each leaf of a JSON column holding a list of nodes (Name, FileSize, Files), to any depth:
    a level of the tree is a pass, and only what has children goes on, as a written table, so no level is parsed twice. Paths
    carry names; order is by place."""
    spark = df.sparkSession
    level = df.select(root, F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"), F.col(files).alias("files"))
    out = None
    item = "array<struct<Name: string, FileSize: bigint, Files: string>>"
    while True:
        parsed = level.select(root, "path", "place", F.posexplode(F.from_json(F.col("files"), item)).alias("i", "n"))
        nodes = parsed.select(
            root, F.concat("path", F.array("n.Name")).alias("path"), F.concat("place", F.array("i")).alias("place"),
            F.coalesce("n.FileSize", F.lit(0)).alias("size"), F.col("n.Files").alias("files"),
        )
        has = F.col("files").isNotNull() & ~F.col("files").isin("[]", "null", "")
        leaf = nodes.filter(~has).drop("files")
        out = leaf if out is None else out.unionByName(leaf)
        path = scratch(spark, "tree-level")
        nodes.filter(has).drop("size").write.parquet(path)
        level = spark.read.schema(nodes.drop("size").schema).parquet(path)
        if level.isEmpty():
            return out
