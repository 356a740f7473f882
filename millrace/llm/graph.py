"""Connected components of a graph that is a table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in edges (a, b), but for the roots.

    Alternates large-star and small-star: hang every larger neighbour on the smallest neighbour, then every
    smaller-or-equal one. The table of links never grows, and after O(log^2 n) rounds is a star a component.
    Each round is written to the shared folder."""
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = written(edges.filter("a <> b").select(larger, smaller).distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    was = state(links)
    while was[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(links)
        links, before, was = now, was, state(now)
        if was == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
