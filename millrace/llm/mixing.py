"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id and text. A source's share is filled by whole passes over
it and one partial pass: the documents below a hash threshold. The threshold is found without sorting
documents: sum sizes by (source, top 12 bits of the hash), find the bucket in which the budget falls,
and refine that bucket alone by the next 16 bits, down to one hash value. Of the documents of that value
(one, unless rows repeat) as many are taken as bring the source nearest to its target.

DataFrame functions only. Documents are never shuffled by source: they are summed by (source, bucket)
before anything moves, and meet the plan (a row a source) by broadcast up to BROADCAST sources, and beyond
that by (source, SALTS parts of the hash). What meets in one task is at most one row a source.

Defined results: null text has size 0; sources rank by code point, null last; a source without words
gets target 0; if no source has words all targets are 0; of rows alike in id and text any may be taken,
but as many as said; extra columns of the input pass through mix() untouched, but for columns named like its
results (size, source_size, target, copies), which are replaced; mixed_rows() passes on every column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, discard, text_or_empty, written

HASH_BITS, LEVELS = 60, (12, 16, 16, 16)
BROADCAST, SALTS = 100_000, 256


def _source_key():
    """Of every source, null's last in order, and unlike all others."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def _doc_hash():
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty()))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sums: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """skey, source_size, target of each source of sums (skey, size): share x all sizes, dealt by the
    repeating weights; no target above most x its source's size, the excess dealt again by weight.

    In ascending order of cap / weight the capped sources come first: source i is capped if dealing what
    the ones before it leave, by the weights of those from it on, gives it more than its cap."""
    ranked = Window.orderBy("skey")
    n = len(weights)
    sources = (
        sums.groupBy("skey").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % n + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    every, by_ratio = Window.partitionBy(), Window.orderBy("ratio", "skey")
    upto, onward = by_ratio.rowsBetween(Window.unboundedPreceding, 0), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = sources.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share))).withColumn(
        "level", (F.col("budget") - (F.sum("cap").over(upto) - F.col("cap"))) / F.sum("weight").over(onward)
    )
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(every)["level"]
    return left.withColumn("water", water).select(
        "skey", "source_size",
        F.when(F.col("water").isNull() | (F.col("water") > F.col("ratio")), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"),
    )


def _bounds(sums: DataFrame) -> DataFrame:
    """Of sums (skey, budget, before, bucket, size, n) the bucket of each source in which its budget ends, as `at`, with the
    sizes before it: the last bucket that begins within the budget."""
    upto = Window.partitionBy("skey").orderBy("bucket")
    start = F.col("before") + F.sum("size").over(upto) - F.col("size")
    return (
        sums.withColumn("start", start).filter(F.col("start") <= F.col("budget"))
        .groupBy("skey", "budget").agg(F.max(F.struct("bucket", "start", "size", "n")).alias("b"))
        .select("skey", "budget", F.col("b.bucket").alias("at"), F.col("b.start").alias("before"), F.col("b.size").alias("size"), F.col("b.n").alias("n"))
    )


def _meet(rows: DataFrame, plan: DataFrame, sources: int, key: str, hash_: str) -> DataFrame:
    """rows joined to the plan's row of their source."""
    if sources <= BROADCAST:
        return rows.join(F.broadcast(plan), key)
    salt = plan.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("__mix_salt", F.pmod(F.xxhash64(hash_), F.lit(SALTS).cast("bigint"))).join(salt, [key, "__mix_salt"]).drop("__mix_salt")


def hash_thresholds(items: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """skey, source_size, target, passes, at, tied, more of each source of items (skey, size, hash): its documents are taken
    `passes` times, those with hash < at once more, and also `more` of the `tied` ones with hash = at (null: none)."""
    shift = HASH_BITS - LEVELS[0]
    bucket = F.shiftright("hash", shift).alias("bucket")
    sums = written(items.groupBy("skey", bucket).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-sums")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = source_targets(sums, weights, share, most).withColumn("passes", passes.cast("bigint"))
    plan = written(plan.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")
    zero = F.lit(0).cast("bigint").alias("before")
    bounds = written(_bounds(sums.join(plan.filter("budget > 0").select("skey", "budget", zero), "skey")), "mix-bounds")
    # only the boundary buckets' items go on: about one in 4096
    rows = written(_meet(items.select("skey", "size", "hash"), bounds.drop("size", "n"), plan.count(), "skey", "hash").filter(bucket == F.col("at")), "mix-boundary")
    for bits in LEVELS[1:]:
        shift -= bits
        finer = rows.groupBy("skey", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        inside = finer.join(bounds.select("skey", "budget", "before", "at"), "skey").filter(F.shiftright("bucket", bits) == F.col("at"))
        bounds = _bounds(inside)
    rest = F.col("budget") - F.col("before")
    more = F.when(F.col("size") > 0, F.least("n", F.ceil(rest * F.col("n") / F.col("size") - 0.5))).otherwise(F.when(rest > 0, F.col("n")).otherwise(0))
    found = plan.join(bounds.select("skey", "at", F.col("n").alias("tied"), more.cast("bigint").alias("more")), "skey", "left")
    found = written(found.select("skey", "source_size", "target", "passes", "at", "tied", "more").coalesce(1), "mix-plan")
    for table in (sums, rows):
        discard(table)
    return found


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with __mix_turn, from 1 within each __mix_source, without a task that sees all rows of one."""
    rows = written(rows.withColumn("__mix_row", F.monotonically_increasing_id()), "mix-tied")
    part = F.pmod(F.xxhash64("__mix_row"), F.lit(SALTS).cast("bigint"))
    counts = rows.groupBy("__mix_source", part.alias("__mix_part")).agg(F.count("*").alias("__mix_n"))
    before = Window.partitionBy("__mix_source").orderBy("__mix_part")
    counts = counts.withColumn("__mix_before", F.sum("__mix_n").over(before) - F.col("__mix_n")).drop("__mix_n")
    turn = F.row_number().over(Window.partitionBy("__mix_source", "__mix_part").orderBy("__mix_row"))
    numbered = rows.withColumn("__mix_part", part).withColumn("__mix_turn", turn)
    return numbered.join(counts, ["__mix_source", "__mix_part"]).withColumn("__mix_turn", F.col("__mix_turn") + F.col("__mix_before")).drop("__mix_row", "__mix_part", "__mix_before")


def mix(
    docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """docs with size, source_size, target and copies (times that the mix takes the row)."""
    if any(w <= 0 for w in weights) or not 0 <= share <= most:
        raise ValueError("weights must be positive, and 0 <= share <= most")
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")
    items = written(docs.select(_source_key().alias("skey"), size.alias("size"), _doc_hash().alias("hash")), "mix-items")
    plan = hash_thresholds(items, weights, share, most)
    discard(items)
    plan = plan.select(F.col("skey").alias("__mix_source"), *(F.col(x).alias(f"__mix_{x}") for x in plan.columns[1:]))
    results = ["size", "source_size", "target", "copies"]
    whole = docs.withColumns({"__mix_source": _source_key(), "__mix_hash": _doc_hash(), "__mix_size": size}).drop(*results)
    whole = _meet(whole, plan, plan.count(), "__mix_source", "__mix_hash").withColumn("__mix_turn", F.lit(1).cast("bigint"))
    if not plan.filter("__mix_tied > 1").isEmpty():
        tied = (F.col("__mix_hash") == F.col("__mix_at")) & (F.col("__mix_tied") > 1)
        whole = whole.filter(~F.coalesce(tied, F.lit(False))).unionByName(_numbered(whole.filter(tied).drop("__mix_turn")))
    more = (F.col("__mix_hash") < F.col("__mix_at")) | (F.col("__mix_hash") == F.col("__mix_at")) & (F.col("__mix_turn") <= F.col("__mix_more"))
    own = [x for x in docs.columns if x not in results]
    copies = F.col("__mix_passes") + F.when(more, 1).otherwise(0)
    return whole.select(*(F.col(f"`{x}`") for x in own), *(F.col(f"__mix_{x}").alias(x) for x in results[:3]), copies.alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    whole = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("__mix_whole"))
    taken = mix(whole, **options).filter("copies > 0")
    return taken.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("__mix_whole.*")
