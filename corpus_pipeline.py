"""A corpus pipeline in stages, each written as Parquet and read again as the next one's documents.

Defined results: a null text counts as the empty one, which the classifier rates as any other; a null doc_id is the last of its
near-duplicate group and comes first in the token files; repeated rows are copies, of which one stays; columns of any name
pass through all stages but the last as they are; a table without documents gives no rows, and without labels, benchmark items
or near duplicates each stage keeps what its operator keeps then."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, quality, simhash, token_files
from millrace.llm.common import scratch, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    aside = {c: f"column {k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # so that no verdict can have a name of theirs
    scored = quality.rated(docs.withColumnsRenamed(aside), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("keep").select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without benchmark passages."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token id files; doc_id, start, n_tokens, ids_crc32 of what they hold."""
    out = scratch(spark, "pipeline-files")
    token_files.write_token_files(spark, docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_file_digests(spark, out)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("token ids", write_ids),
]

#: SQL can't express the classifier, SimHash groups, retrieval or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
