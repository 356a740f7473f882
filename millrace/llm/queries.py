"""One query for each operator of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe_automaton, chat_format, decontaminate, lexical_tree, mixing, mixing_sql, passage_dedup, quality, simhash, suffix_dedup, token_counts, token_files, topk, vector_codes
from millrace.llm.common import documents, scratch


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.rated(documents(spark, sf_dir).select("doc_id", "text"), labels).filter("keep").drop("text", "keep")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.near_duplicate_passages(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.cached_token_counts(spark, documents(spark, sf_dir), scratch(spark, "op6-cache"), model)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "op7-files")
    token_files.write_token_files(spark, documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_file_digests(spark, out)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op11_lexical_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_tree.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.op12_rows(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.op13_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.n, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.n <> x.n AND len(q.v) = len(x.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op8_mixing": mixing_sql.OP8_SQL, "op9_chat_format": chat_format.OP9_SQL, "op11_lexical_tree": lexical_tree.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
