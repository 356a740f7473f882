"""Token counts through a digest cache.

A text's count is stored under (digest of the content, digest of the tokenizer version). A run joins
the digests of its documents to the stored counts, encodes only the distinct texts that are missing,
and appends their counts to the cache. The content is normalised only in so far as counts can't
change: null counts as the empty text. Any stronger folding would count another text.

Defined results: null and empty texts count 0 tokens and 0 bytes; repeated rows each get a row; a null
id is kept; other columns of the input are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import exists, small_batches, text_or_empty

_LOADED: dict[str, object] = {}


def version_digest(model_path: str) -> str:
    """Of the vocabulary file and the library that reads it."""
    kind = "tokenizers" if model_path.endswith(".json") else "sentencepiece"
    library = __import__(kind)
    with open(model_path, "rb") as file:
        return hashlib.sha256(file.read() + f"\0{kind} {library.__version__}".encode()).hexdigest()


def _load(model_path: str):
    """A function from texts to their token counts, kept for the worker's life."""
    if model_path not in _LOADED:
        if model_path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(model_path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[model_path] = lambda texts: [
                len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
            _LOADED[model_path] = lambda texts: [
                len(x) for x in pieces.encode(texts, num_threads=1, add_bos=False, add_eos=False)
            ]
    return _LOADED[model_path]


def _encode(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _load(model_path)
        for batch in batches:
            texts, counts, some, size = batch.column("text").to_pylist(), [], [], 0
            for text in texts:  # a few MB of tokens at a time
                some.append(text)
                size += len(text)
                if size > 1_000_000:
                    counts += count(some)
                    some, size = [], 0
            counts += count(some) if some else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return run


def cached_token_counts(
    spark: SparkSession, docs: DataFrame, cache_dir: str, model_path: str, *, limit: int = 4096
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs (doc_id, text).

    cache_dir is a Parquet table (digest, n_tokens) partitioned by tokenizer version; it is made if
    missing, and grows by the distinct texts that it lacked. The rows of one very frequent text are
    combined before the shuffle, so only one copy a task travels to its encoder.
    """
    small_batches(spark)
    version = version_digest(model_path)
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.col("text"), 256))
    )
    home = f"{cache_dir.rstrip('/')}/version={version}"
    missing = keyed.select("digest", "text")
    if exists(spark, home):
        missing = missing.join(spark.read.parquet(home).select("digest"), "digest", "left_anti")
    (
        missing.dropDuplicates(["digest"])
        .mapInArrow(_encode(model_path), "digest binary, n_tokens bigint")
        .write.mode("append")
        .parquet(home)
    )
    # a run that was cut off and retried may have stored a text twice
    stored = spark.read.schema("digest binary, n_tokens bigint").parquet(home).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return (
        keyed.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
        .join(stored, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
