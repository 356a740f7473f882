"""Exact top-k inner-product search by pivot-table elimination.

For integer vectors q and x, q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, and for every pivot p
|q - x| >= | |q - p| - |x - p| |. The table holds the distances of every vector to many pivots, so the largest of
these lower bounds gives an upper bound of the score. Candidates lie in cells (by nearest pivot); a cell's bound
comes from its least and greatest distance to each pivot. A query takes cells, and candidates in them, in order
of bounds, evaluates exact scores, and stops when no bound left reaches its k-th best score (a bound equal to it
is still evaluated, for the tie may have the smaller id).

Work is dealt as (chunk of queries) x (block of candidates): both are rows of packed vectors, joined on the pair's
number, and each pair is one task's work with its own top k; a query's lists are merged at the end. Pivots come
from a bounded sample (sample_size vectors with the smallest hashes): they decide what is skipped, never the result.

Defined results: vectors null or with null or non-finite components take no part; only vectors of one length are
compared; rows alike in id and vector are one packed row with a count, and each still counts as a row (a query
skips its own row only); a null id is a candidate, after all others in ties, and never a query; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, written

NO_ID = np.iinfo(np.int64).max
#: Room for rounding: distances are computed in floating point from exact squares.
SLACK = 1e-6
#: Vectors in a cell.
CELL = 512


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (floor(scale * component)) and n (rows alike)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", v.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("n"))


def choose_pivots(items: DataFrame, n_pivots: int, sample_size: int) -> dict[int, np.ndarray]:
    """Pivots by vector length: each is the sampled vector farthest from those before it."""
    sample = [r.v for r in items.select("v").orderBy(F.xxhash64("vec_id", "v"), "v").limit(sample_size).collect()]
    found = {}
    for size in {len(x) for x in sample}:
        alike = [y for y in sample if len(y) == size]
        x = np.unique(np.array(alike, np.float64).reshape(len(alike), size), axis=0) if size else np.zeros((1, 0))
        at, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(at) < min(n_pivots, len(x)) and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
        found[size] = x[at]
    return found


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T)) if len(pivots) else np.zeros((len(x), 0))


def _packer(pivots: dict[int, np.ndarray]):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        size = key[1].as_py()
        ids = np.array([NO_ID if x is None else x for x in table.column("vec_id").to_pylist()], np.int64)
        n = table.column("n").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), size)
        d = _distances(x.astype(np.float64), pivots.get(size, np.zeros((0, size))))
        order = np.lexsort((ids, d.argmin(1) if d.shape[1] else np.zeros(len(ids), int)))
        x = x[order]
        x = x.astype(np.int32) if len(x) and np.abs(x).max(initial=0) < 2**31 else x
        null = np.array(table.column("vec_id").is_null())[order]
        body = pickle.dumps((ids[order], null, n[order], x, d[order]), protocol=5)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([size], pa.int32()), "body": pa.array([body], pa.binary())})

    return pack


def _packed(items: DataFrame, rows_each: int, pivots: dict[int, np.ndarray]) -> tuple[DataFrame, int]:
    """Rows (part, size, body) of about rows_each vectors of one length; the number of parts."""
    parts = max(1, -(-items.count() // rows_each))
    keyed = items.withColumn("size", F.size("v")).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)))
    return written(keyed.groupBy("part", "size").applyInArrow(_packer(pivots), "part bigint, size int, body binary"), "topk-parts"), parts


def search_block(q: np.ndarray, qid: int, own: bool, qd: np.ndarray, ids, n, x, d, k: int, cell: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a block for one query; own: leave out one row with id qid and vector q."""
    norms, peak, low, high, cell_norm, real = _search_norms(x)
    qf = q.astype(np.float64)
    q2 = float(qf @ qf)
    exact = float(np.abs(q).max(initial=0)) * peak * max(1, len(q)) < 2**52
    starts = np.arange(0, len(x), cell)
    gap = np.maximum(0, np.maximum(low - qd, qd - high)).max(1, initial=0) if d.shape[1] else np.zeros(len(starts))
    bound = np.minimum((q2 + cell_norm - gap * gap) / 2, np.sqrt(q2) * np.sqrt(cell_norm)) * (1 + SLACK) + SLACK + SLACK * (q2 + cell_norm)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for c in np.argsort(-bound, kind="stable"):
        least = best[k - 1] if len(best) >= k else None
        if least is not None and bound[c] < least:
            break
        first, last = int(starts[c]), min(int(starts[c]) + cell, len(x))
        at = None  # None: all of the cell
        if least is not None and d.shape[1]:
            lower = np.abs(d[first:last] - qd).max(1)
            upper = (q2 + norms[first:last] - lower * lower) / 2
            able = upper * (1 + SLACK) + SLACK * (1 + q2 + norms[first:last]) >= least
            if not able.any():
                continue
            if able.mean() < 0.5:
                at = first + np.flatnonzero(able)
        if exact:
            scores = np.rint((real[first:last] if at is None else real[at]) @ qf).astype(np.int64)
        else:
            scores = (x[first:last] if at is None else x[at]).astype(np.int64) @ q.astype(np.int64)
        at = np.arange(first, last) if at is None else at
        if least is not None:
            good = scores >= least
            if not good.any():
                continue
            at, scores = at[good], scores[good]
        copies = np.minimum(n[at], k + 1)
        if own:
            copies = copies - ((ids[at] == qid) & (x[at] == q).all(1) & (n[at] <= k + 1))
        best_ids = np.concatenate([best_ids, np.repeat(ids[at], copies)])
        best = np.concatenate([best, np.repeat(scores, copies)])
        if len(best) > k:
            edge = np.partition(best, len(best) - k)[len(best) - k]
            near = best >= edge
            best_ids, best = best_ids[near], best[near]
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
    return best_ids, best


_NORMS: dict[int, tuple] = {}


def _search_norms(x: np.ndarray) -> tuple:
    return _NORMS[id(x)]


def _prepare(x: np.ndarray, d: np.ndarray, cell: int = CELL) -> None:
    """Squared norms, each cell's distance ranges and the real numbers of the block that is searched next."""
    _NORMS.clear()
    real = x.astype(np.float64)
    norms = (real**2).sum(1)
    cuts = np.arange(0, len(x), cell)
    low = np.minimum.reduceat(d, cuts, axis=0) if len(x) else d
    high = np.maximum.reduceat(d, cuts, axis=0) if len(x) else d
    _NORMS[id(x)] = (norms, float(np.abs(x).max(initial=0)), low, high, np.maximum.reduceat(norms, cuts) if len(x) else norms, real)


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "place", "copies", "query_id", "vec_id", "score"]
        for batch in batches:
            for row in range(len(batch)):
                chunk = batch.column("chunk")[row].as_py()
                qids, _, qn, q, qd = pickle.loads(batch.column("queries")[row].as_py())
                ids, null, n, x, d = pickle.loads(batch.column("body")[row].as_py())
                no_id = ids[null]
                _prepare(x, d)
                columns: list[list] = [[], [], [], [], [], []]
                for place in range(len(qids)):
                    found, scores = search_block(q[place], int(qids[place]), True, qd[place], ids, n, x, d, k)
                    for c, value in zip(columns, (chunk, place, int(qn[place]), int(qids[place])), strict=False):
                        c.extend([value] * len(found))
                    columns[4].extend(None if len(no_id) and y == NO_ID else int(y) for y in found)
                    columns[5].extend(map(int, scores))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 20, scale: int = 64, n_pivots: int = 32, sample_size: int = 2048, block_rows: int = 16384, chunk_rows: int = 512
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row of vectors (vec_id, embedding) that is_query."""
    spark = vectors.sparkSession
    items = written(quantised(vectors, scale), "topk-items")
    pivots = choose_pivots(items, n_pivots, sample_size)
    blocks, n_blocks = _packed(items, block_rows, pivots)
    chunks, n_chunks = _packed(items.filter(is_query), chunk_rows, pivots)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    # every chunk meets every block, by number: one row and one task's work a pair
    asked = chunks.select(F.col("part").alias("chunk"), "size", F.col("body").alias("queries"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("part"))
    offered = blocks.select("part", "size", "body", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_chunks - 1).cast("bigint"))).alias("chunk"))
    pairs = asked.join(offered.hint("merge"), ["chunk", "part", "size"])
    found = written(pairs.mapInArrow(_searcher(k), "chunk bigint, place bigint, copies bigint, query_id bigint, vec_id bigint, score bigint"), "topk-found")
    for x in (items, blocks, chunks):
        discard(x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    best = Window.partitionBy("chunk", "query_id", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
