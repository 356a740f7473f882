"""Product codes of vectors, assigned by Orchard's search.

Each component x becomes the integer floor(scale * x); a vector is cut into equal consecutive parts, and each part
position has a codebook of so many entries. A part's nearest entry is found by Orchard's search: every entry has a list
of all others in order of their distance from it. The search holds its best entry so far and walks that entry's list; an
entry that is nearer (or as near, with the smaller index) becomes the best one and the walk goes on in its own list;
entries met before are marked and not measured again; it ends at the first listed entry that is more than twice as far
from the best one as the part is, since none from there on can be as near. All distances are squared integers, so the
result is the exact nearest entry with ties to the smaller index. A task searches for all parts of an Arrow batch at once.

Training is a number of rounds of one job each: tasks assign their parts and add them up by entry, Spark adds the tasks'
sums, and the driver holds the codebooks alone: entries x length integers for each length, whatever the number of rows.

Defined results: vectors null or with null or non-finite components take no part; a null id comes after all others where
ids are ordered, and ids that tie are ordered by their vectors; repeated rows count as often as they occur; vectors of
each length have codebooks of their own, and a length that the parts don't divide is filled up with zeros (more than
max_lengths lengths, or components beyond 2^26 after scaling, are refused, for neither the driver's share nor a sum would
be bounded); with fewer vectors than entries the codebook has as many entries as vectors; entries that no part chose stay;
an empty table gives no codebooks and no rows; other columns are ignored but for those asked for in `keep`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

#: Codebooks by vector length: arrays (part, entry, place in the part) of integers.
Codebooks = dict[int, np.ndarray]

LARGEST = 1 << 26
#: Listed entries that are measured at once.
STEP = 16


def quantised(vectors: DataFrame, scale: int = 1024, *, id: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """The id as vec_id, the columns to keep, and v: floor(scale * component)."""
    at = F.col(vector)
    finite = F.forall(at, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(at, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return vectors.filter(at.isNotNull() & finite).select(F.col(id).alias("vec_id"), *(F.col(c) for c in keep), v.alias("v"))


class OrchardLists:
    """The entries of one codebook, and for each its others in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of x."""
        n = len(self.entries)
        # any start will do: the entry whose first component is nearest, found by bisection
        if x.shape[1]:
            by_first = np.argsort(self.entries[:, 0], kind="stable")
            best = by_first[np.minimum(np.searchsorted(self.entries[by_first, 0], x[:, 0]), n - 1)]
        else:
            best = np.zeros(len(x), np.int64)
        distance = ((x - self.entries[best]) ** 2).sum(1)
        met = np.zeros((len(x), n), bool)
        met[np.arange(len(x)), best] = True
        at = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            place = at[open_]
            on = place < n
            open_, place = open_[on], place[on]
            on = self.far[best[open_], place] <= 4 * distance[open_]
            open_, place = open_[on], place[on]
            # a few listed entries at a time, of which those met before are left out
            some = self.order[best[open_][:, None], np.minimum(place[:, None] + np.arange(STEP), n - 1)]
            row, column = np.nonzero(~met[open_[:, None], some])
            entry = some[row, column]
            met[open_[row], entry] = True
            apart = x[open_[row]] - self.entries[entry]
            measured = np.full(some.shape, np.iinfo(np.int64).max)
            measured[row, column] = np.einsum("ij,ij->i", apart, apart)
            least = measured.min(1)
            which = np.where(measured == least[:, None], some, n).min(1)
            nearer = (least < distance[open_]) | ((least == distance[open_]) & (which < best[open_]))
            at[open_] = place + STEP
            rows = open_[nearer]
            best[rows], distance[rows], at[rows] = which[nearer], least[nearer], 0
        return best, distance


def _by_length(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their parts as (row, part, place)) of a batch, some thousand rows at a time."""
    column = batch.column("v")
    sizes = column.value_lengths().to_numpy()
    starts = np.cumsum(sizes) - sizes
    flat = column.flatten().to_numpy()
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        for k in range(0, len(every), 2048):
            rows = every[k : k + 2048]
            x = flat[starts[rows][:, None] + np.arange(size)]
            x = np.pad(x, ((0, 0), (0, -size % parts)))
            yield int(size), rows, x.reshape(len(rows), parts, x.shape[1] // parts)


def _tally(codebooks: Codebooks, parts: int):
    """Batches of parts to the number and sum of those that chose each entry, one row an entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {size: [OrchardLists(x) for x in book] for size, book in codebooks.items()}
        n = {size: np.zeros(book.shape[:2], np.int64) for size, book in codebooks.items()}
        sums = {size: np.zeros(book.shape, np.int64) for size, book in codebooks.items()}
        for batch in batches:
            for size, _, x in _by_length(batch, parts):
                for p in range(parts):
                    code, _ = lists[size][p].nearest(x[:, p])
                    n[size][p] += np.bincount(code, minlength=n[size].shape[1])
                    np.add.at(sums[size][p], code, x[:, p])
        for size in codebooks:
            p, entry = np.nonzero(n[size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), size), pa.int32()), pa.array(p, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[size][p, entry]), pa.array(list(sums[size][p, entry]), pa.list_(pa.int64()))],
                ["size", "part", "entry", "n", "sums"],
            )

    return run


def train(items: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, max_lengths: int = 16) -> Codebooks:
    """Codebooks of the quantised rows: they start as the parts of the `entries` smallest ids, and each round replaces an
    entry by the floor of the mean of the parts that are nearest to it."""
    sizes = sorted(r[0] for r in items.select(F.size("v")).distinct().limit(max_lengths + 1).collect())
    if len(sizes) > max_lengths:
        raise ValueError(f"vectors of more than {max_lengths} lengths")
    most = items.agg(F.max(F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0)))))).first()[0]
    if most is not None and most > LARGEST:
        raise ValueError(f"components of more than {LARGEST} after scaling")
    codebooks = {}
    for size in sizes:
        first = items.filter(F.size("v") == size).select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
        x = np.array([r.v for r in first], np.int64).reshape(len(first), size)
        x = np.pad(x, ((0, 0), (0, -size % parts)))
        codebooks[size] = np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))
    schema = "size int, part int, entry int, n bigint, sums array<bigint>"
    for _ in range(rounds if sizes else 0):
        told = items.select("v").mapInArrow(_tally(codebooks, parts), schema)
        width = max(book.shape[2] for book in codebooks.values())
        total = told.groupBy("size", "part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(width))).alias("sums"))
        for r in total.collect():
            book = codebooks[r.size]
            book[r.part, r.entry] = np.array(r.sums[: book.shape[2]], np.int64) // r.n
    return codebooks


def encode(items: DataFrame, codebooks: Codebooks, *, parts: int = 4) -> DataFrame:
    """The quantised rows (all columns but v) with code, the index of each part's nearest entry, and error, the squared
    distances added up."""
    kept = [c for c in items.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {size: [OrchardLists(x) for x in book] for size, book in codebooks.items()}
        for batch in batches:
            code, error = np.zeros((len(batch), parts), np.int64), np.zeros(len(batch), np.int64)
            for size, rows, x in _by_length(batch, parts):
                for p in range(parts):
                    code[rows, p], d = lists[size][p].nearest(x[:, p])
                    error[rows] += d
            codes = pa.array(list(code), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), codes, pa.array(error)], [*kept, "code", "error"])

    schema = items.select(*kept, F.lit(None).cast("array<bigint>").alias("code"), F.lit(None).cast("bigint").alias("error")).schema
    return items.mapInArrow(run, schema)


def decode(code: Sequence[int], book: np.ndarray, size: int, scale: int = 1024) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[p, k] for p, k in enumerate(code)])[:size] / scale


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all entries' components in decimal, by length, part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for size in sorted(codebooks) for x in codebooks[size].ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, keep: Sequence[str] = ()) -> tuple[DataFrame, Codebooks]:
    """(vec_id, the columns to keep, code and error of every vector, the codebooks)."""
    items = written(quantised(vectors, scale, keep=keep), "vector-items")
    codebooks = train(items, parts=parts, entries=entries, rounds=rounds)
    return encode(items, codebooks, parts=parts), codebooks


def op13_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hex, error, label_error and codebooks_sha256 of embeddings (vec_id, embedding, label)."""
    coded, codebooks = compressed(vectors, keep=["label"])
    coded = written(coded, "vector-codes")  # read twice: rows, and sums by label
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    text = F.array_join(F.transform("code", lambda k: F.lpad(F.lower(F.hex(k)), 2, "0")), "")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by comparing each part with every entry."""
    nearest = "(SELECT x.id, x.p, arg_min(b.e, (list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) AS e, min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM x JOIN {0} b USING (p) GROUP BY x.id, x.p)"
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"x AS MATERIALIZED (SELECT id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM x WHERE id <= {entries})",
    ]
    for r in range(rounds):
        steps.append(
            f"m{r} AS (SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM x JOIN {nearest.format(f'b{r}')} a USING (id, p), range(1, (SELECT max(len(v)) + 1 FROM x)) t(i) GROUP BY ALL), "
            f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{r} GROUP BY p, e) u USING (p, e))"
        )
    steps.append(f"a AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {nearest.format(f'b{rounds}')} GROUP BY id)")
    sha = f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {sha} AS codebooks_sha256 FROM a JOIN k USING (id)"


OP13_SQL = _op13_sql()
