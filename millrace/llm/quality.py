"""Quality classifier: ordinal cumulative-link regression on graded ratings.

    P(grade > k | text) = sigmoid(w . x(text) - t_k),   t_0 < t_1 < ...

One weight vector over hashed text features is shared by all thresholds, so a text has one score; the
thresholds turn it into tail probabilities, and these into the expected grade. Texts are kept by the
probability that their grade is above `above`.

Features of a whole text, hashed into 2^bits slots: which words it has, which word stems of four and five
letters, and how its bytes and repeated words are spread (shares of the text, in steps of 1/64 up to powers
of two, so that a rule such as "more than 2 % of '$'" is one weight).

The model is fitted on the driver from at most max_labelled labelled rows, the ones with the smallest hash
of (doc_id, grade): a documented bound, and a sample that doesn't depend on the order of rows. Every
document is scored.

Defined results: null and empty texts are scored by their (empty) features; labels with null grades, or
for unknown documents, are not used; a document that is labelled twice is used twice; with no usable labels
every document gets the flat prior; other columns pass through (columns named like the results are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm.common import batch_rows
from millrace.llm.words import word_hashes

_SHARES = np.array([2.0**-k for k in range(1, 11)])
_MARKS = {"word": np.uint64(0x9E3779B97F4A7C15), "stem": np.uint64(0xD6E8FEB86659FD93)}


class Features:
    """Texts to arrays of slots (each once)."""

    def __init__(self, bits: int):
        self.bits = bits
        # a slot for each byte value (and byte 256 for repeated words) and share
        self.shares = np.array([[xxhash.xxh64_intdigest(f"share {b} {k}".encode()) >> (64 - bits) for k in range(len(_SHARES))] for b in range(257)], np.int64)

    def _slots(self, mark: str, found: list[list[str]]) -> list[np.ndarray]:
        h, sizes = word_hashes(found)
        return np.split(((h * _MARKS[mark]) >> np.uint64(64 - self.bits)).astype(np.int64), np.cumsum(sizes)[:-1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words = [x.lower().split() for x in texts]
        distinct = [list(set(x)) for x in words]
        stems = [list({w[:n] for w in x for n in (4, 5) if len(w) > n}) for x in distinct]
        out = []
        for text, own, slots, stem_slots in zip(texts, words, self._slots("word", distinct), self._slots("stem", stems), strict=True):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            share = np.zeros(257)
            share[:256] = np.bincount(raw, minlength=256) / max(1, len(raw))
            share[256] = sum(map(str.__eq__, own, own[1:])) / max(1, len(own))
            out.append(np.unique(np.concatenate([slots, stem_slots, self.shares[share[:, None] >= _SHARES]])).astype(np.int32))
        return out


@dataclass
class OrdinalModel:
    bits: int
    weights: np.ndarray  # one a slot
    thresholds: np.ndarray  # ascending, one less than grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, *, rounds: int = 200, rate: float = 0.2, ridge: float = 0.5, least_docs: int = 5) -> OrdinalModel:
    """Maximum posterior (ridge: the precision of the weights), by Adam over all rows. Slots in fewer than least_docs rows
    get weight 0, however many rows there are; rare ones are left to the ridge."""
    cuts = np.linspace(-1, 1, n_grades - 1)
    weights = np.zeros(1 << bits, np.float32)
    if not rows:
        return OrdinalModel(bits, weights, cuts)
    seen = np.zeros(1 << bits, np.int64)
    for x in rows:
        seen[x] += 1
    kept = np.flatnonzero(seen >= least_docs)
    k = len(kept)
    place = np.full(1 << bits, -1, np.int32)
    place[kept] = np.arange(k)
    columns = [place[x] for x in rows]
    columns = [x[x >= 0] for x in columns]
    sizes = np.array([len(x) for x in columns])
    column = np.concatenate(columns)
    del columns
    row_of = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    # sums over rows go by blocks of rows, which bounds what they hold at once
    ends = np.concatenate([[0], np.cumsum(sizes)])
    blocks = [(a, min(a + 1000, len(rows)), slice(int(ends[a]), int(ends[min(a + 1000, len(rows))]))) for a in range(0, len(rows), 1000)]
    # common slots carry less: a slot's step is scaled by its rarity
    scale = np.log1p(len(rows) / np.maximum(1, seen[kept])) / np.sqrt(max(1.0, sizes.mean()))
    value = scale.astype(np.float32)[column]
    p = np.zeros(k + n_grades - 1)
    p[k] = cuts[0]
    p[k + 1 :] = np.log(np.diff(cuts))  # thresholds are the first and the logarithms of the gaps: their order holds
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        score = np.zeros(len(rows))
        for a, b, part in blocks:
            score[a:b] = np.bincount(row_of[part] - a, weights=p[column[part]] * value[part], minlength=b - a)
        gaps = np.exp(p[k + 1 :])
        cuts = p[k] + np.concatenate([[0], np.cumsum(gaps)])
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -60, 60)))
        tail = np.clip(tail, 1e-9, 1 - 1e-9)
        # cell probability of each row's grade, and its slope in each threshold's logit
        upper = np.concatenate([np.ones((len(rows), 1)), tail], 1)[np.arange(len(rows)), grades]
        lower = np.concatenate([tail, np.zeros((len(rows), 1))], 1)[np.arange(len(rows)), grades]
        cell = np.maximum(upper - lower, 1e-9)
        slope = tail * (1 - tail) / cell[:, None]
        sign = np.zeros_like(tail)
        at = np.arange(len(rows))
        sign[at[grades > 0], grades[grades > 0] - 1] = 1
        sign[at[grades < n_grades - 1], grades[grades < n_grades - 1]] -= 1
        pull = sign * slope  # d log likelihood / d (score - threshold)
        by_row = pull.sum(1)
        g = np.empty_like(p)
        g[:k] = ridge / len(rows) * p[:k]
        for _, _, part in blocks if k else ():
            g[:k] -= np.bincount(column[part], weights=by_row[row_of[part]] * value[part], minlength=k) / len(rows)
        moved = np.cumsum((pull.sum(0) / len(rows))[::-1])[::-1]  # by a threshold and all above it
        g[k] = moved[0] + 1e-4 * p[k]
        g[k + 1 :] = moved[1:] * gaps + 1e-4 * p[k + 1 :]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p[k + 1 :] = np.clip(p[k + 1 :], -7, 7)
    weights[kept] = (p[:k] * scale).astype(np.float32)
    return OrdinalModel(bits, weights, p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))]))


def _features_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            for k in range(0, len(batch), 100):
                some = batch.slice(k, 100)
                got = features([x or "" for x in some.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column("grade"), pa.array(got, pa.list_(pa.int32()))], ["grade", "slots"])

    return run


def fit_on(docs: DataFrame, graded: DataFrame, *, n_grades: int, bits: int = 18, max_labelled: int = 12_000) -> OrdinalModel:
    """graded: doc_id, grade (0 .. n_grades - 1). At most max_labelled rows reach the driver."""
    chosen = (
        graded.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
        .select("doc_id", F.col("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id", "grade"), "doc_id", "grade").limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("grade", "text").mapInArrow(_features_of(bits), "grade int, slots array<int>")
    with batch_rows(docs.sparkSession, 500):
        table = rows.toArrow()
    flat = [x.to_numpy(zero_copy_only=False) for chunk in table.column("slots").chunks for x in (chunk.slice(i, 1).flatten() for i in range(len(chunk)))]
    grades = table.column("grade").to_numpy() if table.num_rows else np.zeros(0, int)
    order = sorted(range(len(flat)), key=lambda i: (int(grades[i]), len(flat[i]), xxhash.xxh64_intdigest(flat[i].tobytes())))  # results don't depend on the order in which rows come
    return fit([flat[i] for i in order], np.array([int(grades[i]) for i in order], int), n_grades, bits)


def score(docs: DataFrame, model: OrdinalModel, *, above: int) -> DataFrame:
    """docs with expected_grade and p_above: P(grade > above)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bits, model.weights, model.thresholds))
    docs = docs.drop("expected_grade", "p_above")
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()), StructField("p_above", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        features = Features(own.bits)
        for batch in batches:
            for k in range(0, len(batch), 100):
                some = batch.slice(k, 100)
                slots = features([x or "" for x in some.column("text").to_pylist()])
                tails = own.tails(np.array([own.weights[x].sum(dtype=np.float64) for x in slots]))
                columns = [*(some.column(n) for n in names), pa.array(tails.sum(1), pa.float64()), pa.array(tails[:, above], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "expected_grade", "p_above"])

    return docs.mapInArrow(run, schema)


#: Grades of the labels table: toxic, poor, good.
N_GRADES = 3


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 neither toxic nor good, 2 good and not toxic; null if a rating is null."""
    return labels.select("doc_id", F.when(F.col("toxic") >= 1, 0).when(F.col("quality") >= 1, F.when(F.col("toxic") < 1, 2)).otherwise(F.when((F.col("quality") < 1) & (F.col("toxic") < 1), 1)).alias("grade"))


def rated(docs: DataFrame, labels: DataFrame, *, keep_at: float = 0.55) -> DataFrame:
    """docs with expected_grade, p_above (the probability of a good grade) and keep."""
    model = fit_on(docs, grades(labels), n_grades=N_GRADES)
    return score(docs, model, above=N_GRADES - 2).withColumn("keep", F.col("p_above") >= keep_at)
