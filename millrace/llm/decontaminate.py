"""Benchmark decontamination by latent semantic retrieval.

1. Passages are windows of 32 words every 16 words of whole texts, their words hashed to 2^18 slots and weighted by idf, which
   is counted over the whole corpus. Columns are the benchmark's words; words that every twentieth passage holds say
   little and are left out, unless an item would lose a tenth of its weight by that.
2. Distributed randomised SVD of these TF-IDF rows: tasks sum A'(A G) over all passages of the corpus for a random G, to
   which the benchmark's own rows add as much again; the driver orthonormalises, and the leading RANK directions span the
   latent space. Benchmark passages are folded into it. What the directions miss of them is lost to the search, as it is
   for the corpus.
3. Cosine search of all passages against all benchmark passages in the latent space gives candidates.
4. A candidate counts if the longest common subsequence with a stretch of the words around it (half as long again as the
   benchmark passage) holds, by idf weight, at least `overlap` of that passage, or at least `overlap_with_answer` of it
   and all of its answer: its last sentence (where it has more than one), or for a single sentence its last quarter.
5. Items under min_words words are too short for that: texts of which a whole line has their words, and no others, are
   found by equality.

The texts are read three times (counts, SVD, search), however long the benchmark is. It is an evaluation set whose words fit
the driver (checked: max_benchmark_bytes); candidates are searched in groups of 256 passages.

Defined results: null and empty texts are clean; benchmark items that are null or without words are not looked for; a
document is judged by its text alone, so repeated rows and null ids are judged alike; ties go to the smaller item_id;
other columns pass through. Punctuation and case don't count; a space is white space of ASCII or U+00A0.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_rows, text_or_empty, written
from millrace.llm.words import bytes_hashes

SLOT_BITS, WORDS, STEP, AROUND = 18, 32, 16, 64
GROUP, PART_WORDS, RANK = 256, 64, 64
#: Passages of the benchmark that share a latent space, at most; more are dealt to spaces of PACK each, for RANK directions hold
#: so many well.
TOGETHER, PACK = 256, 128
COMMON = 0.05  # share of passages from which on a word is left out of the latent space
_PUNCTUATION = b".,;:!?\"'()[]{}<>|*-_$%&#"
_OTHERS = "«»“”„…\u2018\u2019"


def slots_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words of texts one after another, and how many each has."""
    parts = []
    for text in texts:
        text = text.lower()
        if not text.isascii():
            text = text.replace("\u00a0", " ")
            for mark in _OTHERS:
                text = text.replace(mark, "")
        parts.append(text.encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION))
    hashes, sizes = bytes_hashes(parts)
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), sizes


@dataclass
class Windows:
    """The windows of some texts, as rows of the TF-IDF matrix: a window is a half of STEP words and the next one, if any."""

    text: np.ndarray
    begin: np.ndarray  # its first place in the texts' slots
    first: np.ndarray  # its first half
    second: np.ndarray  # its second one; a number beyond all halves if there is none
    length: np.ndarray  # of the row, over all its words
    half: np.ndarray  # of each distinct word with a column in a half, ascending
    column: np.ndarray
    halves: int

    def times(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows have a word with a column, and those rows times g (which is weighted by idf)."""
        some, sums = _sums_of(self.half, g, self.column)
        h = np.zeros((self.halves + 1, g.shape[1]), np.float32)
        h[some] = sums
        has = np.zeros(self.halves + 1, bool)
        has[some] = True
        rows = np.flatnonzero(has[self.first] | has[self.second])
        return rows, (h[self.first[rows]] + h[self.second[rows]]) / self.length[rows, None]

    def times_back(self, rows: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns, and what the transposed rows times z add to each (but for its idf)."""
        u = np.zeros((self.halves + 1, z.shape[1]), np.float32)
        z = z / self.length[rows, None]
        u[self.first[rows]] = z  # a half is the first one of one window, and the second one of another
        u[self.second[rows]] += z
        column, half = _by_column(self)
        return _sums_of(column, u, half)


def windows(slots: np.ndarray, sizes: np.ndarray, place: np.ndarray, idf: np.ndarray) -> Windows:
    """Of texts with sizes words; words in both halves of a window count twice."""
    n_halves = -(-sizes // STEP)
    count = np.where(sizes > 0, np.maximum(1, n_halves - 1), 0)
    halves = int(n_halves.sum())
    text = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(sizes) - sizes)[text] + k * STEP
    first = (np.cumsum(n_halves) - n_halves)[text] + k
    second = np.where(k + 1 < n_halves[text], first + 1, halves)
    square = np.concatenate([[0], np.cumsum(idf[slots] ** 2)])
    end = np.minimum(np.cumsum(sizes)[text], begin + WORDS)
    length = np.sqrt(np.maximum(1e-12, square[end] - square[begin])).astype(np.float32)
    at = np.flatnonzero(place[slots] >= 0)
    ends = np.cumsum(sizes)
    of = np.searchsorted(ends, at, side="right")
    both = ((np.cumsum(n_halves) - n_halves)[of] + (at - (ends - sizes)[of]) // STEP) << SLOT_BITS | place[slots[at]]
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return Windows(text, begin, first, second, length, both >> SLOT_BITS, both & ((1 << SLOT_BITS) - 1), halves)


def _groups_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """About a MB of texts, or one longer text."""
    for batch in batches:
        texts, held = [], 0
        for text in batch.column("text"):
            texts.append(text.as_py())
            held += len(texts[-1])
            if held > 1 << 20:
                yield texts
                texts, held = [], 0
        if texts:
            yield texts


def _sum_parts(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("body"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([np.asarray(total).tobytes()], pa.binary())})


def _summed(df: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays that tasks give in parts of 64k numbers: parts are added up by executors."""
    out = np.zeros(size)
    for row in df.groupBy("part").applyInArrow(_sum_parts, "part int, body binary").collect():
        body = np.frombuffer(row.body, np.float64)
        out[row.part * 65536 : row.part * 65536 + len(body)] = body
    return out


def _parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(total), 65536):
        yield pa.RecordBatch.from_arrays([pa.array([k // 65536], pa.int32()), pa.array([total[k : k + 65536].tobytes()], pa.binary())], ["part", "body"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many passages each slot occurs, and the number of passages."""
    every, none = np.arange(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)
    total = np.zeros((1 << SLOT_BITS) + 1)
    for texts in _groups_of_texts(batches):
        w = windows(*slots_of(texts), every, none)
        # once for each half that has it and ends a window or begins one, less once for two halves of one window
        windows_of = np.bincount(w.first, minlength=w.halves + 1) + np.bincount(w.second, minlength=w.halves + 1)
        total[:-1] += np.bincount(w.column, weights=windows_of[w.half], minlength=1 << SLOT_BITS)
        column, half = _by_column(w)
        paired = np.zeros(w.halves + 1, bool)
        paired[w.first] = w.second < w.halves
        twice = (column[1:] == column[:-1]) & (half[1:] == half[:-1] + 1) & paired[half[:-1]]
        total[:-1] -= np.bincount(column[1:][twice], minlength=1 << SLOT_BITS)
        total[-1] += len(w.text)
    yield from _parts(total)


def inverse_frequencies(counts: np.ndarray) -> np.ndarray:
    return np.log((2 + counts[-1]) / (1 + counts[:-1]))


@dataclass
class Benchmark:
    """Benchmark passages, ready to be searched for."""

    items: list[int]
    slots: list[np.ndarray]
    answers: list[int]  # at which word the answer begins
    place: np.ndarray  # slot to column, -1 outside the vocabulary
    idf: np.ndarray  # of all slots
    weight: np.ndarray  # idf of each column
    matrix: np.ndarray  # a row a passage, a column a vocabulary slot, unit length over all its words


def benchmark_passages(rows: list[tuple[int, str | None]]) -> list[tuple[int, np.ndarray, int]]:
    """item_id, slots of the words, start of the answer. Long items are cut into parts of at most PART_WORDS words."""
    out = []
    for item, text in sorted(((i, t) for i, t in rows if t is not None and i is not None), key=lambda x: (x[0], x[1])):
        sentences = re.split(r"(?<=[.!?])\s+", text)
        slots, sizes = slots_of(sentences)
        last = len(slots) - int(next((n for n in sizes[::-1] if n), 0))
        n = max(1, -(-len(slots) // PART_WORDS))
        cuts = [len(slots) * k // n for k in range(n + 1)]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                out.append((item, slots[a:b], last - a if a < last < b else (b - a) * 3 // 4))
    return out


def make_benchmark(passages: list[tuple[int, np.ndarray, int]], idf: np.ndarray, frequent: np.ndarray) -> Benchmark:
    """frequent: the slots that COMMON passages hold."""
    distinct = [np.unique(s) for _, s, _ in passages]
    kept = [s[~frequent[s]] for s in distinct]
    kept = [k if (idf[k] ** 2).sum() >= 0.9 * (idf[s] ** 2).sum() else s for k, s in zip(kept, distinct, strict=True)]
    used = np.unique(np.concatenate(kept))
    place = np.full(1 << SLOT_BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    matrix = np.zeros((len(passages), len(used)), np.float32)
    for row, s in zip(matrix, distinct, strict=True):
        inside = s[place[s] >= 0]
        row[place[inside]] = idf[inside] / max(1e-12, float(np.linalg.norm(idf[s])))
    return Benchmark([i for i, _, _ in passages], [s for _, s, _ in passages], [a for _, _, a in passages], place, idf, idf[used].astype(np.float32), matrix)


def _by_column(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The columns of w, ascending, and the half of each, ascending where the column is the same."""
    both = np.sort(w.column << 40 | w.half)
    return both >> 40, both & ((1 << 40) - 1)


def _sums_of(key: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (given ascending), and for each the sum of the rows that at names.

    Keys are cut into pieces of at most STEP rows; first rows of all pieces are added at once, then second ones, and so on."""
    if not len(key):
        return key, rows[at]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(key)]]))
    pieces = -(-sizes // STEP)
    ends = np.cumsum(pieces)
    of = np.repeat(np.arange(len(first)), pieces)
    begin = first[of] + STEP * (np.arange(ends[-1]) - (ends - pieces)[of])
    size = np.minimum(STEP, (first + sizes)[of] - begin)
    turn = np.argsort(-size, kind="stable")  # the longest come first
    begin = begin[turn]
    count = len(size) - np.cumsum(np.bincount(size, minlength=STEP + 1))  # of pieces longer than 0, 1, ..
    sums = rows[at[begin]]
    for k in range(1, STEP):
        if not count[k]:
            break
        sums[: count[k]] += rows[at[begin[: count[k]] + k]]
    out = np.empty_like(sums)
    out[turn] = sums
    return key[first], out if len(out) == len(first) else np.add.reduceat(out, ends - pieces, axis=0)


def _gram_times(shared):
    """Sum of x'(x G) over the rows x of the TF-IDF matrix (but for the columns' idf), and of |x|^2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf, weight, g = shared.value
        g = g * weight[:, None]
        total, energy = np.zeros(g.shape), 0.0
        for texts in _groups_of_texts(batches):
            w = windows(*slots_of(texts), place, idf)
            rows, z = w.times(g)
            columns, sums = w.times_back(rows, z)
            total[columns] += sums
            rows, square = w.times((weight**2)[:, None])
            energy += float((square[:, 0] / w.length[rows]).sum())
        yield from _parts(np.concatenate([total.reshape(-1), [energy]]))

    return run


def latent_basis(texts: DataFrame, benchmark: Benchmark, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Orthonormal columns: the leading right singular directions of the passages of texts (text) and the benchmark's, the
    latter with as much weight as the former."""
    n = benchmark.matrix.shape[1]
    g = np.random.default_rng(seed).standard_normal((n, min(n, rank + 8))).astype(np.float32)
    shared = texts.sparkSession.sparkContext.broadcast((benchmark.place, benchmark.idf, benchmark.weight, g))
    got = _summed(texts.mapInArrow(_gram_times(shared), "part int, body binary"), g.size + 1)
    own = (benchmark.matrix.T @ (benchmark.matrix @ g)).astype(np.float64)
    weight = got[-1] / max(1e-12, float((benchmark.matrix.astype(np.float64) ** 2).sum())) if got[-1] else 1.0
    corpus = got[:-1].reshape(g.shape) * benchmark.weight[:, None]
    return np.linalg.svd(corpus + weight * own, full_matrices=False)[0][:, :rank].astype(np.float32)


def common_weight(item: list[int], around: list[int], weight: np.ndarray) -> np.ndarray:
    """Which words of item are in a common subsequence of the greatest weight with around (booleans)."""
    other = np.array(around, np.int64)
    rows = [np.zeros(len(other) + 1)]
    for word, w in zip(item, weight, strict=True):
        best = rows[-1].copy()
        best[1:] = np.maximum(best[1:], np.where(other == word, rows[-1][:-1] + w, 0))
        rows.append(np.maximum.accumulate(best))
    used, j = np.zeros(len(item), bool), len(other)
    for i in range(len(item), 0, -1):
        if rows[i][j] > rows[i - 1][j]:
            j = int(np.searchsorted(rows[i][: j + 1], rows[i][j], side="left"))
            used[i - 1] = True
            j -= 1
    return used


def best_overlap(item: np.ndarray, around: np.ndarray, weight: np.ndarray, answer: int, overlap: float, overlap_with_answer: float) -> float | None:
    """The greatest share of item's weight in common with a stretch of around half as long again as item, of those
    stretches that count as a leak; None if none does."""
    total, span, best = weight.sum(), max(12, len(item) * 3 // 2), None
    starts = np.arange(0, max(1, len(around) - span + len(item) // 4), max(1, len(item) // 4))
    same = item[:, None] == around[None, :]
    # whatever the order of its words, a stretch can't hold more than this
    most = np.array([weight[same[:, k : k + span].any(1)].sum() for k in starts]) / total
    for k in np.argsort(-most, kind="stable"):
        if most[k] < min(overlap, overlap_with_answer) or (best is not None and most[k] <= best):
            break
        used = common_weight(item, around[starts[k] : starts[k] + span], weight)
        share = float(weight[used].sum() / total)
        if (share >= overlap or share >= overlap_with_answer and used[answer:].all()) and (best is None or share > best):
            best = share
    return best


FOUND = "digest binary, item_id bigint, cosine double, overlap double"


def _is_line(text: str, item: np.ndarray) -> bool:
    """Whether a line of text has the words of item and no others."""
    slots, sizes = slots_of(text.split("\n"))
    ends = np.cumsum(sizes)
    return any(np.array_equal(slots[ends[k] - sizes[k] : ends[k]], item) for k in np.flatnonzero(sizes == len(item)))


def _search(shared, least: float, overlap: float, overlap_with_answer: float, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark, basis = shared.value
        wanted = benchmark.matrix @ basis
        wanted /= np.maximum(1e-6, np.linalg.norm(wanted, axis=1))[:, None]
        space = basis * benchmark.weight[:, None]
        weights = [np.maximum(1e-3, benchmark.idf[s]) for s in benchmark.slots]
        short = [p for p, s in enumerate(benchmark.slots) if len(s) < min_words]
        wanted[short] = 0
        for texts in _groups_of_texts(batches):
            slots, sizes = slots_of(texts)
            ends = np.cumsum(sizes)
            best: dict[tuple[int, int], tuple[float, float]] = {}
            w = windows(slots, sizes, benchmark.place, benchmark.idf)
            rows, z = w.times(space)
            for some in range(0, len(rows), 4096):
                for first in range(0, len(wanted), GROUP):
                    cosines = z[some : some + 4096] @ wanted[first : first + GROUP].T
                    for r, p in np.argwhere(cosines >= least).tolist():
                        at, p, cosine = rows[some + r], p + first, float(cosines[r, p])
                        t, begin = int(w.text[at]), int(w.begin[at])
                        around = slots[max(ends[t] - sizes[t], begin - AROUND) : min(ends[t], begin + WORDS + AROUND)]
                        share = best_overlap(benchmark.slots[p], around, weights[p], benchmark.answers[p], overlap, overlap_with_answer)
                        if share is not None:
                            best[t, p] = max(best.get((t, p), (0.0, 0.0)), (share, cosine))
            for p in short:
                for t in np.unique(np.searchsorted(ends, np.flatnonzero(slots == benchmark.slots[p][0]), side="right")).tolist():
                    if _is_line(texts[t], benchmark.slots[p]):
                        best[t, p] = (1.0, 1.0)
            digests = {t: hashlib.md5(texts[t].encode("utf-8", "surrogatepass")).digest() for t, _ in best}
            columns = [[digests[t] for t, _ in best], [benchmark.items[p] for _, p in best], [x[1] for x in best.values()], [x[0] for x in best.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["digest", "item_id", "cosine", "overlap"])

    return run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, least: float = 0.25, overlap: float = 0.5, overlap_with_answer: float = 0.4, min_words: int = 5, rank: int = RANK, max_benchmark_bytes: int = 1 << 26
) -> DataFrame:
    """digest (md5 of the text), item_id, cosine, overlap: the best match of each distinct text of docs (text) with a leak."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text; max_benchmark_bytes is {max_benchmark_bytes}")
    passages = benchmark_passages([(r.item_id, r.text) for r in benchmark.select("item_id", "text").collect()])
    if not passages:
        return spark.createDataFrame([], FOUND)
    with batch_rows(spark, 500):
        texts = docs.select(text_or_empty().alias("text")).filter("text <> ''")
        counts = _summed(texts.mapInArrow(_frequencies, "part int, body binary"), (1 << SLOT_BITS) + 1)
        packs = 1 if len(passages) <= TOGETHER else -(-len(passages) // PACK)
        parts = []
        for k in range(packs):
            known = make_benchmark(passages[k::packs], inverse_frequencies(counts), counts[:-1] > COMMON * counts[-1])
            shared = spark.sparkContext.broadcast((known, latent_basis(texts, known, rank)))
            found = texts.mapInArrow(_search(shared, least, overlap, overlap_with_answer, min_words), FOUND)
            parts.append(written(found, "leaks-found") if packs > 1 else found)
        best = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.max(F.struct("overlap", "cosine", -F.col("item_id"))).alias("m"))
        return written(best.select("digest", (-F.col("m.col3")).alias("item_id"), "m.cosine", "m.overlap"), "leaks")


def _digest(text: Column):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, cosine, overlap of every row of docs that has a leak."""
    return docs.select("doc_id", _digest(docs["text"]).alias("digest")).join(find_leaks(docs, benchmark, **options), "digest").drop("digest")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that have none, as they are."""
    leaks = find_leaks(docs, benchmark, **options)
    return docs.join(leaks, _digest(docs["text"]) == leaks["digest"], "left_anti")
