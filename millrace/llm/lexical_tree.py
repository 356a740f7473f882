"""Ranked lexical search by branch and bound over trees of documents.

A first pass restricts every document to the items' terms: (term, times it occurs), and its number of terms in all. From
that table come the counts of the corpus (documents, terms, documents a term) and so each term's weight. The restricted
vectors are then ordered by the frequency of their terms, and a task makes a tree of those of a block of documents: vectors
that begin alike share a path, the most frequent terms lie at the root where they are shared most. A node is an interval of
the sorted documents and keeps the greatest occurrence and the least length factor m below it, so w x tf / (tf + m) of these
bounds what its term adds to any document below.

Of a tree an item sees the nodes of its own terms (a list a term, as in an FP-tree's header), which form a tree again. Sums
of bounds along paths, and the greatest sum below each node, bound whole subtrees. The search goes depth-first into the
child with the greatest bound, leaves out what is bounded below the k-th best score so far (an equal bound is followed, for
the tie may have the smaller id), and scores the documents that are left exactly. A task carries each item's k best from
block to block, so later blocks are cut sooner; Spark merges the tasks' lists.

Items are dealt to blocks of some MB of text, each of which passes over the documents once, so what a task holds doesn't
grow with the number of items.

Defined results: null and empty texts, in documents and items, have no terms; a row of items gets a list of its own, repeated
ones too; repeated documents are ranked each; a null doc_id comes after all others in ties, a null item_id is kept; an item
without terms or without matches gets no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import batch_rows, discard, text_or_empty, written

#: Bytes of a text to those of its terms: A-Z lower-cased, ASCII letters, digits and all beyond ASCII kept, the rest a space.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))
#: Postings of a tree, and documents that are scored at once.
TREE_POSTINGS, AT_ONCE = 1_000_000, 64
_PADDED = np.iinfo(np.int64)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _restrict(vocabulary: list[bytes]):
    """Batches of whole texts to doc_id, n and the restricted vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary)}.get
        for batch in batches:
            n, held, flat = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.encode().translate(_TABLE).split()
                n.append(len(words))
                found = [x for x in map(number, words) if x is not None]
                held.append(len(found))
                flat += found
            row = np.repeat(np.arange(len(n)), held)
            key, tf = np.unique(row * max(1, len(vocabulary)) + np.array(flat, np.int64), return_counts=True)
            ends = np.searchsorted(key, np.arange(len(n) + 1) * max(1, len(vocabulary)))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (key % max(1, len(vocabulary)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


class Tree:
    """The tree of a block. Documents are sorted by their vectors: document d has postings start[d] to start[d + 1] of rank
    (of the term, 0 the most frequent) and tf. Nodes are in depth-first order; of[rank] to of[rank + 1] are a term's places
    in header."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, m: np.ndarray, sizes: np.ndarray, rank: np.ndarray, tf: np.ndarray, n_terms: int):
        starts = np.cumsum(sizes) - sizes
        inside = np.argsort(np.repeat(np.arange(len(sizes)), sizes) * n_terms + rank)
        rank, tf = rank[inside], tf[inside]
        text = rank.astype(">u4").tobytes()
        keys = [text[4 * a : 4 * b] for a, b in zip(starts, starts + sizes, strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        at = _runs(starts[order], sizes[order])
        self.ids, self.null, self.m, self.rank, self.tf = ids[order], null[order], m[order], rank[at], tf[at]
        sizes = sizes[order]
        n = len(sizes)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        # how many terms each document shares with the one before it
        shared = np.full(n + 1, -1)
        if n > 1:
            both = np.minimum(sizes[1:], sizes[:-1])
            place = _runs(np.zeros(n - 1, np.int64), both)
            unlike = self.rank[np.repeat(self.start[1:-1], both) + place] != self.rank[np.repeat(self.start[:-2], both) + place]
            first = np.minimum.reduceat(np.where(unlike, place, _PADDED.max), np.cumsum(both) - both)
            shared[1:n] = np.minimum(first, both)
        document = np.repeat(np.arange(n), sizes)
        depth = np.arange(len(document)) - self.start[document]
        node = np.flatnonzero(depth >= shared[document])
        self.lo, depth = document[node], depth[node]
        self.hi, self.tf_max, self.m_min = self.lo + 1, self.tf[node].copy(), self.m[self.lo].copy()
        wide = np.flatnonzero(depth < shared[self.lo + 1])  # the others hold one document
        for some in np.split(wide[np.argsort(depth[wide], kind="stable")], np.cumsum(np.unique(depth[wide], return_counts=True)[1])[:-1]):
            if not len(some):
                continue
            d = int(depth[some[0]])
            cuts = np.flatnonzero(shared <= d)  # here vectors differ from the one before within the first d + 1 terms
            self.hi[some] = cuts[np.searchsorted(cuts, self.lo[some], side="right")]
            column = np.zeros(n + 1, np.int64)
            deep = np.flatnonzero(sizes > d)
            column[deep] = self.tf[self.start[deep] + d]
            ends = np.column_stack([self.lo[some], self.hi[some]]).ravel()
            self.tf_max[some] = np.maximum.reduceat(column, ends)[::2]
            self.m_min[some] = np.minimum.reduceat(np.append(self.m, _PADDED.max), ends)[::2]
        of = self.rank[node]
        self.header = np.argsort(of, kind="stable")
        self.of = np.searchsorted(of[self.header], np.arange(n_terms + 1))
        self.node_rank = of

    def nodes(self, ranks: np.ndarray) -> np.ndarray:
        """The nodes of some terms, in depth-first order."""
        return np.sort(self.header[_runs(self.of[ranks], self.of[ranks + 1] - self.of[ranks])])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _adds(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """An item's k best documents so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score below this can't be among them."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def take(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least
        if good.any():
            score, ids, null = np.concatenate([self.score, score[good]]), np.concatenate([self.ids, ids[good]]), np.concatenate([self.null, null[good]])
            order = np.lexsort((ids, null, -score))[: self.k]
            self.score, self.ids, self.null = score[order], ids[order], null[order]


def search(tree: Tree, ranks: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Brings best up to date with a tree's documents. weight has the item's terms' weights, and zero for all others. The
    number of documents that were scored."""
    node = tree.nodes(ranks)
    if not len(node):
        return 0
    lo, hi = tree.lo[node], tree.hi[node]
    own = _adds(weight[tree.node_rank[node]], tree.tf_max[node], tree.m_min[node])
    # path: what a node and those above it add at most. Those that end before it are no longer above
    by_end = np.argsort(hi, kind="stable")
    path = np.cumsum(own) - np.concatenate([[0], np.cumsum(own[by_end])])[np.searchsorted(hi[by_end], lo, side="right")]
    after = np.searchsorted(lo, hi)  # the first node that isn't below
    below = path.copy()
    inner = np.flatnonzero(after > np.arange(len(node)) + 1)
    if len(inner):
        below[inner] = np.maximum.reduceat(np.append(path, 0), np.column_stack([inner, after[inner]]).ravel())[::2]
    if below.max() < best.least:
        return 0

    def children(first: int, last: int) -> np.ndarray:
        """Those of the nodes from first to last that aren't below another one of them."""
        ends = np.maximum.accumulate(hi[first:last])
        return first + np.flatnonzero(np.append(True, lo[first + 1 : last] >= ends[:-1])) if last > first else np.zeros(0, np.int64)

    pending: list[np.ndarray] = []
    waiting = scored = 0

    def score() -> None:
        nonlocal pending, waiting, scored
        documents = np.concatenate(pending)
        pending, waiting, scored = [], 0, scored + len(documents)
        sizes = tree.start[documents + 1] - tree.start[documents]
        at = _runs(tree.start[documents], sizes)
        adds = _adds(weight[tree.rank[at]], tree.tf[at], np.repeat(tree.m[documents], sizes))
        sums = np.concatenate([[0], np.cumsum(adds)])
        ends = np.cumsum(sizes)
        best.take(sums[ends] - sums[ends - sizes], tree.ids[documents], tree.null[documents])

    roots = children(0, len(node))
    stack = roots[np.argsort(below[roots], kind="stable")].tolist()
    while stack:
        v = stack.pop()
        if below[v] < best.least:
            continue
        under = children(v + 1, int(after[v]))
        if path[v] >= best.least:
            mine = np.ones(hi[v] - lo[v], bool)  # documents that end here, as far as the item sees
            for c in under.tolist():
                mine[lo[c] - lo[v] : hi[c] - lo[v]] = False
            documents = lo[v] + np.flatnonzero(mine)
            pending.append(documents)
            waiting += len(documents)
            if waiting >= AT_ONCE:
                score()
        able = under[below[under] >= best.least]
        stack += able[np.argsort(below[able], kind="stable")].tolist()
    if waiting:
        score()
    return scored


def _searcher(rank_of: np.ndarray, weight_of: np.ndarray, items: list[tuple[int | None, list[int]]], mean: tuple[int, int], k: int):
    """Batches of restricted vectors to each item's k best of the task."""
    n_docs, all_terms = mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        ranks = [np.sort(rank_of[np.array(t, np.int64)]) for _, t in items]
        weight = np.zeros(len(rank_of), np.int64)
        held: list[tuple] = []

        def grow() -> None:
            ids, null, n, sizes, terms_, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            m = 50 + (50 * n * n_docs) // all_terms
            tree = Tree(ids, null, m, sizes, rank_of[terms_], tf, len(rank_of))
            for mine, found in zip(ranks, best, strict=True):
                weight[mine] = weight_of[mine]
                search(tree, mine, weight, found)
                weight[mine] = 0

        for batch in batches:
            sizes = batch.column("terms").value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TREE_POSTINGS, side="right")))
                part = batch.slice(at, to - at)
                ids = part.column("doc_id")
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("n").to_numpy(), sizes[at:to].astype(np.int64), part.column("terms").flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(np.int64)))
                at = to
                if sum(len(x[4]) for x in held) >= TREE_POSTINGS // 2:
                    grow()
        if held:
            grow()
        for place, (item_id, _) in enumerate(items):
            b = best[place]
            count = len(b.score)
            if count:
                columns = [pa.array([place] * count, pa.int32()), pa.array([item_id] * count, pa.int64()), pa.array(b.ids, mask=b.null), pa.array(b.score)]
                yield pa.RecordBatch.from_arrays(columns, ["place", "item_id", "doc_id", "score"])

    return run


def _ranked_block(docs: DataFrame, items: list[tuple[int | None, str | None]], k: int) -> DataFrame | None:
    """(place of the item, item_id, doc_id, score) of each task's k best, of a block of items; None if they have no terms."""
    words = [sorted(set(terms(text))) for _, text in items]
    vocabulary = sorted({t for found in words for t in found})
    if not vocabulary:
        return None
    number = {t: j for j, t in enumerate(vocabulary)}
    with batch_rows(docs.sparkSession, 500):
        restricted = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_restrict(vocabulary), "doc_id bigint, n bigint, terms array<int>, tfs array<int>"), "lexical-vectors")
    n_docs, all_terms = restricted.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in restricted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row a term of the items
        df[t] = n
    rank_of = np.empty(len(df), np.int64)
    rank_of[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weight_of = np.zeros(len(df), np.int64)
    weight_of[rank_of] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
    asked = [(item_id, [number[t] for t in found]) for (item_id, _), found in zip(items, words, strict=True)]
    found = restricted.filter(F.size("terms") > 0).mapInArrow(_searcher(rank_of, weight_of, asked, (n_docs, all_terms), k), "place int, item_id bigint, doc_id bigint, score bigint")
    found = written(found, "lexical-found")
    discard(restricted)
    return found


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 50, block_bytes: int = 1 << 22) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for every row of items (item_id, text), of those with
    a score above 0."""
    size = items.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for block in range(blocks):
        mine = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _ranked_block(docs, [(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect()], k)
        if found is not None:
            parts.append(found.withColumn("block", F.lit(block)))
    if not parts:
        return items.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOUND = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_FOUND} AS ts FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, list_distinct({_FOUND}) AS ts FROM benchmark),
c AS (SELECT count_if(len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
t AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), c),
m AS (SELECT d, doc_id, 50 + (50 * len(ts) * n) // l AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT i, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM (SELECT i, item_id, unnest(ts) AS term FROM i) JOIN w USING (term) JOIN t USING (term) JOIN m USING (d) GROUP BY i, item_id, d, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
