import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import lexical_tree

DOCS = "doc_id bigint, text string, n bigint, terms string"
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """(item_id, rank, doc_id, score) in the words of the contract."""
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            scored += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def same(got, want):
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_terms_are_the_patterns_matches(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert [t.decode() for t in lexical_tree.terms(text)] == split(text)


def _texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "日本", "don't", "x-y"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(n)]


def test_lists_equal_brute_force_with_ties_copies_and_nulls(spark):
    texts = _texts(400, 1) + ["w1 w2 w40 w40"] * 90 + [None, "", "...", "W1 w1 É é" + " w50" * 3000]
    docs = [(None if k in (7, 401) else k, t) for k, t in enumerate(texts)] + [(9, texts[9]), (9, texts[9])]
    items = [(1, "w1 w2 w40"), (2, "W3, w3 w59!"), (3, None), (4, ""), (5, "nowhere"), (None, "été 日本 w30"), (1, "w1 w2 w40"), (6, " ".join(f"w{k}" for k in range(60)))]
    d = spark.createDataFrame([(*r, 5, "z") for r in docs], DOCS).repartition(5)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, rank int")
    for k, block_bytes in ((50, 1 << 22), (7, 20)):
        got = lexical_tree.ranked(d, i, k=k, block_bytes=block_bytes).collect()
        assert same(got, brute(docs, items, k))


def test_small_trees_give_the_same(spark, monkeypatch):
    texts = _texts(300, 2)
    docs, items = list(enumerate(texts)), [(k, t) for k, t in enumerate(_texts(12, 3))]
    d = spark.createDataFrame([(*r, 5, "z") for r in docs], DOCS).coalesce(1)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    words = [sorted(set(lexical_tree.terms(t))) for _, t in items]
    assert sum(map(len, words)) > 20
    monkeypatch.setattr(lexical_tree, "TREE_POSTINGS", 400)
    assert same(lexical_tree.ranked(d, i, k=9).collect(), brute(docs, items, 9))


def _tree(texts):
    vectors = [Counter(split(t)) for t in texts]
    df = Counter(t for v in vectors for t in v)
    rank = {t: k for k, (t, _) in enumerate(df.most_common())}
    kept = [k for k, v in enumerate(vectors) if v]
    ids = np.array(kept)
    m = np.array([50 + 3 * sum(vectors[k].values()) for k in kept])
    sizes = np.array([len(vectors[k]) for k in kept])
    flat = [(rank[t], n) for k in kept for t, n in vectors[k].items()]
    tree = lexical_tree.Tree(ids, np.zeros(len(ids), bool), m, sizes, np.array([r for r, _ in flat]), np.array([n for _, n in flat]), len(rank))
    return tree, rank, vectors, dict(zip(kept, m.tolist(), strict=True))


def test_nodes_are_the_prefixes_and_hold_their_documents_extremes():
    texts = _texts(200, 4) + ["w0 w1 w2"] * 5
    tree, rank, vectors, m = _tree(texts)
    rows = {k: tuple(sorted((rank[t], n) for t, n in v.items())) for k, v in enumerate(vectors) if v}
    prefixes = {}
    for k, row in rows.items():
        for d in range(1, len(row) + 1):
            prefixes.setdefault(tuple(r for r, _ in row[:d]), []).append((row[d - 1][1], m[k]))
    nodes = list(zip(tree.node_rank, tree.hi - tree.lo, tree.tf_max, tree.m_min, strict=True))
    want = [(p[-1], len(x), max(t for t, _ in x), min(y for _, y in x)) for p, x in prefixes.items()]
    assert sorted(tuple(map(int, x)) for x in nodes) == sorted(want)


def test_subtrees_are_left_out():
    texts = _texts(3000, 5)
    tree, rank, vectors, m = _tree(texts)
    weight, ranks = np.zeros(len(rank), np.int64), np.array(sorted(rank[t] for t in ("w3", "w40", "w55")))
    weight[ranks] = [100, 3000, 4000]
    best = lexical_tree.Best(5)
    scored = lexical_tree.search(tree, ranks, weight, best)
    adds = lambda k, t: weight[rank[t]] * ((10**9 * vectors[k][t]) // (1000 * vectors[k][t] + 20 * m[k]))
    want = sorted(((-sum(int(adds(k, t)) for t in ("w3", "w40", "w55") if t in v), k) for k, v in enumerate(vectors) if v))[:5]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.ids.tolist(), strict=True)] == want
    assert scored < 600


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, "")], DOCS), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_tree.ranked(docs.limit(0), items).count() == 0
    assert lexical_tree.ranked(docs, items.limit(0)).count() == 0
    assert lexical_tree.ranked(docs.withColumn("text", F_null()), items).count() == 0


def F_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame([(*r, 5, "z") for r in enumerate([*_texts(200, 6), None, ""])], DOCS).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(k, t) for k, t in enumerate(_texts(9, 7))], "item_id bigint, text string").write.parquet(f"{tmp_path}/b")
    got = lexical_tree.ranked(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/b")).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    db.execute(f"CREATE VIEW benchmark AS FROM '{tmp_path}/b/*.parquet'")
    assert same(got, db.execute(lexical_tree.OP11_SQL).fetchall()) and len(got) > 200
