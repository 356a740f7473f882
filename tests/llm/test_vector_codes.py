import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from millrace.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, v string"


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(0, 5), st.integers(1, 4), st.integers(0, 2**32 - 1))
def test_orchard_finds_the_nearest_with_ties_to_the_smaller_index(n, width, spread, seed):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread - 1, spread + 2, (60, width))
    code, distance = vector_codes.OrchardLists(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (distance == every.min(1)).all()


def brute(rows, parts=4, entries=256, rounds=4):
    """vec_id, code, error of rows (vec_id, embedding), and the codebooks, of vectors of one length."""
    good = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    ints = sorted(((i is None, i or 0, [math.floor(1024 * c) for c in v]) for i, v, *_ in good))
    ints = [(None if none else i, v) for none, i, v in ints]
    cut = lambda v, p: v[p * len(v) // parts : (p + 1) * len(v) // parts]
    books = [[list(cut(v, p)) for _, v in ints[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[best(v, p)[1] for p in range(parts)] for _, v in ints]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v), c in zip(ints, chosen, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v in ints:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def test_codes_equal_brute_force_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(k // 2 * 2 if k % 7 == 0 else k, [float(c) for c in rng.integers(-6, 7, 8) / 1024], k % 3 if k % 5 else None) for k in range(300)]
    rows += [rows[3], rows[3], (None, rows[9][1], 1), (900, None, 1), (901, [None] * 8, 1), (902, [math.nan] * 8, 1), (903, [math.inf] * 8, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    want, books = brute(rows, entries=16)
    coded, codebooks = vector_codes.compressed(df.repartition(5), entries=16, keep=["label"])
    hexed = sorted((repr(r.vec_id), "".join(f"{k:02x}" for k in r.code), r.error) for r in coded.collect())
    assert hexed == sorted((repr(i), c, e) for i, c, e in want)
    assert codebooks[8].tolist() == books
    one = next(r for r in coded.collect() if r.vec_id == 1)
    back = vector_codes.decode(one.code, codebooks[8], 8)
    exact = np.floor(np.array(rows[1][1]) * 1024) / 1024
    assert round(((back - exact) ** 2).sum() * 1024**2) == one.error


def test_query_equals_sql_with_labels_that_are_null(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [Row(vec_id=int(k), embedding=[float(c) for c in rng.normal(size=8)] if k % 9 else None, label=int(k) % 4 if k % 6 else None) for k in rng.permutation(400)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/e")
    got = sorted((repr(tuple(r)) for r in vector_codes.op13_rows(spark.read.parquet(f"{tmp_path}/e")).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/e/*.parquet'")
    assert got == sorted(repr(r) for r in db.execute(vector_codes.OP13_SQL).fetchall()) and len(got) > 300


def test_lengths_have_codebooks_of_their_own(spark):
    rows = [(k, [float(k + c) for c in range(k % 3 * 3)]) for k in range(30)]
    coded, codebooks = vector_codes.compressed(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), entries=4)
    assert {size: book.shape for size, book in codebooks.items()} == {0: (4, 4, 0), 3: (4, 4, 1), 6: (4, 4, 2)}
    assert {r.vec_id for r in coded.collect()} == set(range(30)) and all(r.error == 0 for r in coded.collect() if r.vec_id % 3 == 0)


def test_empty_tables_and_sizes_beyond_the_bound(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.op13_rows(empty).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compressed(spark.createDataFrame([(1, [1e9])], "vec_id bigint, embedding array<double>"))
    with pytest.raises(ValueError):
        vector_codes.compressed(spark.createDataFrame([(k, [0.0] * k) for k in range(20)], "vec_id bigint, embedding array<double>"))
