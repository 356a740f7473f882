import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import topk

VECTORS = "vec_id bigint, embedding array<float>, label int, score string"


def _brute(rows, modulus, k):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is None or i % modulus:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), math.inf if j is None else j) for b, (j, v) in enumerate(kept) if b != a and len(v) == len(q))
        out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def _rows(n, size, seed, spread):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    return [(i, [c + r.gauss(0, spread) for c in r.choice(centres)]) for i in range(n)]


ODD = [
    (0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]),
    (None, [1.0, 2.0]), (3, [0.5, -0.5]), (4, [0.5, -0.5]), (5, [1.0]), (7, [2.0]), (120, [0.0, 0.0]), (140, []), (160, [-3.0]), (20, [9.0, 9.0]),
]


@pytest.mark.parametrize("rows", [_rows(400, 8, 1, 0.1), _rows(300, 16, 2, 2.0), ODD, [], [(20, [1.0])] * 50, [(i, [1.0, 1.0]) for i in range(90)]])
def test_top_k_equals_brute_force(spark, rows):
    table = spark.createDataFrame([(*x, 1, "extra") for x in rows], VECTORS)
    found = topk.top_k(table, F.col("vec_id") % 20 == 0, k=7, block_rows=130, chunk_rows=6, n_pivots=8)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _brute(rows, 20, 7)


def test_bounds_skip_far_cells():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-9, 9, (2000, 8)) + 400 * c for c in np.eye(8, dtype=int)]).astype(np.int32)
    pivots = x[:: 2000].astype(float)
    d = topk._distances(x.astype(float), pivots)
    topk._prepare(x, d, 256)
    seen = []
    lookup = topk.np.rint
    topk.np = type("np", (), {"__getattr__": lambda s, n: (lambda v: (seen.append(len(v)), lookup(v))[1]) if n == "rint" else getattr(np, n)})()
    try:
        ids, scores = topk.search_block(x[5], 5, True, d[5], np.arange(len(x)), np.ones(len(x), int), x, d, 10, 256)
    finally:
        topk.np = np
    want = x.astype(np.int64) @ x[5].astype(np.int64)
    want[5] = -(10**9)
    order = np.lexsort((np.arange(len(x)), -want))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert sum(seen) < len(x) / 3
