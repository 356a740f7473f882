import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import relational


def test_far_pages_equal_near_ones(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 2, 3, None]), f"n{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "part int, value int, row string")  # names that the written table has too
    order = [F.desc("value"), F.asc("part")]
    want = sorted(rows, key=lambda r: (-(r[1] or 0), r[0]))
    for start, size in ((0, 7), (120, 30), (490, 30), (499, 1), (500, 5), (0, 600)):
        got = [tuple(r) for r in relational.page_from(df, order, start, size, near=0).collect()]
        assert got == want[start : start + size]
    assert [tuple(r) for r in relational.clamped_page(df, order, 99, 40, near=0).collect()] == want[460:]
    assert [tuple(r) for r in relational.clamped_page(df, order, 3, 40, near=0).collect()] == want[80:120]
    assert relational.clamped_page(df.limit(0), order, 3, 40, near=0).count() == 0


def test_values_outside_ranges_equal_brute_force(spark):
    rng = random.Random(5)
    ranges = [(a, a + rng.choice([0, 5, 70_000, 400_000])) for a in (rng.randrange(2_000_000) for _ in range(40))] + [(9, 3), (-70_000, -1), (1_999_990, 2_000_000)]
    values = [rng.randrange(-200_000, 2_600_000) for _ in range(2000)] + [x for r in ranges for x in (r[0] - 1, *r, r[1] + 1)] + [None]
    df, r = spark.createDataFrame([(v,) for v in values], "v bigint"), spark.createDataFrame(ranges, "start bigint, end bigint")
    got = sorted((x.v for x in relational.outside_ranges(df, r, "v").collect()), key=lambda x: (x is None, x))
    assert got == sorted((v for v in values if v is None or not any(a <= v <= b for a, b in ranges)), key=lambda x: (x is None, x))
    assert relational.outside_ranges(df, r.limit(0), "v").count() == len(values)
    for most in ({"max_ranges": 3}, {"max_blocks": 3}):
        with pytest.raises(ValueError):
            relational.outside_ranges(df, r, "v", **most)


def test_places_of_words_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("aAb.é", k=rng.randint(0, 14))) for _ in range(60)] + ["", None, "a\\Eb a\\E", "(a+)"]
    words = ["a", "aa", "ab", "b.", "é", "", "\\e", "(a", "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.p for r in df.select("k", text.positioned(F.col("t"), F.array(*map(F.lit, words))).alias("p")).collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert not got[k]
        else:
            low = t.lower()
            want = sorted({(i, i + len(w), w) for w in words if w for i in range(len(low)) if low.startswith(w, i)})
            assert [tuple(x) for x in got[k]] == want
