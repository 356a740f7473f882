from pyspark.sql import functions as F

from millrace.operators import counters


def test_bloom_filter(spark):
    members, rows = spark.range(4000).toDF("k"), spark.range(24_000).toDF("k").unionByName(spark.createDataFrame([(None,)], "k bigint"))
    size = counters.bloom_size(4000, 0.02)
    bloom = counters.bloom_filter(members, "k", *size)
    near = {r.k: r.might_contain for r in counters.bloom_might_contain(rows, "k", bloom, *size).collect()}
    far = {r.k: r.might_contain for r in counters.bloom_might_contain(rows, "k", bloom, *size, bitmap_bits=0).collect()}
    assert near == far and near.pop(None) is None and all(near[k] for k in range(4000))
    assert 0.01 < sum(near[k] for k in range(4000, 24_000)) / 20_000 < 0.03
    assert bloom.agg(F.max("word")).first()[0] < size[1] // 64


def test_empty_bloom_filter_holds_nothing(spark):
    size = counters.bloom_size(0)
    bloom = counters.bloom_filter(spark.range(0).toDF("k"), "k", *size)
    for most in (0, counters.BITMAP_BITS):
        assert [r.might_contain for r in counters.bloom_might_contain(spark.range(2).toDF("k"), "k", bloom, *size, bitmap_bits=most).collect()] == [False, False]
