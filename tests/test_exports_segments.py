import itertools
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from millrace.functions import segment
from millrace.operators import merge
from millrace.plans import index
from millrace.sources import records
from millrace.streaming import gauges


def _values(spark, path):
    return sorted(r.value for r in spark.read.format("record_file").option("path", path).load().collect())


def test_two_exports_give_each_record_once_and_a_failed_one_none(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/log", spark.createDataFrame([(k, f"n{k}" if k % 2 else None) for k in range(20)], "id bigint, name string")
    assert records.export_new(df.filter("id < 8"), "id", path) == 7
    assert records.export_new(df.filter("id < 8"), "id", path) == 7
    boom = F.udf(lambda k: 1 // 0 if k == 19 else k, "bigint")
    with pytest.raises(Exception, match="ZeroDivision"):
        records.export_new(df.select("id", boom("id").alias("name")), "id", path)
    assert records.checkpoint(path) == 7 and len(_values(spark, path)) == 8
    assert records.export_new(df, "id", path) == 19
    assert _values(spark, path) == sorted(r[0] for r in df.select(F.to_json(F.struct("id", "name"))).collect())
    names = sorted(x.name for x in (tmp_path / "log").iterdir() if not x.name.startswith("_draft-"))  # a draft is nothing to readers
    assert names == [f"upto-{7:020d}", f"upto-{19:020d}"]
    one = next((tmp_path / "log" / names[0]).iterdir()).read_bytes()
    at, end = struct.unpack("<qq", one[:16])
    assert (at, end) == (7, len(one))


def test_files_roll_over_and_an_empty_export_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    records.register(spark)
    rows = spark.createDataFrame([("", 0, "x" * 100) for _ in range(50)], "file string, seq bigint, value string").coalesce(1)
    rows.write.format("record_file").mode("append").option("path", path).save()
    assert len(_values(spark, path)) == 50 and records.checkpoint(path) == records.NONE
    assert records.export_new(spark.createDataFrame([], "id bigint"), "id", f"{tmp_path}/none") == records.NONE and _values(spark, f"{tmp_path}/none") == []


def test_a_stream_of_exports_goes_on_where_it_ended(spark, tmp_path):
    path, df = f"{tmp_path}/log", spark.range(30).withColumn("v", F.col("id") * 2)
    seen = []
    for upto in (10, 10, 30):
        records.export_new(df.filter(F.col("id") < upto), "id", path)
        stream = spark.readStream.format("record_file").option("path", path).load()
        gauges.drain(stream, lambda b, k: seen.append((k, b.count())), f"{tmp_path}/checkpoint")
    assert [n for _, n in seen if n] == [10, 20]


def test_surrogate_ids_are_dense_and_hang_on_the_keys_alone(spark):
    target = spark.createDataFrame([("b", 4), ("m", 9)], "k string, id bigint")
    keys = [f"{c}{k}" for c in "zabm" for k in range(50)] + ["b", "m", None, "a1", "a1"]
    batch = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate(keys)], "k string, v string")
    results = []
    for df in (batch.repartition(1), batch.repartition(7), batch.orderBy(F.desc("k"))):
        added, ids = merge.insert_returning(target, df, ["k"])
        results.append((sorted(map(tuple, added.select("k", "v", "id").collect())), sorted(map(tuple, ids.select("k", "id").collect()))))
    assert results[0] == results[1] == results[2]
    new = sorted({k for k in keys if k} - {"b", "m"})
    assert results[0][1] == sorted([*((k, 10 + i) for i, k in enumerate(new)), ("b", 4), ("m", 9)])
    assert dict((k, v) for k, v, _ in results[0][0])["a1"] == "v203"  # the least of its rows
    added, ids = merge.insert_returning(target.limit(0), batch.limit(0), ["k"])
    assert added.count() == ids.count() == 0


def test_best_paths_equal_all_paths():
    rng = random.Random(1)
    for _ in range(200):
        counts = {"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(1, 9) for _ in range(12)}
        d = segment.Dictionary(counts)
        run = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        total = sum(counts.values())
        weight = lambda w: math.floor(1e6 * math.log(counts.get(w, 1) / total))
        paths = []
        for cuts in itertools.product((0, 1), repeat=len(run) - 1):
            ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(run)]
            words = [run[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if all(len(w) == 1 or w in counts for w in words):
                paths.append((sum(map(weight, words)), [len(w) for w in words], words))
        best = max(paths)
        assert sum(map(weight, d.best(run))) == best[0] and "".join(d.best(run)) == run
        assert d.best(run) == max(p for p in paths if p[0] == best[0])[2]
        inside = [w for w in d.full(run) if len(w) > 1]
        assert sorted(inside) == sorted(run[a:b] for a in range(len(run)) for b in range(a + 2, len(run) + 1) if run[a:b] in counts)
        covered = {k for a in range(len(run)) for b in range(a + 2, len(run) + 1) if run[a:b] in counts for k in range(a, b)}
        assert [w for w in d.full(run) if len(w) == 1] == [run[k] for k in range(len(run)) if k not in covered]
        assert [w for w in d.search(run) if w in d.best(run)] and set(d.search(run)) >= set(d.best(run))


def test_segmented_columns(spark):
    d = segment.Dictionary({"data": 5, "base": 4, "database": 9, "at": 2, "数据": 3, "数据库": 2, "库": 1})
    df = spark.createDataFrame([(1, "DataBase, dataat 数据库"), (2, None), (3, " ,")], "id int, t string")
    got = {m: {r.id: r.w for r in df.select("id", segment.segmented(F.col("t"), d, m).alias("w")).collect()} for m in ("accurate", "full", "search")}
    assert got["accurate"] == {1: ["database", "data", "at", "数据库"], 2: [], 3: []}
    assert got["full"][1] == ["data", "database", "at", "base", "data", "at", "at", "数据", "数据库"]
    assert got["search"][1] == ["at", "database", "at", "data", "at", "数据", "数据库"]
    with pytest.raises(ValueError):
        segment.Dictionary(dict.fromkeys(range(segment.MAX_WORDS + 1), 1))


def test_best_fragment_prefers_kinds_then_hits_then_the_first(spark):
    rows = [(1, "red one two three Red blue, four. red"), (2, "red red red x blue"), (3, "none"), (4, None), (5, "blue a b c d e blue"), (None, "RED!")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.fragment for r in index.best_fragment(df, "id", "t", ["red", "BLUE"], size=3).collect()}
    mark = lambda w: f"<span class='highlight'>{w}</span>"
    assert got == {1: f"{mark('Red')} {mark('blue')}, four", 2: f"{mark('red')} x {mark('blue')}", 3: None, 4: None, 5: f"{mark('blue')} a b", None: f"{mark('RED')}!"}


def test_gauges_and_files_of_a_run_that_fails_once(spark, tmp_path):
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    there = lambda: len(list((tmp_path / "in").glob("*.parquet")))
    seen, failed = gauges.Gauges(), []

    def stream():
        return gauges.gauged(gauges.consumed(spark, f"{tmp_path}/in", "id bigint", files_per_trigger=1), "g", n=F.count("*"), most=F.max("id"))

    def batch(df, k):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}")
        if k == 1 and not failed:
            failed.append(k)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        gauges.drain(stream(), batch, f"{tmp_path}/checkpoint", seen)
    assert there() >= 3  # of the batch that failed and those after it, no file is gone
    gauges.drain(stream(), batch, f"{tmp_path}/checkpoint", seen)
    got = sorted(r.id for r in spark.read.option("recursiveFileLookup", "true").schema("id bigint").parquet(f"{tmp_path}/out").collect())
    assert got == list(range(40)) and there() < 4
    assert sorted({g["batch"] for g in seen.seen}) == [0, 1, 2, 3] and all(g["n"] == 10 and g["gauge"] == "g" for g in seen.seen)
    assert {r.metric: r.total for r in gauges.totals(spark, seen, "g").collect()}["n"] == 40
