import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge, relational, trees
from millrace.plans import index
from millrace.sources import files
from millrace.streaming import pipelines

SF = "/root/testdata/sf0.001"


def test_record_files(spark, tmp_path):
    files.register(spark)
    path = str(tmp_path / "r")
    spark.createDataFrame([("a",), ("é b",), (" ",), (None,), ("x" * 5000,)], "value string").select(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("seq"), "value").coalesce(2).write.format("record_file").mode("append").option("path", path).save()
    assert sorted(r.value for r in spark.read.format("record_file").option("path", path).load().collect()) == ["a", "x" * 5000, "é b"]


def test_lifo_store(spark, tmp_path):
    files.register(spark)
    path = str(tmp_path / "s")
    files.lifo_push(path, [b"1", b"22"])
    files.lifo_push(path, [b"333"])
    got = spark.read.format("lifo_store").option("path", path).load().orderBy("seq").collect()
    assert [bytes(r.value) for r in got] == [b"333", b"22", b"1"]


def test_entity_json_and_trees(spark, tmp_path):
    (tmp_path / "d").mkdir()
    tree = {"InfoHash": "H", "Name": "n", "FileSize": 9, "Files": [{"Name": "x", "Files": [{"Name": "y", "FileSize": 4}, {"Name": "z", "FileSize": 5, "Files": []}]}, {"Name": "w", "FileSize": 0}]}
    (tmp_path / "d" / "a.json").write_text(json.dumps(tree))
    (tmp_path / "b.json").write_text("not json")
    got = files.entity_json(spark, str(tmp_path))
    leaves = trees.flatten_json(got, "InfoHash", "Files").collect()
    assert sorted((r.path, r.size) for r in leaves) == [(["w"], 0), (["x", "y"], 4), (["x", "z"], 5)]


def test_counters_and_retries(spark, tmp_path):
    (tmp_path / "c.txt").write_text("A\nB:3\nA:x\n\n")
    got = files.counters(spark, str(tmp_path / "c.txt"))
    assert sorted((r.key, r.n) for r in got.collect()) == [("A", 1), ("A", 1), ("B", 3)]
    assert files.counters(spark, str(tmp_path), older_than="2000-01-01T00:00:00").count() == 0
    (tmp_path / "r.retry").write_text("1" * 40 + ":x\n" + "2" * 40 + ":y\nnone\n \n" + "3" * 40 + ":z\n")
    done = spark.createDataFrame([("2" * 40,)], "infohash string")
    assert [r.infohash for r in files.retry_list(spark, str(tmp_path), done).collect()] == ["1" * 40]
    assert files.settings(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    (tmp_path / "s.json").write_text('{"a": "7", "b": {"c": 1}}')
    assert files.settings(str(tmp_path / "s.json"), {"a": 1, "b": {"d": 2}}) == {"a": 7, "b": {"c": 1, "d": 2}}


def test_sinks(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    files.write_hourly_counters(events, str(tmp_path / "h"), "ts", "event_type")
    assert files.counters(spark, str(tmp_path / "h")).agg(F.sum("n")).first()[0] == events.count()
    files.write_daily_json(events, str(tmp_path / "j"), "ts")
    assert spark.read.json(str(tmp_path / "j")).count() == events.count()
    assert "<lastmod>2024-01-" in files.sitemap(events, "http://x", "ts").first().xml


def _stream(spark, name):
    return pipelines.read_stream(spark, f"{SF}/{name}.parquet", spark.read.parquet(f"{SF}/{name}.parquet").schema)


def _drained(spark, stream, tmp_path, name, mode="append"):
    pipelines.run_once(stream, str(tmp_path / name), mode=mode, name=name)
    return sorted(map(tuple, spark.table(name).collect()))


@pytest.fixture
def events(spark, tmp_path):
    """A folder that streams can read, with one late event that closes all windows before it."""
    rows = spark.read.parquet(f"{SF}/events.parquet")
    last = rows.agg(F.max("ts")).first()[0] + timedelta(days=3)
    path = str(tmp_path / "events")
    rows.unionByName(rows.limit(1).withColumn("ts", F.lit(last)).withColumn("event_type", F.lit("end"))).coalesce(1).write.parquet(path)
    return path


def test_streams_equal_batches(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    stream = pipelines.read_stream(spark, events, batch.schema)
    want = sorted(map(tuple, pipelines.hourly_counts(batch, "ts", "event_type").filter("event_type <> 'end'").collect()))
    assert _drained(spark, pipelines.hourly_counts(stream, "ts", "event_type"), tmp_path, "hours") == want
    want = sorted(map(tuple, pipelines.last_seen(batch, "ts", "user_id").collect()))
    assert _drained(spark, pipelines.last_seen(stream, "ts", "user_id"), tmp_path, "seen", "complete") == want
    pick = lambda e: pipelines.matched(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts"), ["user_id"], "ts", within="30 minutes")
    want = sorted(map(tuple, pick(batch).collect()))
    assert _drained(spark, pick(stream), tmp_path, "pairs") == want


def test_packets(spark):
    from millrace.functions.codecs import bencode

    now = datetime(2024, 1, 1)
    rows = [(bencode({"y": "q", "q": "get_peers", "t": "aa", "a": {"info_hash": "h" * 20}}), 1, 2, now), (b"junk", 3, 4, now)]
    good, bad = pipelines.decoded(spark.createDataFrame(rows, "data binary, ip bigint, port int, ts timestamp"))
    row = good.first()
    assert (row.kind, row.t, row.infohash) == ("query:get_peers", "aa", "h" * 20) and [r.ip for r in bad.collect()] == [3]


def test_carry_over(spark):
    a = spark.createDataFrame([("x", 1), ("y", 3)], "k string, n bigint")
    go, rest = pipelines.carry_over(a, a.limit(0), "k", "n")
    assert [r.k for r in go.collect()] == ["y"]
    assert [(r.k, r.n) for r in pipelines.carry_over(a.filter("k = 'x'"), rest, "k", "n")[0].collect()] == [("x", 2)]


def test_versioned_table(spark, tmp_path):
    table = merge.VersionedTable(spark, str(tmp_path / "t"))
    table.commit(spark.range(3).toDF("id"))
    first = table.version()
    grown = merge.insert_ignore(table.read(), spark.createDataFrame([(2,), (9,), (9,)], "id bigint"), ["id"])
    table.commit(grown)
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 9] and table.version() != first


def test_overwrites_repeat_and_additions_do_not(spark):
    old = spark.createDataFrame([(1, "a", 5)], "id bigint, name string, num bigint")
    batch = spark.createDataFrame([(1, "b", 2), (1, None, 3), (2, "c", 1)], "id bigint, name string, num bigint")
    rules = {"name": "overwrite", "num": "add"}
    once = merge.merge(old, batch, ["id"], rules)
    assert sorted(map(tuple, once.collect())) == [(1, "b", 10), (2, "c", 1)]
    assert sorted(map(tuple, merge.merge(once, batch, ["id"], rules).collect())) == [(1, "b", 15), (2, "c", 2)]


def test_index_boundaries(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red a fox fox"), (3, "bad thing"), (4, None)], "id bigint, t string")
    spec = index.IndexSpec("id", {"t": 10.0}, blocked=["bad"])
    postings, fields = index.build(docs, spec)
    hit = lambda q: sorted(r.doc_id for r in index.search(postings, fields, q, spec).collect())
    assert hit("red fox") == [1, 2] and hit("fox a") == [1, 2] and hit("a") == [2] and hit("") == [1, 2, 4] and hit("   ") == [] and hit("thing") == []


def test_nearest_by_xor_equals_brute_force_whatever_the_prefixes(spark):
    rng = random.Random(4)
    ids = [rng.randbytes(20) for _ in range(150)] + [b"\x07" * 6 + rng.randbytes(14) for _ in range(150)] + [b"\x07" * 20] * 40 + [b"\xff" * 20, b"", b"\x07"]
    nodes = spark.createDataFrame(list(enumerate(ids)), "k int, x binary")
    asked = [rng.randbytes(20) for _ in range(30)] + [b"\x07" * 20, b"\x07" * 6 + rng.randbytes(14), b"\x08" * 20, b"", b"\x00"]
    targets = spark.createDataFrame(list(enumerate(asked)), "q int, t binary")
    for about in (4, 32, 1000):
        got = {(r.q, r.rank): r.k for r in relational.nearest_by_xor(targets, nodes, target="t", node="x", about=about).collect()}
        number = lambda x: int.from_bytes(x.ljust(21, b"\0"))
        want = {(q, r): k for q, t in enumerate(asked) for r, (_, k) in enumerate(sorted((number(x) ^ number(t), k) for k, x in enumerate(ids))[:8], 1)}
        assert got == want
    few = relational.nearest_by_xor(targets, nodes.limit(3), target="t", node="x")
    assert few.count() == 3 * len(asked) and relational.nearest_by_xor(targets, nodes.limit(0), target="t", node="x").count() == 0
    assert relational.nearest_by_xor(targets.limit(0), nodes, target="t", node="x").count() == 0


def test_token_bucket_takes_only_what_it_allows(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(1, "a", at(0), 4), (2, "a", at(1), 3), (3, "a", at(1), 1), (4, "a", at(9), 1), (5, "a", at(10), 5), (6, "a", at(19), 1), (7, "b", at(1), 6), (8, "b", at(2), 5), (9, None, at(0), 5), (10, "b", None, 1), (11, "b", at(3), None)]
    events = spark.createDataFrame(rows, "id int, k string, ts timestamp, n int")
    got = {r.id: r.allowed for r in pipelines.token_bucket(events, "ts", "n", 5, 600, "id", "k").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False, 8: True, 9: True, 10: None, 11: True}
    assert {r.allowed for r in pipelines.token_bucket(events, "ts", "n", 0, 600, "id").collect()} == {True}
    assert pipelines.token_bucket(events.limit(0), "ts", "n", 5, 600, "id").count() == 0


def test_token_bucket_over_many_batches(spark):
    events = spark.range(30_000).select("id", F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("n"), F.lit("hot").alias("k"))
    got = [r.allowed for r in pipelines.token_bucket(events, "ts", "n", 3, 10, "id", "k").orderBy("id").collect()]
    assert got == [i % 10 < 3 for i in range(30_000)]


def test_search_page_and_rendering(spark):
    hits = spark.createDataFrame([(i, 1.0) for i in range(1, 8)], "doc_id long, score double")
    stored = hits.select("doc_id", (F.col("doc_id") % 2).alias("hot"))
    rows = [(1, "red fox", ["x"]), (2, "fox", ["a red b", "c", "RED", "red red", "red"]), (3, "fox", []), (4, None, None), (5, "fox", ["none"])]
    entities = spark.createDataFrame(rows, "doc_id long, name string, files array<string>")
    page = lambda n, size: index.search_page(hits, stored, entities, [F.desc("hot"), F.asc("doc_id")], n, size)
    assert [sorted(r.doc_id for r in page(n, 3).collect()) for n in (1, 2, 3, 9)] == [[1, 3, 5], [2, 4, 7], [6], [2, 4, 6]]
    assert sorted(r.doc_id for r in page(5, 20).collect()) == [1, 2, 3, 4, 5, 6, 7]
    got = {r.doc_id: (r.name, r.files, r.shown) for r in index.rendered(page(1, 20), "name", "files", ["red"]).collect()}
    m = lambda x: f"<span class='highlight'>{x}</span>"
    assert got[1] == (f"{m('red')} fox", ["x"], None) and got[2] == ("fox", None, [f"a {m('red')} b", m("RED"), f"{m('red')} {m('red')}"])
    assert got[3] == ("fox", [], None) and got[4] == (None, None, None) and got[5] == ("fox", None, []) and got[7] == (None, None, None)


def test_fold_without_order_is_the_same_on_any_partitioning(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"), F.col("id").alias("b"))
    rules = {"a": "overwrite", "b": "insert_only"}
    each = [sorted(map(tuple, merge.fold(rows.repartition(n), ["k"], rules).collect())) for n in (1, 7)]
    assert each[0] == each[1] == [(0, 198, 0), (1, 199, 1), (2, 197, 2)]
