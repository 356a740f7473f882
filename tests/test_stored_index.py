import random

import pytest
from pyspark.sql.streaming import StreamingQuery

from millrace.plans import index, stored
from millrace.sources.storage import Folder

SPEC = index.IndexSpec("id", {"name": 10.0, "note": 2.0}, weights={"name": 3.0})
SCHEMA = "id bigint, name string, note string"


def _rows(ids, seed=0):
    rng = random.Random(seed)
    words = ["red", "blue", "green", "ring", "a", "stone", "river"]
    return [(k, " ".join(rng.choices(words, k=rng.randint(0, 6))), " ".join(rng.choices(words, k=3)) if k % 4 else None) for k in ids]


def _same(snapshot, spark, rows):
    """The snapshot holds exactly these rows, and finds and scores them as an index built of them alone."""
    postings, fields = index.build(spark.createDataFrame(rows, SCHEMA), SPEC)
    assert sorted(map(tuple, snapshot.postings().select("doc_id", "field", "term", "tf").collect())) == sorted(map(tuple, postings.select("doc_id", "field", "term", "tf").collect()))
    assert sorted(r.doc_id for r in snapshot.documents().collect()) == sorted(k for k, *_ in rows) and snapshot.manifest["live"] == len(rows)
    for text in ("red ring", "a stone", ""):
        plain = {r.doc_id: round(r.score, 9) for r in index.search(postings, fields, text, SPEC).collect()}
        assert {r.doc_id: round(r.score, 9) for r in snapshot.search(text, SPEC).collect()} == plain


@pytest.fixture
def made(spark, tmp_path):
    return stored.StoredIndex(spark, f"file://{tmp_path}/index", SPEC, buckets=4)


def test_commits_replace_delete_and_rebuild(spark, made):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    _same(made.snapshot(), spark, [])
    first = made.commit(df(_rows(range(30))))
    _same(first, spark, _rows(range(30)))
    changed = _rows(range(5, 15), seed=1)
    second = made.commit(df(changed), spark.createDataFrame([(0,), (1,), (99,)], "doc_id bigint"))
    want = [r for r in _rows(range(30)) if r[0] > 14 or 1 < r[0] < 5] + changed
    _same(second, spark, want)
    _same(first, spark, _rows(range(30)))  # whoever holds the first still sees it
    third = made.commit(df(_rows(range(0, 2), seed=3)))  # deleted ids may come back
    _same(third, spark, want + _rows(range(0, 2), seed=3))
    assert [e["id"] for e in made.commit(df([])).segments] == [e["id"] for e in third.segments]
    _same(made.commit(df(_rows(range(3))), replace=True), spark, _rows(range(3)))


def test_searcher_sees_a_commit_only_after_a_refresh(spark, made):
    made.commit(spark.createDataFrame([(1, "red", None)], SCHEMA))
    searcher = stored.Searcher(made)
    pending = made.stage(spark.createDataFrame([(1, "blue", None), (2, "red", None)], SCHEMA))
    found = lambda: sorted(r.doc_id for r in searcher.search("red").collect())
    assert found() == [1] and not searcher.refresh() and found() == [1]
    pending.publish()
    assert found() == [1] and searcher.refresh() and found() == [2]


def test_two_writers_and_a_merge_meanwhile(spark, made):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for k in range(4):
        made.commit(df(_rows(range(10 * k, 10 * k + 10))))
    one, two = made.stage(df(_rows(range(5), seed=5))), made.stage(df(_rows(range(3, 8), seed=6)))
    two.publish()
    merged = made.merge(4)
    assert len(merged.segments) < 5
    last = one.publish()
    want = {r[0]: r for r in _rows(range(40)[:10]) + [x for k in range(1, 4) for x in _rows(range(10 * k, 10 * k + 10))]} | {r[0]: r for r in _rows(range(3, 8), seed=6)} | {r[0]: r for r in _rows(range(5), seed=5)}
    _same(last, spark, list(want.values()))
    assert not made.folder.create(f"versions/{last.version:010d}", "{}")  # a version is never written twice


def test_merging_keeps_what_is_live_and_vacuum_removes_the_rest(spark, made):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    made.commit(df(_rows(range(200))))
    for k in range(5):
        made.commit(df(_rows(range(k, k + 8), seed=k)))
    want = {r[0]: r for r in _rows(range(200))}
    for k in range(5):
        want |= {r[0]: r for r in _rows(range(k, k + 8), seed=k)}
    before = made.snapshot()
    _same(before, spark, list(want.values()))
    files = len(made.folder.files("postings"))
    after = made.merge(4)
    assert len(before.segments) == 6 and len(after.segments) == 2  # the large segment is of another tier and stays
    _same(after, spark, list(want.values()))
    _same(before, spark, list(want.values()))
    made.vacuum(keep=1)
    assert len(made.folder.files("postings")) < files
    _same(made.snapshot(), spark, list(want.values()))
    _same(made.commit(df(_rows(range(300, 305)))), spark, [*want.values(), *_rows(range(300, 305))])


def test_a_search_reads_its_terms_buckets_only(spark, made):
    made.commit(spark.createDataFrame(_rows(range(50)), SCHEMA))
    plan = made.snapshot().postings(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "PushedFilters" in plan
    read = {f.split("bucket=")[1].split("/")[0] for f in made.snapshot().postings(["red"]).select("term", _file()).distinct().toPandas()["f"]}
    assert len(read) == 1


def _file():
    from pyspark.sql import functions as F

    return F.input_file_name().alias("f")


def test_a_drain_that_dies_between_commit_and_removal_is_done_once(spark, made, tmp_path, monkeypatch):
    rows, old = _rows(range(40)), _rows(range(40), seed=9)
    made.commit(spark.createDataFrame([*old, (77, "gone", None)], SCHEMA))
    marks = stored.DirtyMarks(spark, f"file://{tmp_path}/marks")
    entities = spark.createDataFrame(rows, SCHEMA)
    marks.mark(spark.createDataFrame([(k,) for k in [*range(40), 77]], "doc_id bigint"))
    remove = marks.remove

    def dies(batch, batch_id):
        raise RuntimeError("lost")

    monkeypatch.setattr(marks, "remove", dies)
    with pytest.raises(Exception, match="lost"):
        stored.incremental_build(made, marks, entities, f"file://{tmp_path}/drain")
    committed = made.snapshot()
    _same(committed, spark, rows)
    assert marks.pending().count() == 41
    monkeypatch.setattr(marks, "remove", remove)
    again = stored.incremental_build(made, marks, entities, f"file://{tmp_path}/drain")
    assert again.version == committed.version and marks.pending().count() == 0
    marks.mark(spark.createDataFrame([(3,)], "doc_id bigint"))  # what is marked later is drained later
    assert marks.pending().count() == 1
    last = stored.incremental_build(made, marks, spark.createDataFrame(_rows(range(40), seed=4), SCHEMA), f"file://{tmp_path}/drain")
    _same(last, spark, [r for r in rows if r[0] != 3] + [r for r in _rows(range(40), seed=4) if r[0] == 3])


def test_a_drain_takes_as_long_as_it_needs(spark, made, tmp_path, monkeypatch):
    """Whoever waits for a limited time finds that it is over; the drain of many marks takes longer than any fixed time."""
    waits = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: waits(self) if timeout is None else False)
    made.commit(spark.createDataFrame(_rows(range(20), seed=9), SCHEMA))
    marks = stored.DirtyMarks(spark, f"file://{tmp_path}/marks")
    marks.mark(spark.range(20).toDF("doc_id"))
    _same(stored.incremental_build(made, marks, spark.createDataFrame(_rows(range(20)), SCHEMA), f"file://{tmp_path}/drain"), spark, _rows(range(20)))
    assert marks.pending().count() == 0
    with pytest.raises(TimeoutError):
        stored.incremental_build(made, marks, spark.createDataFrame(_rows(range(20)), SCHEMA), f"file://{tmp_path}/drain", seconds=1)


def test_marks_are_few_files_however_many_partitions(spark, tmp_path, monkeypatch):
    marks = stored.DirtyMarks(spark, f"file://{tmp_path}/marks")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marks.mark(spark.range(100).toDF("doc_id"))
        monkeypatch.setattr(stored, "ROWS", 40)
        marks.mark(spark.range(100).toDF("doc_id"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len([f for f, *_ in marks.folder.files("marks") if f.endswith(".parquet")]) == 1 + 3 and marks.pending().count() == 200


@pytest.mark.parametrize("most", [1 << 20, 0])  # masks are broadcast, or joined by a shuffle
def test_any_ids_and_rows_that_share_one(spark, made, tmp_path, monkeypatch, most):
    monkeypatch.setattr(stored, "MASKS", most)
    ids = [*range(-70, 70), 1 << 62, (1 << 63) - 1, -(1 << 63), (1 << 40) + 63, (1 << 40) + 64]
    rows = _rows(ids)
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    made.commit(df(_rows([*ids, 7777], seed=3) + [(None, "red red", "ring")]))
    marks = stored.DirtyMarks(spark, f"file://{tmp_path}/marks")
    marks.mark(spark.createDataFrame([(k,) for k in [*ids, 7777, None]], "doc_id bigint"))
    done = stored.incremental_build(made, marks, df([*rows, (None, "not marked", None), (8888, "not marked", None)]), f"file://{tmp_path}/drain")
    null = [r for r in done.postings().filter("doc_id IS NULL").collect()]
    assert sorted((r.field, r.term, r.tf) for r in null) == [("name", "red", 2), ("note", "ring", 1)]  # no mark reaches what has no id
    made.commit(df(rows), replace=True)
    _same(made.snapshot(), spark, rows)
    twice = made.commit(df([(5, "red stone red", "a"), (5, "red", None)]))
    assert sorted((r.field, r.term, r.tf, r.length) for r in twice.postings().filter("doc_id = 5").collect()) == [("name", "red", 3, 3), ("name", "stone", 1, 3), ("note", "a", 1, 1)]
    assert twice.manifest["live"] == len(ids)


def test_frequent_terms_are_dealt_to_all_tasks_of_their_bucket(spark, made, monkeypatch):
    monkeypatch.setattr(stored, "ROWS", 100)
    monkeypatch.setattr(stored, "LOOKED_AT", 50)
    rows = [(k, f"every w{k}", f"n{k}") for k in range(400)]
    snapshot = made.commit(spark.createDataFrame(rows, SCHEMA))
    _same(snapshot, spark, rows)
    files = lambda term: snapshot.postings([term]).select(_file()).distinct().count()
    assert files("every") > 1 and files("w7") == files("n9") == 1


def test_folders(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/x")
    assert folder.names() == [] and folder.files() == [] and folder.create("a", "é") and not folder.create("a", "other")
    assert folder.read("a") == "é" and folder.names() == ["a"] and folder.files()[0][1] == 2
    folder.delete("a")
    assert not folder.exists("a")
