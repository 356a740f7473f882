import random

import duckdb
import pytest

from millrace.llm.mixing import mix
from millrace.llm.mixing_sql import OP8_SQL

ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint, target string, source_size string, passes string, below string, skey string, hash string, at string, more string, budget string"
CLASHES = ("extra",) * 9


def _mixed(spark, rows):
    docs = spark.createDataFrame([(i, t, None, s, None, *CLASHES) for i, t, s in rows], ROWS)
    got = mix(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "passes", "below", "skey", "hash", "at", "more", "budget", "size", "source_size", "target", "copies"]
    assert all(r.passes == r.at == "extra" for r in got.collect())
    return [r.asDict() for r in got.collect()]


def _sql(rows):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    if rows:
        c.executemany("insert into documents values (?, ?, ?)", rows)
    return c.execute(OP8_SQL).fetchall()


def _random(n, seed=1):
    r = random.Random(seed)
    return [(i if r.random() > 0.02 else None, " ".join(["w"] * r.choice([0, 1, 5, 50, 400])) if r.random() > 0.03 else None, r.choice(["a", "a", "b", "é", "", "Z", None])) for i in range(n)]


@pytest.mark.parametrize("rows", [_random(400), _random(30, 2), [], [(1, None, None)], [(1, "a b c", "x")] * 9, [(1, "a b c", "x")] * 41 + [(2, "d e", "y")] * 30 + [(3, "f", "y"), (4, "", "z"), (4, "", "z")], [(7, "x " * 30000, "s"), (8, "y", "s"), (9, "z", "t")]])
def test_mix_equals_sql_and_meets_its_targets(spark, rows):
    got = _mixed(spark, rows)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["size"] * r["copies"]) for r in got), key=key) == sorted(_sql(rows), key=key)
    by = {}
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["text"] is not Ellipsis
        by.setdefault((r["source"], r["target"], r["source_size"]), []).append((r["size"], r["copies"], (r["doc_id"], r["text"])))
    total = sum(r["size"] for r in got)
    assert sum(t for _, t, _ in by) == pytest.approx(1.5 * total)
    for (_, target, size), members in by.items():
        assert target <= 2 * size
        assert abs(sum(n * c for n, c, _ in members) - target) <= max(n for n, _, _ in members) / 2 + 1e-6


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        mix(spark.createDataFrame([], ROWS), weights=(0, 1))


def test_many_sources_meet_their_plan_without_broadcast(spark, monkeypatch):
    from millrace.llm import mixing

    rows = _random(300, 3)
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["size"] * r["copies"]) for r in _mixed(spark, rows)), key=key) == sorted(_sql(rows), key=key)


def test_mixed_rows_keep_every_column(spark):
    from millrace.llm.mixing import mixed_rows

    docs = spark.createDataFrame([(i, t, None, s, None, *CLASHES) for i, t, s in _random(80, 4)], ROWS)
    got, want = mixed_rows(docs), mix(docs)
    assert got.schema == docs.schema and got.count() == sum(r.copies for r in want.collect())
