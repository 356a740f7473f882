import random

import numpy as np
import pytest

from millrace.llm import quality

DOCS, LABELS = "doc_id bigint, text string, grade string", "doc_id bigint, quality int, toxic int"


def _text(r, grade):
    words = ["".join(r.choices(["ka", "lo", "mi", "ta", "re"], k=r.randint(1, 4))) for _ in range(r.randint(20, 200))]
    if grade == 0:
        words[r.randrange(len(words))] = r.choice(["vilest", "rotter", "swine"])
        words.insert(3, "rotter")
    if grade == 1:
        words = [w + "$$$" for w in words] if r.random() < 0.5 else [w for w in words[:20] for _ in range(9)]
    return " ".join(words)


def test_held_out_accuracy(spark):
    r = random.Random(5)
    truth = [r.choice([0, 1, 2, 2, 2]) for _ in range(1500)]
    docs = spark.createDataFrame([(k, _text(r, g), "x") for k, g in enumerate(truth)], DOCS)
    labels = spark.createDataFrame([(k, int(g != 1), int(g == 0)) for k, g in enumerate(truth) if k % 2], LABELS)
    got = quality.rated(docs, labels).collect()
    assert len(got) == len(truth)
    held = [(row.keep, truth[row.doc_id], row.expected_grade) for row in got if row.doc_id % 2 == 0]
    assert np.mean([keep == (g == 2) for keep, g, _ in held]) > 0.97
    mean = [np.mean([e for _, g, e in held if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    again = {row.doc_id: row.p_above for row in quality.rated(docs.repartition(7), labels.repartition(3)).collect()}
    assert all(abs(again[row.doc_id] - row.p_above) < 1e-6 for row in got)


def test_thresholds_are_ordered_and_tails_fall():
    rows = [np.array([k % 7, 10 + k % 3]) for k in range(90)]
    model = quality.fit(rows, np.array([k % 7 % 4 for k in range(90)]), 4, 6)
    assert (np.diff(model.thresholds) >= 0).all()
    tails = model.tails(np.array([-1.0, 0.0, 2.0]))
    assert (np.diff(tails, axis=1) <= 0).all() and (np.diff(tails, axis=0) >= 0).all()


def test_grades(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, None, 0), (6, 1, None), (7, None, 1)]
    got = {x.doc_id: x.grade for x in quality.grades(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 0, 5: None, 6: None, 7: 0}


@pytest.mark.parametrize("labels", [[], [(None, 1, 0), (9, 1, 0)], [(1, 1, 0), (1, 0, 0), (2, None, None)]])
def test_odd_rows(spark, labels):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "word " * 50000, None), (2, "x", "c")], DOCS)
    got = quality.rated(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 4 and all(0 <= r.p_above <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert {r.grade for r in got} == {"a", "b", "c", None}
    assert quality.rated(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_rare_words_count_however_many_rows_there_are():
    r = np.random.default_rng(4)
    rows = [np.unique(r.integers(1, 200, 20)).astype(np.int32) for _ in range(4000)]
    grades = np.ones(4000, np.int64)
    grades[r.random(4000) < 0.2] = 0
    for k in range(12):  # under 0.5 % of the rows
        rows[300 * k] = np.append(rows[300 * k], 700).astype(np.int32)
        grades[300 * k] = 0
    model = quality.fit(rows, grades, 2, 10)
    assert model.weights[700] < -0.1
