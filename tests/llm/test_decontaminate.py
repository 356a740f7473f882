import random
import re

import numpy as np
import pytest

from millrace.llm import decontaminate as dc

DOCS, ITEMS = "doc_id bigint, text string, digest string, item_id string", "item_id bigint, text string, doc_id int"
R = random.Random(4)
VOCABULARY = ["".join(R.choices(["ka", "lo", "mi", "ta", "re", "sun", "ber"], k=R.randint(1, 4))) for _ in range(3000)] + ["the", "of", "and", "to"] * 300


def _prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


ITEM = [_prose(n).capitalize() + ". " + _prose(n // 2) + "." for n in [12] * 10 + [25] * 10 + [200, 3]]


def _paraphrase(text, share):
    return " ".join(w if R.random() > share else R.choice(VOCABULARY) for w in text.split())


def _world():
    docs, leaks = [], set()
    for k in range(250):
        text = _prose(R.choice([5, 60, 300, 900]))
        if k % 5 == 0:
            item = ITEM[k // 5 % 20]
            text = text + "\n" + (item if k % 2 else _paraphrase(item, 0.2).upper()) + " " + _prose(R.randint(0, 50))
            leaks.add(k)
        docs.append((k, text))
    docs += [(300, _prose(70) + " " + ITEM[20] + _prose(80)), (301, docs[5][1]), (301, docs[5][1]), (None, docs[5][1]), (302, None), (303, ""), (304, "word " * 40000)]
    return docs, leaks | {300, 301, None}


def test_leaks_are_found_and_clean_texts_are_not(spark):
    rows, leaks = _world()
    docs = spark.createDataFrame([(*x, "extra", "extra") for x in rows], DOCS)
    items = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(ITEM)), (50, None, 1), (None, "x", 1), (51, "", 1)], ITEMS)
    got = dc.leaked(docs, items).collect()
    assert {r.doc_id for r in got} == leaks
    assert sum(r.doc_id == 301 for r in got) == 2 and all(r.cosine >= 0.25 and r.overlap >= 0.4 for r in got)
    assert all(r.item_id == r.doc_id // 5 % 20 for r in got if r.doc_id is not None and r.doc_id < 250)
    kept = dc.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in leaks)


@pytest.mark.parametrize("rows, items", [([], [(1, _prose(20), 1)]), ([(1, _prose(50))], []), ([(1, _prose(50)), (2, None)], [(1, None, 1), (2, "two words", 1)])])
def test_nothing_to_find(spark, rows, items):
    docs = spark.createDataFrame([(*x, "e", "e") for x in rows], DOCS)
    table = spark.createDataFrame(items, ITEMS)
    assert dc.leaked(docs, table).count() == 0 and dc.without_leaks(docs, table).count() == len(rows)


def test_a_benchmark_beyond_its_bound_is_refused(spark):
    with pytest.raises(ValueError):
        dc.leaked(spark.createDataFrame([(1, "a", "", "")], DOCS), spark.createDataFrame([(1, "x" * 99, 1)], ITEMS), max_benchmark_bytes=50)


def _known(texts, items, spark, **options):
    """Documents, the benchmark ready for a search, and its latent space."""
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = dc._summed(docs.mapInArrow(dc._frequencies, "part int, body binary"), (1 << dc.SLOT_BITS) + 1)
    known = dc.make_benchmark(dc.benchmark_passages(list(enumerate(items))), dc.inverse_frequencies(counts), counts[:-1] > dc.COMMON * counts[-1])
    return docs, known, dc.latent_basis(docs, known, **options)


def _cosines(text, known, basis):
    """Of all passages of text with all benchmark passages."""
    wanted = known.matrix @ basis
    _, z = dc.windows(*dc.slots_of([text]), known.place, known.idf).times(basis * known.weight[:, None])
    return z @ (wanted / np.linalg.norm(wanted, axis=1)[:, None]).T


def _replaced(text, share, r):
    """Some words replaced by others of the corpus; the last quarter (the answer) stays."""
    words = text.split()
    return " ".join(w if k >= len(words) * 3 // 4 - 1 or r.random() > share else r.choice(VOCABULARY) for k, w in enumerate(words))


def test_recall_on_paraphrases_against_exact_search(spark):
    r = random.Random(9)
    items = [_prose(r.randint(14, 50)) for _ in range(150)]
    texts = [_prose(r.choice([0, 40, 200])) + " " + _replaced(items[k % 150], r.choice([0.2, 0.35, 0.5]), r) + " " + _prose(r.choice([0, 30, 90])) for k in range(450)] + [_prose(300) for _ in range(200)]
    docs, known, basis = _known(texts, items, spark)
    assert basis.shape[1] == dc.RANK < len(items)
    found = []
    for space, least in ((basis, 0.25), (np.eye(len(basis), dtype=np.float32), 0.25)):
        shared = spark.sparkContext.broadcast((known, space))
        found.append({(bytes(x.digest), x.item_id) for x in docs.mapInArrow(dc._search(shared, least, 0.5, 0.4, 5), dc.FOUND).collect()})
    print(f"recall {len(found[0] & found[1]) / len(found[1]):.3f} of {len(found[1])}")
    assert len(found[1]) > 250 and len(found[0] & found[1]) >= 0.9 * len(found[1])


def test_passages_in_other_words_of_the_same_matter_are_nearest(spark):
    """They share no word with the item, so their TF-IDF cosine is 0: only the latent space ranks it before all others."""
    r = random.Random(6)
    matters = [["".join(r.choices(["ka", "lo", "mi", "ta", "re", "sun"], k=5)) for _ in range(30)] for _ in range(24)]
    halves = [(m[:15], m[15:]) for m in matters]
    items = [" ".join(r.sample(h, 12)) for h in (h for pair in halves for h in pair)]
    texts = [" ".join(r.choices(r.choice(matters), k=32)) for _ in range(600)]
    _, known, basis = _known(texts, items, spark, rank=24)
    plain = np.eye(len(basis), dtype=np.float32)
    nearest = []
    for k, (_, other) in enumerate(halves):
        text = " ".join(r.choices(other, k=32))
        assert _cosines(text, known, plain)[:, 2 * k].max() == 0
        latent = _cosines(text, known, basis).max(0)
        nearest.append(latent[2 * k] > np.delete(latent, [2 * k, 2 * k + 1]).max())
    assert np.mean(nearest) >= 0.6


def test_short_items_are_found_by_equality(spark):
    rows = [(1, "so\nYes, it is.\nand more"), (2, "yes it was"), (3, "it is yes"), (4, "yes it IS"), (5, None), (6, "well yes it is")]
    docs = spark.createDataFrame([(*x, "e", "e") for x in rows], DOCS)
    got = dc.leaked(docs, spark.createDataFrame([(7, "Yes, it is!", 1)], ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (4, 7)}


def test_long_texts_are_searched_in_parts():
    text = "word " * 500_000 + ITEM[12] + " " + "other words " * 300_000
    slots, sizes = dc.slots_of([text])
    assert sizes.tolist() == [len(slots)] == [500_000 + len(ITEM[12].split()) + 600_000]
    place = np.full(1 << dc.SLOT_BITS, -1, np.int64)
    place[dc.slots_of([ITEM[12]])[0]] = 0
    w = dc.windows(slots, sizes, place, np.ones(1 << dc.SLOT_BITS))
    assert len(w.text) == -(-(len(slots) - 32) // 16) + 1 and w.begin[-1] + 32 >= len(slots)


def test_frequencies_equal_brute_force():
    import pyarrow as pa

    texts = ["", _prose(1), _prose(16), _prose(17), _prose(33), "the " * 50, _prose(200), _prose(48)]
    got = np.concatenate([np.frombuffer(x) for b in dc._frequencies(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for x in b.column("body").to_pylist()])
    want, n = np.zeros(1 << dc.SLOT_BITS), 0
    for slots in (dc.slots_of([t])[0] for t in texts):
        for start in range(0, max(1, len(slots) - 16) if len(slots) else 0, 16):
            want[np.unique(slots[start : start + 32])] += 1
            n += 1
    assert got[-1] == n and (got[:-1] == want).all()


def test_common_subsequence():
    used = dc.common_weight([1, 2, 3, 4], [9, 2, 1, 3, 9, 4], np.array([1.0, 5, 1, 1]))
    assert used.tolist() == [False, True, True, True]


def test_verbatim_items_are_found_however_many_there_are(spark):
    """500 stretches of 40 words cut out of the documents; which documents hold one is asked of the words themselves."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.text}
    plain = {i: re.sub(r"[.,;:!?\"'()\[\]{}<>|*\-_$%&#«»“”„…‘’]", "", t.lower()).split() for i, t in text.items()}
    rng, items = random.Random(1), []
    long = [i for i in text if len(plain[i]) >= 60]
    for k in range(500):
        words = plain[rng.choice(long)]
        at = rng.randrange(len(words) - 40)
        items.append((k, " ".join(words[at : at + 40])))
    held = {i: f" {' '.join(w)} " for i, w in plain.items()}
    want = {i for _, item in items for i, h in held.items() if f" {item} " in h}
    got = {r.doc_id for r in dc.leaked(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(want) > 300 and len(want & got) >= 0.98 * len(want) and len(got - want) < 0.15 * len(want)


def test_sums_of_named_rows_by_key():
    r = np.random.default_rng(8)
    rows = r.standard_normal((50, 7))
    for n in (0, 1, 16, 17, 3000):
        key, at = np.sort(r.choice([1, 2, 5, 9, *range(20, 60)], n, p=np.concatenate([[0.5, 0.1], np.full(42, 0.4 / 42)]))), r.integers(0, 50, n)
        want = np.zeros((60, 7))
        np.add.at(want, key, rows[at])
        keys, sums = dc._sums_of(key, rows, at)
        assert keys.tolist() == np.unique(key).tolist() and np.allclose(sums, want[keys])
