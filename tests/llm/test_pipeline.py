import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from millrace.llm import mixing, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
R = random.Random(2)


def _prose(n):
    return " ".join("".join(R.choices(["ka", "lo", "mi", "ta", "re", "sun"], k=R.randint(1, 4))) for _ in range(n))


def _world(folder, spark):
    docs, labels, bad, copies, leaks = [], [], set(), {}, set()
    items = [_prose(30) for _ in range(6)]
    for k in range(400):
        text = _prose(R.randint(40, 200))
        if k % 5 == 0:
            text = text + " rotter " + _prose(5) + " swine"
            bad.add(k)
        elif k % 11 == 0:
            text = text + " " + items[k % 6] + " " + _prose(20)
            leaks.add(k)
        elif k % 7 == 0 and k:
            text = next(t for i, t in enumerate(d[1] for d in docs) if i % 5 and i % 11 and i % 7)
            copies[k] = text
        docs.append((k, text, "en", R.choice(["a", "b", None]), len(text)))
        labels.append((k, 1, int(k % 5 == 0)))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bad, copies, leaks


def test_every_stage_takes_effect(spark, tmp_path):
    folder = str(tmp_path)
    docs, bad, copies, leaks = _world(folder, spark)
    read = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [read]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], folder).cache())
        assert kept[-1].columns == read.columns
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in kept]
    text = {d[0]: d[1] for d in docs}
    assert len(bad & set(ids[1])) <= 0.05 * len(bad) and len(set(text) - bad - set(ids[1])) <= 4
    assert len({text[i] for i in ids[2]}) == len(ids[2]) == len({text[i] for i in ids[1]})
    assert set(ids[3]) == set(ids[2]) - leaks
    mixed = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect() if r.copies}
    assert dict(ids[4]) == mixed
    out = corpus_pipeline.run(spark, folder).collect()
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    assert Counter(r.doc_id for r in out) == ids[4]
    for r in sorted(out, key=lambda r: r.start):
        own = [*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_one_of_each_keeps_rows_whole(spark):
    rows = [(5, "a b c d", "en", "s", 1), (3, "a b c d", "de", None, 2), (3, "a b c d", "de", None, 2), (None, "a b c d", "x", "y", 3), (None, "other words here", "x", "y", 4), (None, None, None, None, None)]
    got = simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([rows[1], rows[4], rows[5]], key=repr)


def test_columns_of_any_name_nulls_repeats_and_empty_tables_go_through(spark, tmp_path):
    folder = str(tmp_path)
    docs, _, _, _ = _world(folder + "/plain", spark)
    names = ["keep", "p_above", "expected_grade", "__digest", "__tid", "digest", "row", "tid", "fp", "copies", "size"]
    rows = [(*d, *(f"{n} {d[0]}" for n in names)) for d in [*docs[:150], docs[3], docs[3], (None, None, None, None, None), (999, "", "en", "b", 0)]]
    schema = DOCS + "".join(f", {n} string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/plain/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    have = {repr(r) for r in rows}
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder).cache()
        assert kept.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        assert {repr(tuple(r)) for r in kept.collect()} <= have and kept.count()
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in kept.collect())
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/plain/{t}.parquet").write.parquet(f"{folder}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
