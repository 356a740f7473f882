"""Queries over the stored index: commits and snapshots, merging, incremental builds, searches. Registered with catalog's."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import _ANALYZED, _HITS, _POSTINGS, _SPEC, _t, query
from millrace.plans import index, stored
from millrace.sources.storage import Folder, scratch, shared_dir


def _docs(s, d) -> DataFrame:
    return _t(s, d, "documents").select("doc_id", "text", "source")


def _known(name: str, s, d, table: str, rows: DataFrame, spec) -> stored.StoredIndex:
    """The index of a table, built at its first use in this shared folder and again whenever the table's files change."""
    files = repr(Folder(s, f"{d}/{table}.parquet").files())
    index = stored.StoredIndex(s, f"{shared_dir(s)}/index-{name}-{hashlib.sha256(files.encode()).hexdigest()[:16]}", spec)
    if not index.snapshot().segments:
        index.commit(rows, replace=True)
    return index


def documents_index(s, d) -> stored.StoredIndex:
    return _known("documents", s, d, "documents", _docs(s, d), _SPEC)


def _scores(postings: str, n: str, boost: str = "CASE field WHEN 'text' THEN 10.0 ELSE 9.0 END") -> str:
    """doc_id and score of 'Edst to a' over postings (doc_id, field, term, tf, length)."""
    return (
        f"(WITH p AS ({postings}), h AS (SELECT * FROM p WHERE term IN ('edst', 'to', 'a')), m AS (SELECT doc_id, field FROM h GROUP BY ALL HAVING count(*) FILTER (WHERE term IN ('edst', 'to')) = 2), "
        f"df AS (SELECT field, term, count(*) AS df FROM h GROUP BY ALL), s AS (SELECT h.doc_id, h.field, sum(sqrt(tf) * pow(1 + ln(({n}) / (df.df + 1)), 2) * {boost} / sqrt(length)) AS s, count(*) AS hit FROM h JOIN m USING (doc_id, field) JOIN df USING (field, term) GROUP BY ALL) "
        "SELECT doc_id, round(sum(CASE field WHEN 'text' THEN 100.0 ELSE 1.0 END * s * hit / 3), 4) AS score FROM s GROUP BY 1)"
    )


def _with_length(postings: str) -> str:
    """A document's length is that of its terms, repeats included."""
    return f"SELECT *, sum(tf) OVER (PARTITION BY doc_id, field) AS length FROM ({postings})"


_BEFORE = _scores(_with_length(_POSTINGS), "SELECT count(*) FROM documents")
_CHANGED = f"{_POSTINGS.replace('FROM documents', 'FROM (SELECT doc_id, text, source FROM documents WHERE doc_id % 3 = 1)')} UNION ALL SELECT doc_id, 'text', unnest(['edst', 'to']), 1 FROM documents WHERE doc_id % 3 = 2"
_AFTER = _scores(_with_length(_CHANGED), "SELECT count(*) FROM documents WHERE doc_id % 3 > 0")


@query(f"SELECT 'before' AS seen, * FROM {_BEFORE} UNION ALL SELECT 'written', * FROM {_BEFORE} UNION ALL SELECT 'published, not refreshed', * FROM {_BEFORE} UNION ALL SELECT 'refreshed', * FROM {_AFTER} UNION ALL SELECT 'held', * FROM {_BEFORE}")
def index_commit_refresh(s, d):
    """What a search sees around a commit that changes a third of all documents and deletes another third."""
    index = stored.StoredIndex(s, scratch(s, "index"), _SPEC)
    docs = _docs(s, d)
    index.commit(docs)
    searcher, seen = stored.Searcher(index), []

    def look(name: str, by) -> None:
        seen.append(by.search("Edst to a", _SPEC).select(F.lit(name).alias("seen"), "doc_id", F.round("score", 4).alias("score")))

    held = searcher.snapshot
    look("before", searcher.snapshot)
    changed = docs.filter("doc_id % 3 = 2").select("doc_id", F.lit("Edst to").alias("text"), F.lit(None).cast("string").alias("source"))
    pending = index.stage(changed, docs.filter("doc_id % 3 = 0").select("doc_id"))
    searcher.refresh()
    look("written", searcher.snapshot)
    pending.publish()
    look("published, not refreshed", searcher.snapshot)
    searcher.refresh()
    look("refreshed", searcher.snapshot)
    look("held", held)
    out = seen[0]
    for x in seen[1:]:
        out = out.unionByName(x)
    return out


@query(f"SELECT *, 7 AS segments_before, TRUE AS fewer FROM ({_POSTINGS})")
def index_merge(s, d):
    """The postings of an index that came about by seven commits, the last of which replaced a sixth of the documents, and
    was then merged by size tiers."""
    index = stored.StoredIndex(s, scratch(s, "index"), _SPEC)
    docs = _docs(s, d)
    for k in range(6):
        old = docs if k else docs.withColumn("text", F.concat(F.lit("stale "), "text"))
        index.commit(old.filter(F.col("doc_id") % 6 == k))
    index.commit(docs.filter("doc_id % 6 = 0"))
    before, merged = index.snapshot().segments, index.merge(4)
    return merged.postings().select("doc_id", "field", "term", "tf", F.lit(len(before)).alias("segments_before"), F.lit(len(merged.segments) < len(before)).alias("fewer"))


@query(f"SELECT *, 0 AS pending, (SELECT count(*) FROM documents) AS indexed FROM ({_POSTINGS})")
def incremental_build(s, d):
    """The postings after a drain: the index held an earlier text of every document with an even id, and documents that are
    gone; all of those were marked, some twice."""
    index, marks = stored.StoredIndex(s, scratch(s, "index"), _SPEC), stored.DirtyMarks(s, scratch(s, "marks"))
    docs = _docs(s, d)
    even = docs.filter("doc_id % 2 = 0")
    gone = even.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("gone").alias("text"), "source")
    index.commit(docs.filter("doc_id % 2 = 1 OR doc_id IS NULL").unionByName(even.withColumn("text", F.concat(F.lit("earlier "), "text"))).unionByName(gone))
    marks.mark(even.select("doc_id").unionByName(gone.select("doc_id")))
    marks.mark(even.select("doc_id"))
    after = stored.incremental_build(index, marks, docs, scratch(s, "drain"), files_per_trigger=3)
    return after.postings().select("doc_id", "field", "term", "tf", F.lit(marks.pending().count()).alias("pending"), F.lit(after.manifest["live"]).cast("bigint").alias("indexed"))


@query(
    f"{_HITS}, f AS (SELECT doc_id, 'text' AS field, len({_ANALYZED.format('text')}) AS length, 10.0::DOUBLE AS boost FROM documents UNION ALL SELECT doc_id, 'source', len({_ANALYZED.format('source')}), 9.0 FROM documents), "
    "df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), "
    "s AS (SELECT h.doc_id, h.field, sum(sqrt(tf) * pow(1 + ln(n.n / (df.df + 1)), 2) * boost / sqrt(length)) AS s, count(*) AS hit FROM h JOIN m USING (doc_id, field) JOIN df USING (field, term) JOIN f USING (doc_id, field), n GROUP BY ALL) "
    "SELECT doc_id, round(sum(CASE field WHEN 'text' THEN 100.0 ELSE 1.0 END * s * hit / 3), 4) AS score FROM s GROUP BY 1"
)
def ranked_search(s, d):
    return documents_index(s, d).snapshot().search("Edst to a", _SPEC).select("doc_id", F.round("score", 4).alias("score"))


_SHOWN = "<span class=''highlight''>"


@query(
    f"SELECT 'Promo' AS query, p_partkey AS doc_id, p_name, NULL::VARCHAR[] AS lines, ['{_SHOWN}PROMO</span>'] AS shown FROM (SELECT * FROM part WHERE p_type = 'PROMO' ORDER BY p_size DESC, p_partkey LIMIT 15 OFFSET 15) "
    f"UNION ALL SELECT 'red', p_partkey, '{_SHOWN}red</span>' || substr(p_name, 4), [p_type, p_brand], NULL FROM (SELECT * FROM part WHERE p_name LIKE 'red %' ORDER BY p_size, p_partkey DESC LIMIT 15)"
)
def search_page(s, d):
    part = _t(s, d, "part")
    spec = index.IndexSpec("p_partkey", {"p_name": 10.0, "p_type": 9.0})
    found = _known("parts", s, d, "part", part, spec).snapshot()
    sizes = part.select(F.col("p_partkey").alias("doc_id"), "p_size")
    entities = part.select(F.col("p_partkey").alias("doc_id"), "p_name", F.array("p_type", "p_brand").alias("lines"))
    pages = []
    for words, number in (("Promo", 2), ("red", 1_000_000)):
        page = index.search_page(found.search(words, spec), sizes, entities, [F.desc("p_size"), F.asc("doc_id")], number, 15)
        pages.append(index.rendered(page, "p_name", "lines", index.query_terms(words)).select(F.lit(words).alias("query"), "doc_id", "p_name", "lines", "shown"))
    return pages[0].unionByName(pages[1])
