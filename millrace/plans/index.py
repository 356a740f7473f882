"""Inverted index and ranked retrieval as plans over two tables.

postings(doc_id, field, term, tf) and fields(doc_id, field, length, boost). A field matches if it holds all required
terms (those longer than one ASCII letter or digit), or any term if none is required; score = field weight x
sum of sqrt(tf) x idf^2 x boost / sqrt(length), times the share of query terms matched, where idf = 1 + ln(N / (df + 1)).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import POST, PRE, analyzed, contains_keyword, highlight, query_terms
from millrace.operators.relational import clamped_page


@dataclass
class IndexSpec:
    """What of a table is indexed: text columns with their boosts, and words that block or demote a row."""

    key: str
    fields: dict[str, float]
    stop: Sequence[str] = ()
    blocked: Sequence[str] = ()
    demoted: Sequence[str] = ()
    demoted_boost: float = 0.1
    flag: str | None = None
    weights: dict[str, float] = field(default_factory=dict)


def documents(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """Rows to index: neither flagged nor with a blocked word in any field."""
    if spec.flag:
        df = df.filter(~F.coalesce(F.col(spec.flag), F.lit(False)))
    for name in spec.fields if spec.blocked else ():
        df = df.filter(~contains_keyword(F.col(name), spec.blocked))
    return df


def analysed(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """doc_id, field, terms, boost of the rows to index, a row a field."""
    rows = documents(df, spec)
    parts = None
    for name, boost in spec.fields.items():
        demoted = F.when(contains_keyword(F.col(name), spec.demoted), spec.demoted_boost).otherwise(boost) if spec.demoted else F.lit(float(boost))
        part = rows.select(F.col(spec.key).alias("doc_id"), F.lit(name).alias("field"), analyzed(F.col(name), spec.stop).alias("terms"), demoted.cast("double").alias("boost"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def build(df: DataFrame, spec: IndexSpec) -> tuple[DataFrame, DataFrame]:
    """(postings, fields). One pass a field; the only shuffle counts terms by document."""
    parts = analysed(df, spec)
    fields_ = parts.select("doc_id", "field", F.size("terms").alias("length"), "boost")
    postings = parts.select("doc_id", "field", F.explode("terms").alias("term")).groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"))
    return postings, fields_


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def required(terms: Sequence[str]) -> list[str]:
    return [t for t in terms if not (len(t) == 1 and t.isascii() and t.isalnum())]


def matches(postings: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Postings of the fields that match; a query's few terms are a pushed-down IN."""
    hits = postings.filter(F.col("term").isin(*terms))
    must = required(terms)
    whole = hits.groupBy("doc_id", "field").agg(F.count_if(F.col("term").isin(*must)).alias("n")) if must else hits.select("doc_id", "field").distinct()
    whole = whole.filter(F.col("n") == len(must)).drop("n") if must else whole
    return hits.join(whole, ["doc_id", "field"], "left_semi")


def search(postings: DataFrame, fields_: DataFrame, text: str, spec: IndexSpec) -> DataFrame:
    """doc_id, score of all matches. An empty text matches every document with score 1; one of blanks alone matches none."""
    terms = query_terms(text)
    if text == "":
        return fields_.select("doc_id").distinct().withColumn("score", F.lit(1.0))
    if not terms:
        return fields_.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    n = fields_.select("doc_id").distinct().agg(F.count("*").alias("n_docs"))
    counted = document_frequency(postings.filter(F.col("term").isin(*terms)))
    idf: Column = 1 + F.log(F.col("n_docs") / (F.col("df") + 1))
    weight = F.lit(1.0)
    for name, w in spec.weights.items():
        weight = F.when(F.col("field") == name, float(w)).otherwise(weight)
    scored = (
        matches(postings, terms).join(F.broadcast(counted), ["field", "term"]).join(F.broadcast(n)).join(fields_, ["doc_id", "field"])
        .groupBy("doc_id", "field").agg(F.sum(F.sqrt("tf") * idf * idf * F.col("boost") / F.sqrt("length")).alias("s"), F.count("*").alias("hit"))
    )
    return scored.groupBy("doc_id").agg(F.sum(weight * F.col("s") * F.col("hit") / len(terms)).alias("score"))


def search_page(hits: DataFrame, stored: DataFrame, entities: DataFrame, order: Sequence[Column], index: int, size: int) -> DataFrame:
    """A page of hits in the order of their score or of stored columns (the last rows, if it lies beyond the end), each
    with its entity; of one that is gone only doc_id and the stored columns are left. Of the entities only those of the
    page are joined, which is what is broadcast: `size` ids."""
    page = clamped_page(hits.join(stored, "doc_id"), order, index, size)
    wanted = entities.join(F.broadcast(page.select("doc_id")), "doc_id", "left_semi")
    return page.join(wanted, "doc_id", "left")


def rendered(page: DataFrame, name: str, lines: str, words: Sequence[str], most: int = 3) -> DataFrame:
    """page with the words marked: in the name, or else in the first `most` lines that hold one (column shown, in the
    order of `lines`, which then is null)."""
    keys = F.array(*map(F.lit, words))
    both = F.transform(F.col(lines), lambda x: F.struct(x.alias("plain"), highlight(x, keys).alias("marked")))
    each = page.withColumns({"__name": highlight(F.col(name), keys), "__lines": both})
    each = each.withColumn("__in_name", F.coalesce(F.length("__name") != F.length(name), F.lit(False)))
    hit = F.transform(F.filter("__lines", lambda x: F.length(x["marked"]) != F.length(x["plain"])), lambda x: x["marked"])
    by_line = ~F.col("__in_name") & (F.coalesce(F.size("__lines"), F.lit(0)) > 0)
    out = each.withColumns({"shown": F.when(by_line, F.slice(hit, 1, most)), lines: F.when(~by_line, F.col(lines)), name: F.when(F.col("__in_name"), F.col("__name")).otherwise(F.col(name))})
    return out.drop("__name", "__lines", "__in_name")


def best_fragment(df: DataFrame, key: str, text: str, words: Sequence[str], size: int = 20) -> DataFrame:
    """df with fragment: of a text's runs of `size` words that begin with one of `words` (whatever its case), the run with
    the most different of them, then the most of them, then the first; the words are marked in it. Null if there is none.

    The hits alone are dealt by key, which must be unique, so a window is over a document's hits, a frame over `size` words."""
    wanted = [w.lower() for w in words]
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    hits = df.select(F.col(key).alias("__key"), F.posexplode(F.transform(pieces, F.lower)).alias("__at", "__word")).filter(F.col("__word").isin(*wanted))
    # words and what lies between them alternate
    frame = Window.partitionBy("__key").orderBy("__at").rangeBetween(0, 2 * size - 2)
    rated = hits.select("__key", "__at", F.size(F.collect_set("__word").over(frame)).alias("__kinds"), F.count("*").over(frame).alias("__all"))
    best = rated.groupBy("__key").agg(F.max_by("__at", F.struct("__kinds", "__all", (-F.col("__at")).alias("first"))).alias("__at"))
    run = F.slice(pieces, F.col("__at") + 1, 2 * size - 1)
    marked = F.array_join(F.transform(run, lambda p: F.when(F.lower(p).isin(*wanted), F.concat(F.lit(PRE), p, F.lit(POST))).otherwise(p)), "")
    return df.join(best, df[key].eqNullSafe(F.col("__key")), "left").withColumn("fragment", F.when(F.col("__at").isNotNull(), marked)).drop("__key", "__at")


def update(postings: DataFrame, fields_: DataFrame, changed: DataFrame, spec: IndexSpec) -> tuple[DataFrame, DataFrame]:
    """The index with the changed rows built anew; rows that may no longer be indexed go."""
    new_postings, new_fields = build(changed, spec)
    ids = changed.select(F.col(spec.key).alias("doc_id")).distinct()
    return postings.join(ids, "doc_id", "left_anti").unionByName(new_postings), fields_.join(ids, "doc_id", "left_anti").unionByName(new_fields)


def delete(postings: DataFrame, fields_: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return postings.join(ids, "doc_id", "left_anti"), fields_.join(ids, "doc_id", "left_anti")
