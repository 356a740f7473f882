"""Queries of exports, surrogate ids, segmentation, fragments and gauges. Registered with catalog's."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import _t, query
from millrace.functions import segment, text
from millrace.operators import merge
from millrace.plans import index
from millrace.sources import records
from millrace.sources.storage import scratch
from millrace.streaming import gauges


@query("SELECT upper(sha1(k)) AS infohash, CASE WHEN k IN (SELECT c_custkey::VARCHAR FROM customer) THEN k::BIGINT ELSE (SELECT max(c_custkey) FROM customer) + row_number() OVER (PARTITION BY k IN (SELECT c_custkey::VARCHAR FROM customer) ORDER BY upper(sha1(k))) END AS id FROM (SELECT DISTINCT (user_id * 29 + event_id % 7 * 1000)::VARCHAR AS k FROM events)")
def insert_returning(s, d):
    key = lambda c: F.upper(F.sha1(c.cast("string"))).alias("infohash")
    target = _t(s, d, "customer").select(key(F.col("c_custkey")), F.col("c_custkey").alias("id"))
    batch = _t(s, d, "events").select(key(F.col("user_id") * 29 + F.col("event_id") % 7 * 1000), F.col("event_type").alias("name"))
    return merge.insert_returning(target, batch, ["infohash"])[1]


@query("SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, 1 AS times FROM orders")
def checkpointed_export(s, d):
    """What a stream reads of the records that three exports left, the first of which met only the older half of the orders."""
    orders = _t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"))
    folder, out, checkpoint = scratch(s, "records"), scratch(s, "exported"), scratch(s, "export-stream")
    middle = orders.agg(F.floor(F.max("id") / 2)).first()[0]
    for part in (orders.filter(F.col("id") <= middle), orders, orders):
        records.export_new(part, "id", folder)
        stream = s.readStream.format("record_file").option("path", folder).load()
        gauges.drain(stream, lambda b, k: b.write.mode("overwrite").parquet(f"{out}/{k:06d}"), checkpoint)
    read = s.read.schema("file string, seq bigint, value string").option("recursiveFileLookup", "true").parquet(out)
    return read.select(F.from_json("value", orders.schema).alias("r")).groupBy("r.id", "r.cust", "r.price").agg(F.count("*").cast("int").alias("times"))


_DICTIONARY = (
    "d AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1), t AS (SELECT sum(n) AS total FROM d), "
    "m AS MATERIALIZED (SELECT map(list(word ORDER BY word), list(floor(1e6 * ln(n / total))::BIGINT ORDER BY word)) AS w, max(length(word)) AS longest, floor(1e6 * ln(1 / total))::BIGINT AS unknown FROM d, t GROUP BY total), "
    "x AS MATERIALIZED (SELECT DISTINCT replace(lower(p_name), ' ', '') AS s FROM part)"
)


@query(
    f"WITH RECURSIVE {_DICTIONARY}, "
    "r AS (SELECT s, length(s) AS a, [0::BIGINT] AS score, [[]::VARCHAR[]] AS path FROM x UNION ALL "
    "SELECT s, a - 1, list_prepend(best.sc, score), list_prepend(list_prepend(substr(s, a, best.l), path[best.l]), path) FROM (SELECT r.*, list_sort(list_filter(list_transform(range(1, least(m.longest, length(s) - a + 1) + 1), "
    "lambda l: {'sc': coalesce(m.w[substr(s, a, l)], CASE WHEN l = 1 THEN m.unknown END) + score[l], 'l': l}), lambda c: c.sc IS NOT NULL), 'DESC')[1] AS best FROM r, m WHERE a > 0)), "
    "p AS (SELECT s, a, l, substr(s, a, l) AS word FROM (SELECT s, unnest(range(1, length(s) + 1)) AS a FROM x), (SELECT unnest(range(2, (SELECT longest FROM m) + 1)) AS l), m WHERE a + l - 1 <= length(s) AND m.w[substr(s, a, l)] IS NOT NULL), "
    "o AS (SELECT s, a, 1 AS l, substr(s, a, 1) AS word FROM (SELECT s, unnest(range(1, length(s) + 1)) AS a FROM x) q WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.s = q.s AND p.a <= q.a AND p.a + p.l > q.a)), "
    "f AS (SELECT s, list(word ORDER BY a, l) AS whole FROM (FROM p UNION ALL FROM o) GROUP BY s) "
    "SELECT p_partkey, r.path[1] AS accurate, f.whole AS \"full\" FROM part JOIN r ON r.s = replace(lower(p_name), ' ', '') AND r.a = 0 JOIN f ON f.s = r.s"
)
def segment_modes(s, d):
    """Part names without their spaces, by a dictionary of the words in all part names."""
    part = _t(s, d, "part")
    counted = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).filter("word <> ''").groupBy("word").count()
    known = segment.Dictionary(dict(map(tuple, counted.limit(segment.MAX_WORDS + 1).collect())))
    joined = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    return part.select("p_partkey", *(segment.segmented(joined, known, mode).alias(mode) for mode in ("accurate", "full")))


_KEYS = ["the", "la", "of", "que"]


@query(
    "WITH p AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS pieces FROM documents), "
    f"h AS (SELECT doc_id, place, lower(pieces[place]) AS word FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS place FROM p) WHERE lower(pieces[place]) IN {tuple(_KEYS)}), "
    "w AS (SELECT doc_id, place, count(DISTINCT word) OVER f AS kinds, count(*) OVER f AS hits FROM h WINDOW f AS (PARTITION BY doc_id ORDER BY place RANGE BETWEEN CURRENT ROW AND 38 FOLLOWING)), "
    "b AS (SELECT doc_id, place FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kinds DESC, hits DESC, place) = 1) "
    f"SELECT doc_id, CASE WHEN place IS NOT NULL THEN array_to_string(list_transform(pieces[place : place + 38], lambda x: CASE WHEN lower(x) IN {tuple(_KEYS)} THEN '{text.PRE.replace(chr(39), chr(39) * 2)}' || x || '{text.POST}' ELSE x END), '') END AS fragment FROM p LEFT JOIN b USING (doc_id)"
)
def best_fragment(s, d):
    return index.best_fragment(_t(s, d, "documents").select("doc_id", "text"), "doc_id", "text", _KEYS).select("doc_id", "fragment")


@query("SELECT 'errors' AS metric, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS total FROM events UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'rows', count(*) FROM events UNION ALL SELECT 'value', round(sum(value), 2) FROM events UNION ALL SELECT 'kept', count(*) FROM events")
def consumed_gauges(s, d):
    """Gauges of a stream that uses up its files, summed over its micro-batches, and the rows that it kept."""
    events = _t(s, d, "events")
    landed, out = scratch(s, "landed"), scratch(s, "kept")
    events.repartition(5).write.parquet(landed)
    seen = gauges.Gauges()
    stream = gauges.gauged(gauges.consumed(s, landed, events.schema, files_per_trigger=2), "queue", events=F.count("*"), errors=F.count_if(F.col("event_type") == "error"), value=F.sum("value"))
    gauges.drain(stream, lambda b, k: b.write.mode("overwrite").parquet(f"{out}/{k:06d}"), scratch(s, "consume"), seen)
    kept = s.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(out).agg(F.lit("kept").alias("metric"), F.count("*").cast("double").alias("total"))
    return gauges.totals(s, seen, "queue").unionByName(kept)
