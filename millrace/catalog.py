"""The engine's operators as queries over the driver's tables, each with the same result in DuckDB SQL.

Stand-ins: orders are entities (o_orderkey the id, o_orderdate the time, o_orderstatus = 'F' the flag), lineitem with part
their file trees, events the observations and visits, documents and part names the searchable text."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import codecs, network, scalars, text
from millrace.operators import counters, merge, relational, trees
from millrace.plans import index
from millrace.sources import files
from millrace.streaming import handlers, pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entities(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("createtime"), F.col("o_totalprice").cast("bigint").alias("filesize"), (F.col("o_orderstatus") == "F").alias("isdanger"),
        scalars.sha1_hex(F.col("o_orderkey").cast("string")).alias("infohash"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("name"),
    )


ENTITIES = """(SELECT o_orderkey AS id, o_orderdate AS createtime, CAST(trunc(o_totalprice) AS BIGINT) AS filesize, o_orderstatus = 'F' AS isdanger,
 upper(sha1(CAST(o_orderkey AS VARCHAR))) AS infohash, o_custkey AS cust, o_orderpriority AS name FROM orders) e"""


# ---- listing, lookup, paging


@query(f"SELECT id, infohash, createtime, filesize, isdanger, (SELECT least(count(*), 15000) FROM {ENTITIES} WHERE createtime >= TIMESTAMP '1995-03-05' AND createtime <= TIMESTAMP '1995-03-06') AS total FROM {ENTITIES} WHERE createtime >= TIMESTAMP '1995-03-05' AND createtime <= TIMESTAMP '1995-03-06' ORDER BY createtime DESC, id LIMIT 15")
def list_by_date_page(s, d):
    rows = relational.day_window(_entities(s, d), "createtime", date(1995, 3, 5)).select("id", "infohash", "createtime", "filesize", "isdanger")
    return relational.page_with_total(rows, [F.desc("createtime"), F.asc("id")], 1)


@query(f"SELECT id, createtime, filesize, (SELECT least(count(*), 15000) FROM {ENTITIES}) AS total FROM {ENTITIES} ORDER BY createtime DESC, id LIMIT 15 OFFSET 30")
def list_latest_page(s, d):
    return relational.page_with_total(_entities(s, d).select("id", "createtime", "filesize"), [F.desc("createtime"), F.asc("id")], 3)


@query(f"SELECT count(*) AS n FROM {ENTITIES} WHERE createtime >= TIMESTAMP '1994-01-01' AND createtime <= TIMESTAMP '1996-01-01' AND NOT isdanger")
def list_filtered_count(s, d):
    return relational.listing_filter(_entities(s, d), start=datetime(1994, 1, 1), end=datetime(1996, 1, 1), flagged=False).agg(F.count("*").alias("n"))


@query(f"SELECT id, infohash FROM {ENTITIES} WHERE infohash = upper(sha1('7'))")
def lookup_by_hash(s, d):
    return relational.lookup(_entities(s, d).select("id", "infohash"), "infohash", "902BA3CDA1883801594B6E1B452790CC53948FDA")


@query(f"SELECT c_custkey AS cust, EXISTS (SELECT 1 FROM {ENTITIES} WHERE e.cust = c_custkey) AS found FROM customer")
def exists_by_key(s, d):
    return relational.exists_in(_entities(s, d), _t(s, d, "customer").select(F.col("c_custkey").alias("cust")), "cust")


@query(f"SELECT id, name FROM {ENTITIES} WHERE id IN (1, 5, 32, 33, 100, 999999999)")
def in_list_lookup(s, d):
    return _entities(s, d).filter(F.col("id").isin(1, 5, 32, 33, 100, 999999999)).select("id", "name")


@query(f"SELECT id, filesize FROM {ENTITIES} WHERE id > 500 ORDER BY id LIMIT 500")
def keyset_scan(s, d):
    return relational.keyset_page(_entities(s, d).select("id", "filesize"), "id", 500, 500)


@query(f"SELECT id, createtime FROM {ENTITIES} WHERE createtime > TIMESTAMP '1997-06-01'")
def high_watermark(s, d):
    return _entities(s, d).filter(F.col("createtime") > F.lit(datetime(1997, 6, 1))).select("id", "createtime")


@query("WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS n, count(*) OVER () AS c FROM events) SELECT event_id, value FROM r WHERE n > (SELECT CASE WHEN max(c) <= 99 * 40000 THEN greatest(0, max(c) - 40000) ELSE 99 * 40000 END FROM r) AND n <= (SELECT CASE WHEN max(c) <= 99 * 40000 THEN greatest(0, max(c) - 40000) ELSE 99 * 40000 END FROM r) + 40000")
def page_clamp(s, d):
    return relational.clamped_page(_t(s, d, "events").select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 100, 40000)


@query("WITH t AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1), p AS (SELECT *, greatest(1, CAST(ceil(total / 3.0) AS BIGINT)) AS pages FROM t) SELECT o_custkey, total, pages, range(greatest(1, 2 - 3)::BIGINT, greatest(greatest(1, 2 - 3), least(pages, greatest(1, 2 - 3) + 7))::BIGINT + 1) AS shown FROM p")
def pager_window(s, d):
    t = _t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total")).withColumn("pages", scalars.pages(F.col("total"), 3))
    return t.withColumn("shown", scalars.pager(F.lit(2).cast("bigint"), F.col("pages")))


@query("(SELECT 1 AS mode, p_partkey FROM part ORDER BY p_retailprice DESC, p_size DESC, p_partkey LIMIT 20) UNION ALL (SELECT 2, p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 20) UNION ALL (SELECT 3, p_partkey FROM part ORDER BY p_brand DESC, p_partkey LIMIT 20)")
def sort_modes(s, d):
    part = _t(s, d, "part")
    each = [part.orderBy(*relational.sort_mode(m, "p_retailprice", "p_size", "p_brand", "p_partkey")).limit(20).select(F.lit(m).alias("mode"), "p_partkey") for m in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def top_orders_per_customer(s, d):
    top = relational.top_per_group(_t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return top.select("o_custkey", "o_orderkey", "rank")


# ---- joins and sets

FILES = "(SELECT l_orderkey AS id, list_sort(list(p_name)) AS files FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) f"


@query(f"SELECT e.id, e.isdanger, CASE WHEN e.isdanger THEN f.files END AS files FROM {ENTITIES} LEFT JOIN {FILES} ON f.id = e.id")
def hydrate_files_left_join(s, d):
    files = _t(s, d, "lineitem").join(_t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("p_name")).alias("files"))
    return relational.hydrate(_entities(s, d).select("id", "isdanger"), files, "id", "isdanger")


@query(f"SELECT id, filesize FROM {ENTITIES} WHERE id IN (SELECT DISTINCT user_id FROM events)")
def dirty_set_join(s, d):
    return relational.dirty_join(_t(s, d, "events").select(F.col("user_id").alias("id")), _entities(s, d).select("id", "filesize"), "id")


@query("SELECT event_id, CASE WHEN event_id IN (SELECT o_orderkey FROM orders) THEN 'update' ELSE 'insert' END AS action FROM events")
def split_insert_update(s, d):
    old, new = relational.split_known(_t(s, d, "events").select(F.col("event_id").alias("id")), _entities(s, d).select("id"), "id")
    return old.withColumn("action", F.lit("update")).unionByName(new.withColumn("action", F.lit("insert"))).withColumnRenamed("id", "event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_downloaded(s, d):
    return _t(s, d, "customer").join(_t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join_flagged(s, d):
    flagged = _t(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(s, d, "customer").join(flagged, "c_custkey", "left_anti").select("c_custkey")


@query("WITH b AS (SELECT user_id, max(ts) + INTERVAL 1 DAY AS until FROM events WHERE event_type = 'error' GROUP BY 1) SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = e.user_id AND b.until > e.ts)")
def expiring_block_list(s, d):
    events = _t(s, d, "events")
    blocks = pipelines.blocked_until(events.filter("event_type = 'error'"), "user_id", "ts")
    return relational.not_blocked(events.filter("event_type = 'view'"), blocks, "user_id", "ts").select("event_id")


@query("SELECT s_suppkey AS id FROM supplier UNION SELECT c_custkey FROM customer")
def union_of_nodes(s, d):
    return relational.merge_distinct([_t(s, d, "supplier").select(F.col("s_suppkey").alias("id")), _t(s, d, "customer").select(F.col("c_custkey").alias("id"))], ["id"])


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_each_text(s, d):
    return relational.first_of_each(_t(s, d, "documents").select("doc_id", "text"), ["text"], [F.asc("doc_id")])


@query("SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 500")
def newest_bounded(s, d):
    return relational.newest(_t(s, d, "events").select("event_id", "ts"), "event_id", 500)


# ---- addresses

_IP = "((event_id * 2654435761) % 4294967296)"
_RANGES = " UNION ALL ".join(f"SELECT '{c}' AS cidr, {a}::BIGINT AS \"start\", {b}::BIGINT AS \"end\"" for c, (a, b) in ((c, network.range_of(c)) for c in network.RESERVED))


@query(f"WITH r AS ({_RANGES}) SELECT event_id, {_IP} AS ip FROM events WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_IP} BETWEEN r.\"start\" AND r.\"end\")")
def public_ip_filter(s, d):
    ip = F.pmod(F.col("event_id") * F.lit(2654435761).cast("bigint"), F.lit(4294967296).cast("bigint"))
    return _t(s, d, "events").select("event_id", ip.alias("ip")).filter(network.is_public(F.col("ip")))


@query(f"WITH r AS ({_RANGES}) SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_IP} BETWEEN r.\"start\" AND r.\"end\")")
def range_anti_join(s, d):
    cidr = s.createDataFrame([(c,) for c in network.RESERVED], "cidr string")
    a, b = network.cidr_bounds(F.col("cidr"))
    ip = F.pmod(F.col("event_id") * F.lit(2654435761).cast("bigint"), F.lit(4294967296).cast("bigint"))
    return relational.outside_ranges(_t(s, d, "events").select("event_id", ip.alias("ip")), cidr.select(a.alias("start"), b.alias("end")), "ip").select("event_id")


@query(_RANGES)
def cidr_ranges(s, d):
    a, b = network.cidr_bounds(F.col("cidr"))
    return s.createDataFrame([(c,) for c in network.RESERVED], "cidr string").select("cidr", a.alias("start"), b.alias("end"))


_QUAD = r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"


@query(f"WITH q AS (SELECT doc_id, regexp_extract(text, '{_QUAD}', 1) AS quad FROM documents) SELECT doc_id, quad, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(quad, '.'), lambda x: x::BIGINT)), lambda a, x: a * 256 + x) AS ip FROM q WHERE quad <> '' AND len(list_filter(string_split(quad, '.'), lambda x: x::INT > 255 OR (len(x) > 1 AND x[1] = '0'))) = 0")
def ip_numbers(s, d):
    q = _t(s, d, "documents").select("doc_id", F.regexp_extract("text", _QUAD, 1).alias("quad"))
    return q.select("doc_id", "quad", network.ip_number(F.col("quad")).alias("ip")).filter("ip IS NOT NULL")


_BYTES = "list_transform(range(1, 40, 2), lambda i: ('0x' || substr({0}, i, 2))::INT)"


@query(f"WITH x AS (SELECT s_suppkey, c_custkey, list_transform(list_zip({_BYTES.format('sha1(s_suppkey::VARCHAR)')}, {_BYTES.format('sha1(c_custkey::VARCHAR)')}), lambda p: xor(p[1], p[2])) AS distance FROM supplier, customer) SELECT s_suppkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, c_custkey)::INT AS rank FROM x) WHERE rank <= 8")
def xor_nearest_8(s, d):
    targets = _t(s, d, "supplier").select("s_suppkey", F.unhex(F.sha1(F.col("s_suppkey").cast("string"))).alias("target"))
    nodes = _t(s, d, "customer").select("c_custkey", F.unhex(F.sha1(F.col("c_custkey").cast("string"))).alias("node"))
    return relational.nearest_by_xor(targets, nodes, target="target", node="node").select("s_suppkey", "c_custkey", "rank")


@query("SELECT event_id, (user_id::BIGINT * 65536) + (event_id % 65536) AS endpoint FROM events")
def endpoint_keys(s, d):
    return _t(s, d, "events").select("event_id", network.endpoint_number(F.col("user_id"), F.col("event_id") % 65536).alias("endpoint"))


@query(f"SELECT event_id, {_IP} AS ip, (event_id % 65536)::INT AS port FROM events")
def compact_peers_roundtrip(s, d):
    ip = F.pmod(F.col("event_id") * F.lit(2654435761).cast("bigint"), F.lit(4294967296).cast("bigint"))
    packed = _t(s, d, "events").select("event_id", network.compact_peers(network.to_compact(ip, F.col("event_id") % 65536))[0].alias("p"))
    return packed.select("event_id", "p.ip", "p.port")


# ---- counters


@query("SELECT user_id, count(*) AS total FROM events GROUP BY 1")
def counter_sum(s, d):
    return counters.sum_by(_t(s, d, "events").select("user_id", F.lit(1).alias("n")), ["user_id"], "n")


_COUNTED = "SELECT props, count(*) AS total FROM events WHERE event_type = 'error' GROUP BY 1"


@query(f"SELECT * FROM ({_COUNTED}) WHERE total >= 2")
def counter_threshold(s, d):
    return counters.threshold(_t(s, d, "events").filter("event_type = 'error'").groupBy("props").agg(F.count("*").alias("total")))[0]


@query(f"SELECT * FROM ({_COUNTED}) WHERE total < 2")
def counter_residual(s, d):
    return counters.threshold(_t(s, d, "events").filter("event_type = 'error'").groupBy("props").agg(F.count("*").alias("total")))[1]


@query("SELECT user_id, props, count(*) AS total FROM events GROUP BY ALL HAVING count(*) < 2")
def counter_residual_pairs(s, d):
    return counters.threshold(_t(s, d, "events").groupBy("user_id", "props").agg(F.count("*").alias("total")))[1]


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counter(s, d):
    return counters.hourly(_t(s, d, "events"), "ts", "event_type")


@query("SELECT count(*) AS n FROM orders")
def total_count(s, d):
    return _t(s, d, "orders").agg(F.count("*").alias("n"))


@query("SELECT max(o_orderdate) AS latest FROM orders")
def latest_time(s, d):
    return _t(s, d, "orders").agg(F.max("o_orderdate").alias("latest"))


@query("SELECT n_regionkey, arg_min(left(n_name, 1), [n_nationkey]) AS type, list(n_name ORDER BY n_nationkey DESC) AS words FROM nation GROUP BY 1")
def home_word_groups(s, d):
    nation = _t(s, d, "nation").withColumn("kind", F.substring("n_name", 1, 1))
    return counters.grouped_words(nation, "n_regionkey", "kind", "n_name", "n_nationkey")


_WORDS = "list_filter(list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))), lambda w: length(w) > 1 AND length(w) < 15)"


@query(f"SELECT word, count(*) AS num FROM (SELECT unnest({_WORDS.format('p_name')}) AS word FROM part) GROUP BY 1")
def word_frequency(s, d):
    return counters.word_frequency(_t(s, d, "part").select(text.counted_words(F.col("p_name")).alias("words")), "words")


@query(f"SELECT doc_id, list_sort({_WORDS.format('text')}) AS words FROM documents")
def doc_keywords(s, d):
    return _t(s, d, "documents").select("doc_id", F.array_sort(text.counted_words(F.col("text"))).alias("words"))


@query("SELECT user_id, bool_or(event_type = 'error') AS isdanger FROM events GROUP BY 1")
def sticky_flag(s, d):
    return _t(s, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("isdanger"))


@query("SELECT user_id, json_extract(props, '$.k')::BIGINT AS target, max(ts) AS visit_time FROM events WHERE event_type = 'view' GROUP BY ALL")
def last_visit(s, d):
    views = _t(s, d, "events").filter("event_type = 'view'").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("target"), F.col("ts").alias("visit_time"))
    return merge.fold(views, ["user_id", "target"], merge.VISIT)


@query("SELECT event_type AS word, count(*) AS num, max(ts) AS last_search_time FROM events GROUP BY 1")
def search_history(s, d):
    rows = _t(s, d, "events").select(F.col("event_type").alias("word"), F.lit(1).cast("bigint").alias("num"), F.col("ts").alias("last_search_time"))
    empty = s.createDataFrame([], "word string, num bigint, last_search_time timestamp_ntz")
    return merge.merge(empty, rows, ["word"], merge.SEARCH)


@query("SELECT e.event_id, e.user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS might_contain FROM events e")
def bloom_membership(s, d):
    events = _t(s, d, "events")
    members = events.filter("event_type = 'purchase'").select("user_id").distinct()
    size = counters.bloom_size(members.count(), 1e-6)  # so seldom wrong that it equals the exact test here
    return counters.bloom_might_contain(events.select("event_id", "user_id"), "user_id", counters.bloom_filter(members, "user_id", *size), *size).select("event_id", "might_contain")


@query("SELECT o_orderkey, o_orderkey IN (SELECT user_id FROM events) AS might_contain FROM orders")
def bloom_of_orders(s, d):
    members = _t(s, d, "events").select(F.col("user_id").cast("bigint").alias("o_orderkey")).distinct()
    size = counters.bloom_size(members.count(), 1e-9)
    orders = _t(s, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
    return counters.bloom_might_contain(orders, "o_orderkey", counters.bloom_filter(members, "o_orderkey", *size), *size)


# ---- merges

_BATCH = "(SELECT user_id AS id, sum(1)::BIGINT AS n, bool_or(event_type = 'error') AS bad, arg_max(event_type, event_id) AS kind, arg_min(ts, event_id) AS first_ts FROM events GROUP BY 1) b"


@query(f"SELECT coalesce(e.id, b.id) AS id, coalesce(b.kind, e.name) AS name, CASE WHEN b.n IS NULL THEN e.cust ELSE coalesce(e.cust, 0) + b.n END AS downnum, CASE WHEN b.id IS NULL THEN e.isdanger ELSE coalesce(e.isdanger, false) OR coalesce(b.bad, false) END AS isdanger, coalesce(e.createtime, b.first_ts) AS createtime FROM {ENTITIES} FULL JOIN {_BATCH} ON e.id = b.id")
def upsert_patch(s, d):
    target = _entities(s, d).select("id", "name", F.col("cust").alias("downnum"), "isdanger", "createtime")
    batch = _t(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.lit(1).cast("bigint").alias("downnum"), (F.col("event_type") == "error").alias("isdanger"), F.col("ts").alias("createtime"), "event_id")
    rules = {k: merge.PATCH[k] for k in ("name", "downnum", "isdanger", "createtime")}
    return merge.merge(target, batch, ["id"], rules, "event_id")


@query(f"SELECT coalesce(e.id, b.id) AS id, CASE WHEN b.id IS NULL THEN e.name ELSE b.kind END AS name, CASE WHEN e.id IS NULL THEN 1 ELSE e.cust END::BIGINT AS downnum FROM {ENTITIES} FULL JOIN {_BATCH} ON e.id = b.id")
def upsert_ingest(s, d):
    target = _entities(s, d).select("id", "name", F.col("cust").alias("downnum"))
    batch = _t(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.lit(1).cast("bigint").alias("downnum"), "event_id")
    return merge.merge(target, batch, ["id"], {k: merge.INGEST[k] for k in ("name", "downnum")}, "event_id")


@query("WITH o AS (SELECT p_brand AS word, count(*) AS num, false AS isdanger FROM part WHERE p_size <= 25 GROUP BY 1), n AS (SELECT p_brand AS word, count(*) AS num, arg_max(p_size > 45, p_partkey) AS isdanger FROM part WHERE p_size > 25 GROUP BY 1) SELECT coalesce(o.word, n.word) AS word, coalesce(o.num, 0) + coalesce(n.num, 0) AS num, CASE WHEN n.word IS NULL THEN o.isdanger ELSE n.isdanger END AS isdanger FROM o FULL JOIN n ON o.word = n.word")
def upsert_keyword(s, d):
    part = _t(s, d, "part")
    old = part.filter("p_size <= 25").groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("num"), F.lit(False).alias("isdanger"))
    new = part.filter("p_size > 25").select(F.col("p_brand").alias("word"), F.lit(1).cast("bigint").alias("num"), (F.col("p_size") > 45).alias("isdanger"), "p_partkey")
    return merge.merge(old, new, ["word"], merge.KEYWORD, "p_partkey")


@query("SELECT s_suppkey AS infohash_id FROM supplier UNION SELECT user_id FROM events")
def insert_ignore(s, d):
    return merge.insert_ignore(_t(s, d, "supplier").select(F.col("s_suppkey").alias("infohash_id")), _t(s, d, "events").select(F.col("user_id").alias("infohash_id")), ["infohash_id"])


@query(f"SELECT e.id, e.cust + coalesce(b.n, 0) AS downnum FROM {ENTITIES} LEFT JOIN {_BATCH} ON e.id = b.id")
def additive_update(s, d):
    target = _entities(s, d).select("id", F.col("cust").alias("downnum"))
    return merge.add_and_mark(target, _t(s, d, "events").select(F.col("user_id").alias("id"), F.lit(1).alias("n")), "id", "downnum", "n")[0]


@query("SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT user_id FROM events)")
def additive_update_marks(s, d):
    target = _entities(s, d).select("id", F.col("cust").alias("downnum"))
    return merge.add_and_mark(target, _t(s, d, "events").select(F.col("user_id").alias("id"), F.lit(1).alias("n")), "id", "downnum", "n")[1].distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def delete_by_keys(s, d):
    return merge.delete_keys(_t(s, d, "customer").select("c_custkey", "c_name"), _t(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_orderkey AS id, CASE WHEN l.n IS NULL THEN [o_orderpriority] ELSE l.files END AS files FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, list_sort(list(DISTINCT l_linestatus)) AS files FROM lineitem WHERE l_quantity > 25 GROUP BY 1) l ON l_orderkey = o_orderkey")
def upsert_files(s, d):
    old = _t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority").alias("files"))
    new = _t(s, d, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_linestatus")).alias("files"))
    return merge.merge(old, new, ["id"], merge.FILES)


@query("SELECT e.event_type AS key, CASE WHEN b.n IS NULL THEN e.n ELSE b.n END AS num, CASE WHEN b.n IS NULL THEN e.t ELSE b.t END AS updatetime FROM (SELECT event_type, count(*) AS n, max(ts) AS t FROM events GROUP BY 1) e LEFT JOIN (SELECT event_type, count(*) AS n, min(ts) AS t FROM events WHERE event_type <> 'view' GROUP BY 1) b USING (event_type)")
def upsert_statistics(s, d):
    events = _t(s, d, "events")
    count = lambda df, t: df.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("num"), t("ts").alias("updatetime"))
    return merge.merge(count(events, F.max), count(events.filter("event_type <> 'view'"), F.min), ["key"], merge.STATISTICS)


# ---- scalars

_SIZE = "CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN {0} || 'KB' WHEN b < 1073741824 THEN {1} || 'MB' ELSE {2} || 'GB' END"
_PART = "(((b * 100 + {0} // 2) // {0}) // 100) || '.' || lpad((((b * 100 + {0} // 2) // {0}) % 100)::VARCHAR, 2, '0')"


@query("SELECT o_orderkey, " + _SIZE.format(*(_PART.format(u) for u in (1024, 1048576, 1073741824))) + " AS shown FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37 + o_orderkey)::BIGINT AS b FROM orders)")
def human_size(s, d):
    b = (F.col("o_orderkey") * F.col("o_orderkey") * 37 + F.col("o_orderkey")).cast("bigint")
    return _t(s, d, "orders").select("o_orderkey", scalars.human_size(b).alias("shown"))


@query("SELECT p_partkey, upper(hex(p_name)) AS hex, upper(md5(p_name)) AS md5, upper(sha1(p_name)) AS sha1 FROM part")
def hashes(s, d):
    name = F.col("p_name")
    return _t(s, d, "part").select("p_partkey", scalars.to_hex(name).alias("hex"), scalars.md5_hex(name).alias("md5"), scalars.sha1_hex(name).alias("sha1"))


@query("SELECT doc_id, regexp_full_match(coalesce(text, ''), '\\s*') AS blank, regexp_full_match(doc_id::VARCHAR, '[0-9]+') AS number FROM documents")
def is_blank_number(s, d):
    return _t(s, d, "documents").select("doc_id", scalars.is_blank(F.col("text")).alias("blank"), scalars.is_number(F.col("doc_id").cast("string")).alias("number"))


@query("SELECT c_custkey, 'magnet:?xt=urn:btih:' || upper(sha1(c_custkey::VARCHAR)) AS link, upper(sha1(c_custkey::VARCHAR)) AS infohash FROM customer")
def magnet_parse(s, d):
    link = scalars.magnet(scalars.sha1_hex(F.col("c_custkey").cast("string")))
    return _t(s, d, "customer").select("c_custkey", link.alias("link")).withColumn("infohash", scalars.infohash_of(F.col("link")))


@query("SELECT page_id, regexp_matches(lower(html), 'googlebot|bingbot|baiduspider|sogou web spider') AS spider FROM pages")
def ua_spider_filter(s, d):
    return _t(s, d, "pages").select("page_id", scalars.is_crawler(F.col("html")).alias("spider"))


@query("SELECT o_orderkey, regexp_full_match(sha1(o_orderkey::VARCHAR), '[A-Za-z0-9]{40}') AS hash, regexp_full_match(strftime(o_orderdate, '%Y-%m-%d'), '\\d{4}-\\d{2}-\\d{2}') AS date, regexp_full_match(o_orderpriority, 'time|hot') AS sort FROM orders")
def route_predicates(s, d):
    return _t(s, d, "orders").select(
        "o_orderkey", scalars.valid_route("hash", F.sha1(F.col("o_orderkey").cast("string"))).alias("hash"),
        scalars.valid_route("date", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), scalars.valid_route("sort", F.col("o_orderpriority")).alias("sort"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d-%H') AS hour, o_orderdate + INTERVAL 1 DAY AS next_day, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders")
def date_formats(s, d):
    t = F.col("o_orderdate")
    return _t(s, d, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM-dd-HH").alias("hour"), (t + F.expr("INTERVAL 1 DAY")).alias("next_day"), F.date_trunc("day", t).cast("timestamp_ntz").alias("day"))


@query("SELECT s_suppkey, rtrim(regexp_replace(upper(sha1(s_suppkey::VARCHAR)), '(..)', '\\1-', 'g'), '-') AS dashed, upper(substr(sha1(s_suppkey::VARCHAR), 9, 8)) AS part, ('0x' || substr(sha1(s_suppkey::VARCHAR), 9, 8))::BIGINT AS number, upper(substr(sha1(s_suppkey::VARCHAR), 9, 8)) AS packed, s_suppkey % 2 = 0 AS empty FROM supplier")
def byte_functions(s, d):
    raw = scalars.from_hex(F.sha1(F.col("s_suppkey").cast("string")))
    part = scalars.slice_bytes(raw, 4, 4)
    number = scalars.int_of_bytes(part)
    none = F.filter(F.array("s_suppkey"), lambda k: k % 2 == 1)
    return _t(s, d, "supplier").select("s_suppkey", scalars.dashed(raw).alias("dashed"), scalars.to_hex(part).alias("part"), number.alias("number"), scalars.to_hex(scalars.bytes_of_int(number)).alias("packed"), scalars.is_empty(none).alias("empty"))


# ---- text

_KEYS = ["the", "tha", "than", "erth", "on"]


def _greedy_sql(column: str, keys: list[str] = _KEYS) -> str:
    heads, inner = "".join(sorted({w[0] for w in keys})), "".join(sorted({c for w in keys for c in w[1:]}))
    words = ", ".join(f"'{w}'" for w in keys)
    return f"len(list_filter(range(1, length({column}) + 1), lambda i: regexp_extract(substr({column}, i), '^[{heads}][{inner}]*') IN ({words}))) > 0"


@query(f"SELECT p_partkey, {_greedy_sql('p_name')} AS hit FROM part")
def keyword_filter_greedy(s, d):
    return _t(s, d, "part").select("p_partkey", text.contains_keyword(F.col("p_name"), _KEYS).alias("hit"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '" + "|".join(_KEYS) + "'), false) AS hit FROM documents")
def keyword_filter_substring(s, d):
    return _t(s, d, "documents").select("doc_id", text.contains_keyword(F.col("text"), _KEYS, "substring").alias("hit"))


_STOP = ["the", "of", "and", "de", "la"]
_ANALYZED = "list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), lambda w: length(w) <= 15 AND w NOT IN ('the', 'of', 'and', 'de', 'la'))"


@query(f"SELECT doc_id, {_ANALYZED.format('text')} AS terms FROM documents")
def analyze_tokens(s, d):
    return _t(s, d, "documents").select("doc_id", text.analyzed(F.col("text"), _STOP).alias("terms"))


_SPAN_WORDS, _NAME_WORDS = "('the'), ('th'), ('on'), ('ion')", "('red'), ('re'), ('ed'), ('ring'), ('in'), ('dg')"
_SPANS = "WITH k(w) AS (VALUES ('the'), ('th'), ('on'), ('ion')), s AS (SELECT p_partkey, w, i - 1 AS a, i - 1 + length(w) AS b FROM (SELECT p_partkey, p_name, w, unnest(range(1, greatest(2, length(p_name) - length(w) + 2))) AS i FROM part, k) WHERE lower(substr(p_name, i, length(w))) = w)"


@query(f"{_SPANS} SELECT p_partkey, a::INT AS \"start\", b::INT AS \"end\", w AS word FROM s t WHERE NOT EXISTS (SELECT 1 FROM s u WHERE u.p_partkey = t.p_partkey AND NOT (u.a = t.a AND u.b = t.b) AND u.a <= t.a AND u.b >= t.b)")
def token_merge(s, d):
    words = F.array(*map(F.lit, ("the", "th", "on", "ion")))
    found = _t(s, d, "part").select("p_partkey", F.explode(text.maximal(text.positioned(F.col("p_name"), words))).alias("t"))
    return found.select("p_partkey", "t.start", "t.end", "t.word")


@query(f"{_SPANS.replace(_SPAN_WORDS, _NAME_WORDS)} SELECT p_partkey, a::INT AS \"start\", b::INT AS \"end\", w AS word FROM s t WHERE NOT EXISTS (SELECT 1 FROM s u WHERE u.p_partkey = t.p_partkey AND NOT (u.a = t.a AND u.b = t.b) AND u.a <= t.a AND u.b >= t.b)")
def token_merge_names(s, d):
    words = F.array(*map(F.lit, ("red", "re", "ed", "ring", "in", "dg")))
    found = _t(s, d, "part").select("p_partkey", F.explode(text.maximal(text.positioned(F.col("p_name"), words))).alias("t"))
    return found.select("p_partkey", "t.start", "t.end", "t.word")


@query("SELECT p_partkey, regexp_replace(p_name, '(?i)(part)', '<span class=''highlight''>\\1</span>', 'g') AS shown FROM part")
def highlight_names(s, d):
    return _t(s, d, "part").select("p_partkey", text.highlight(F.col("p_name"), F.array(F.lit("part"))).alias("shown"))


# ---- index

_SPEC = index.IndexSpec("doc_id", {"text": 10.0, "source": 9.0}, stop=_STOP, weights={"text": 100.0})
_POSTINGS = f"SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, 'text' AS field, unnest({_ANALYZED.format('text')}) AS term FROM documents UNION ALL SELECT doc_id, 'source', unnest({_ANALYZED.format('source')}) FROM documents) GROUP BY ALL"


def _index(s, d):
    return index.build(_t(s, d, "documents").select("doc_id", "text", "source"), _SPEC)


@query(_POSTINGS)
def postings(s, d):
    return _index(s, d)[0]


_BLOCKED, _DEMOTED = ["ring", "blue"], ["red", "on"]


@query(f"SELECT p_partkey AS doc_id, field, len(string_split(p, ' ')) AS length, CASE WHEN {_greedy_sql('p', _DEMOTED)} THEN 0.1 ELSE boost END::DOUBLE AS boost FROM (SELECT p_partkey, 'p_name' AS field, p_name AS p, 10.0 AS boost FROM part WHERE NOT {_greedy_sql('p_name', _BLOCKED)} AND NOT {_greedy_sql('p_type', _BLOCKED)} UNION ALL SELECT p_partkey, 'p_type', p_type, 9.0 FROM part WHERE NOT {_greedy_sql('p_name', _BLOCKED)} AND NOT {_greedy_sql('p_type', _BLOCKED)})")
def document_build(s, d):
    spec = index.IndexSpec("p_partkey", {"p_name": 10.0, "p_type": 9.0}, blocked=_BLOCKED, demoted=_DEMOTED)
    return index.build(_t(s, d, "part"), spec)[1]


@query(f"SELECT field, term, count(*) AS df FROM ({_POSTINGS}) GROUP BY ALL")
def doc_freq(s, d):
    return index.document_frequency(_index(s, d)[0])


_HITS = f"WITH p AS ({_POSTINGS}), h AS (SELECT * FROM p WHERE term IN ('edst', 'to', 'a')), m AS (SELECT doc_id, field FROM h GROUP BY ALL HAVING count(*) FILTER (WHERE term IN ('edst', 'to')) = 2)"


@query(f"{_HITS} SELECT DISTINCT doc_id, field FROM m")
def boolean_search(s, d):
    return index.matches(_index(s, d)[0], index.query_terms("Edst to a")).select("doc_id", "field").distinct()


@query(f"SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, 'text' AS field, unnest({_ANALYZED.format('text')}) AS term FROM documents UNION ALL SELECT doc_id, 'source', unnest({_ANALYZED.format('source')}) FROM documents) WHERE doc_id % 2 = 1 GROUP BY ALL UNION ALL SELECT doc_id, 'text', 'changed', 1 FROM documents WHERE doc_id % 2 = 0")
def incremental_index(s, d):
    docs = _t(s, d, "documents").select("doc_id", "text", "source")
    changed = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("Changed").alias("text"), F.lit(None).cast("string").alias("source"))
    return index.update(*_index(s, d), changed, _SPEC)[0]


# ---- trees

_LEAVES = "(SELECT l_orderkey AS root, [p_type, p_brand, p_name] AS path, CAST(trunc(l_quantity) AS BIGINT) AS size FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _leaves(s, d):
    return _t(s, d, "lineitem").join(_t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("root"), F.array("p_type", "p_brand", "p_name").alias("path"), F.col("l_quantity").cast("bigint").alias("size"))


@query(f"SELECT root, count(*) AS leaves, sum(size)::BIGINT AS size FROM {_LEAVES} GROUP BY 1")
def tree_leaf_count(s, d):
    return trees.leaf_totals(_leaves(s, d), "root", "size")


@query(f"SELECT root, node, count(*) AS leaves, sum(size)::BIGINT AS size, len(node)::INT AS depth FROM (SELECT root, unnest([path[1:1], path[1:2], path]) AS node, size FROM {_LEAVES}) GROUP BY root, node")
def tree_size_rollup(s, d):
    return trees.rollup(_leaves(s, d), "root", "path", "size")


@query(f"SELECT root, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT root, path[3] AS name FROM {_LEAVES}) GROUP BY 1")
def tree_bfs_names(s, d):
    return trees.leaf_names(_leaves(s, d), "root", "path", [F.element_at("path", -1)])


@query(f"SELECT root, node, ((len(node) - 1) * 30)::INT AS indent FROM (SELECT DISTINCT root, unnest([path[1:1], path[1:2], path]) AS node FROM {_LEAVES})")
def tree_depth_listing(s, d):
    return trees.listing(trees.rollup(_leaves(s, d), "root", "path", "size"), "root").select("root", "node", "indent")


@query("SELECT root, path, arg_max(size, size)::BIGINT AS size FROM (SELECT l_orderkey AS root, string_split(CASE WHEN l_linenumber % 3 = 0 THEN '_____padding_file_' || l_linenumber WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE l_linestatus || '/' || l_returnflag || '/' || l_linenumber END, '/') AS path, l_partkey AS size, l_linenumber FROM lineitem) WHERE path[-1] NOT LIKE '\\_\\_\\_\\_\\_padding\\_file%' ESCAPE '\\' GROUP BY ALL")
def paths_to_tree(s, d):
    name = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(trees.PADDING + "_"), "l_linenumber")).when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise(F.concat_ws("/", "l_linestatus", "l_returnflag", "l_linenumber"))
    leaves = trees.from_paths(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("root"), name.alias("name"), F.col("l_partkey").cast("bigint").alias("size")), "root", "name", "size")
    return leaves.filter(trees.not_padding(F.col("path")))


# ---- streams, as batches


@query("SELECT q.event_id, q.user_id, q.ts AS q_time, r.ts AS r_time FROM events q JOIN events r ON q.user_id = r.user_id AND q.event_type = 'view' AND r.event_type = 'purchase' AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 20 MINUTE")
def request_response_match(s, d):
    events = _t(s, d, "events")
    found = pipelines.matched(events.filter("event_type = 'view'").select("event_id", "user_id", "ts"), events.filter("event_type = 'purchase'").select("user_id", "ts"), ["user_id"], "ts")
    return found.select("event_id", "user_id", F.col("q_time").cast("timestamp_ntz").alias("q_time"), F.col("r_time").cast("timestamp_ntz").alias("r_time"))


@query("SELECT user_id AS node, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-01-30' - INTERVAL 15 MINUTE ORDER BY last_seen DESC, node LIMIT 2048")
def ttl_routing_table(s, d):
    return pipelines.routing_table(_t(s, d, "events").select(F.col("user_id").alias("node"), "ts"), datetime(2024, 1, 30))


@query("SELECT event_id, sum(1) OVER (PARTITION BY event_type, epoch(ts)::BIGINT // 3600 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 5 AS allowed FROM events")
def rate_limit_windows(s, d):
    events = _t(s, d, "events").withColumn("amount", F.lit(1))
    return pipelines.rate_limited(events, "ts", "amount", 5, 3600, "event_id", "event_type").select("event_id", "allowed")


@query(
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, 1 + event_id % 4 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "b AS (SELECT event_id, user_id, i, t + 86400000000 AS due, 5 - n AS rest, true AS allowed FROM e WHERE i = 1 "
    "UNION ALL SELECT event_id, user_id, i, CASE WHEN t >= due THEN t + 86400000000 ELSE due END, CASE WHEN n <= have THEN have - n ELSE have END, n <= have "
    "FROM (SELECT e.*, b.due, CASE WHEN e.t >= b.due THEN 5 ELSE b.rest END AS have FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)) SELECT event_id, allowed FROM b"
)
def token_bucket_limit(s, d):
    events = _t(s, d, "events").select("event_id", "user_id", "ts", (1 + F.col("event_id") % 4).alias("n"))
    return pipelines.token_bucket(events, "ts", "n", 5, 86_400, "event_id", "user_id").select("event_id", "allowed")


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS \"start\", max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM b GROUP BY user_id, g")
def event_sessions(s, d):
    found = pipelines.sessions(_t(s, d, "events"), "ts", "user_id")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'query:ping' WHEN 'click' THEN 'query:get_peers' WHEN 'purchase' THEN 'response' WHEN 'error' THEN 'error' ELSE 'unknown' END AS kind FROM events")
def command_routing(s, d):
    e = F.col("event_type")
    y = F.when(e.isin("view", "click", "signup"), "q").when(e == "purchase", "r").when(e == "error", "e")
    q = F.when(e == "view", "ping").when(e == "click", "get_peers").when(e == "signup", "vote")
    return _t(s, d, "events").select("event_id", scalars.command(y, q).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 6881 ELSE (event_id % 1000)::INT END AS port FROM events")
def announced_port(s, d):
    implied = F.when(F.col("event_id") % 3 == 1, 1).when(F.col("event_id") % 3 == 2, 0)
    return _t(s, d, "events").select("event_id", scalars.peer_port(implied, (F.col("event_id") % 1000).cast("int"), F.lit(6881)).alias("port"))


@query("SELECT c_custkey, upper(substr(sha1(c_custkey::VARCHAR), 1, 20) || substr(sha1(c_name), 21, 20)) AS id FROM customer")
def mixed_node_ids(s, d):
    return _t(s, d, "customer").select("c_custkey", F.hex(scalars.mixed_id(F.unhex(F.sha1(F.col("c_custkey").cast("string"))), F.unhex(F.sha1("c_name")))).alias("id"))


@query("SELECT p_partkey, lower(p_type) || ':' || p_size || '1' AS key FROM part")
def cache_keys(s, d):
    return _t(s, d, "part").select("p_partkey", scalars.cache_key(F.col("p_type"), F.col("p_size"), F.lit(1)).alias("key"))


@query("SELECT i AS id, upper(printf('%04x', i)) AS hex FROM range(65536) t(i) WHERE i NOT IN (0, 1, 2)")
def transaction_ids(s, d):
    return scalars.transaction_pool(s, [0, 1, 2])


_NEAR = f"list_transform(list_zip({_BYTES.format('sha1(s_suppkey::VARCHAR)')}, {_BYTES.format('sha1(c_custkey::VARCHAR)')}), lambda p: xor(p[1], p[2]))"


@query(
    f"WITH x AS (SELECT s_suppkey, c_custkey, {_NEAR} AS distance FROM supplier, customer WHERE s_suppkey % 5 IN (1, 2) AND c_custkey % 7 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance) AS rank FROM x), "
    "n AS (SELECT s_suppkey, string_agg(upper(sha1(c_custkey::VARCHAR)) || upper(printf('%08x%04x', c_custkey * 2654435761 % 4294967296, c_custkey % 7)), '' ORDER BY rank) AS nodes FROM r WHERE rank <= 8 GROUP BY 1) "
    "SELECT s_suppkey AS request, upper(substr(sha1(s_name), 1, 20) || substr(sha1('own'), 21, 20)) AS id, nodes, CASE WHEN s_suppkey % 5 = 2 THEN upper(substr(sha1(s_suppkey::VARCHAR), 1, 2)) END AS token FROM supplier LEFT JOIN n USING (s_suppkey) WHERE s_suppkey % 5 < 4"
)
def request_replies(s, d):
    key, commands = F.col("s_suppkey"), F.array(*map(F.lit, ("ping", "find_node", "get_peers", "announce_peer", "vote")))
    requests = _t(s, d, "supplier").select(key.alias("request"), commands[(key % 5).cast("int")].alias("command"), F.unhex(F.sha1("s_name")).alias("sender"), F.unhex(F.sha1(key.cast("string"))).alias("target"))
    node = F.col("c_custkey")
    nodes = _t(s, d, "customer").select(F.unhex(F.sha1(node.cast("string"))).alias("node_id"), F.pmod(node * F.lit(2654435761).cast("bigint"), F.lit(4294967296).cast("bigint")).alias("ip"), (node % 7).alias("port"))
    out = handlers.replies(requests, nodes, F.unhex(F.sha1(F.lit("own"))))
    return out.select("request", F.hex("id").alias("id"), F.hex("nodes").alias("nodes"), "token")


@query(
    f"WITH r AS ({_RANGES}), e AS (SELECT event_id, {_IP} AS a, {_IP.replace('event_id', 'user_id::BIGINT')} AS b, (event_id % 97)::INT AS port FROM events), v AS (SELECT event_id, a AS ip, port FROM e WHERE event_id % 3 < 2 UNION SELECT event_id, b, port FROM e WHERE event_id % 3 = 0), "
    "p AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE ip BETWEEN r.\"start\" AND r.\"end\")) SELECT event_id, NULL::VARCHAR AS node_id, ip, port FROM p "
    "UNION ALL SELECT event_id, upper(sha1(event_id::VARCHAR)), a, port FROM e WHERE event_id % 2 = 0 AND port <> 0 AND event_id NOT IN (SELECT event_id FROM p)"
)
def response_peers(s, d):
    at = lambda k: network.to_compact(F.pmod(F.col(k).cast("bigint") * F.lit(2654435761).cast("bigint"), F.lit(4294967296).cast("bigint")), F.col("event_id") % 97)
    key = F.col("event_id")
    values = F.when(key % 3 == 0, F.array(at("event_id"), at("user_id"))).when(key % 3 == 1, F.array(at("event_id")))
    nodes = F.when(key % 2 == 0, F.concat(F.unhex(F.sha1(key.cast("string"))), at("event_id")))
    peers, rest = handlers.found(_t(s, d, "events").select("event_id", values.alias("values"), nodes.alias("nodes")), "event_id")
    return peers.select("event_id", F.lit(None).cast("string").alias("node_id"), "ip", "port").unionByName(rest.withColumn("node_id", F.hex("node_id")))


@query("SELECT word, count(*) AS num, max(ts) AS last_search_time FROM (SELECT CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS word, event_id % 3 AS page, event_id % 7 = 0 AS bot, ts FROM events) WHERE page = 1 AND word <> ' ' AND NOT bot GROUP BY 1")
def search_log(s, d):
    key = F.col("event_id")
    word, agent = F.when(key % 5 == 0, " ").otherwise(F.col("event_type")), F.when(key % 7 == 0, "Mozilla/5.0 (compatible; Bingbot/2.0)")
    return handlers.searched(_t(s, d, "events").select(word.alias("word"), (key % 3).alias("page"), agent.alias("agent"), "ts"))


@query("SELECT '<?xml version=\"1.0\" encoding=\"utf-8\"?><urlset><url><loc>http://x/</loc><lastmod>' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') || '</lastmod></url></urlset>' AS xml FROM orders")
def sitemap(s, d):
    return files.sitemap(_t(s, d, "orders"), "http://x/", "o_orderdate")


@query("SELECT c_custkey, '{\"id\": ' || c_custkey || ', \"name\": \"' || c_name || '\"}' AS message FROM customer")
def bencode_roundtrip(s, d):
    packed = codecs.json_bencoded(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
    return _t(s, d, "customer").select("c_custkey", codecs.bencoded_json(packed).alias("message"))


@query("SELECT c_custkey, '{\"kind\": \"handshake\", \"reserved\": \"0000000000000000\", \"infohash\": \"' || upper(sha1(c_custkey::VARCHAR)) || '\", \"peer\": \"' || sha1(c_name) || '\"}' AS message FROM customer")
def wire_decode(s, d):
    data = F.concat(F.unhex(F.lit("13")), F.encode(F.lit("BitTorrent protocol"), "UTF-8"), F.unhex(F.lit("00" * 8)), F.unhex(F.sha1(F.col("c_custkey").cast("string"))), F.unhex(F.sha1("c_name")))
    return _t(s, d, "customer").select("c_custkey", codecs.wire_json(data).alias("message"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{\"kind\": \"extended_handshake\", \"metadata_size\": ' || p_size || ', \"ut_metadata\": 3}' WHEN 1 THEN '{\"kind\": \"request\", \"piece\": ' || p_size || '}' ELSE '{\"kind\": \"data\", \"piece\": ' || p_size || ', \"total_size\": ' || p_partkey || ', \"body\": \"' || lower(hex(p_name)) || '\"}' END AS message FROM part")
def wire_extended(s, d):
    size, kind = F.col("p_size"), F.col("p_partkey") % 3
    head = F.when(kind == 0, F.format_string("d1:md11:ut_metadatai3ee13:metadata_sizei%dee", size)).when(kind == 1, F.format_string("d8:msg_typei0e5:piecei%dee", size))
    head = head.otherwise(F.format_string("d8:msg_typei1e5:piecei%de10:total_sizei%dee", size, F.col("p_partkey")))
    body = F.encode(F.concat(head, F.when(kind == 2, F.col("p_name")).otherwise("")), "UTF-8")
    return _t(s, d, "part").select("p_partkey", codecs.wire_json(F.concat(F.unhex(F.when(kind == 0, "1400").otherwise("1403")), body)).alias("message"))


@query("SELECT DISTINCT upper(sha1(repeat(p_name, 2000))) AS infohash, length(p_name) * 2000 AS size FROM part")
def piece_reassembly(s, d):
    body = _t(s, d, "part").select(F.encode(F.repeat("p_name", 2000), "UTF-8").alias("body")).select("body", F.unhex(F.sha1("body")).alias("infohash"), F.length("body").alias("total"))
    pieces = body.select("infohash", "total", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.col("total") - 1) / 16384).cast("int")), lambda i: F.substring(F.col("body"), i * 16384 + 1, F.lit(16384)))).alias("piece", "data"))
    return codecs.reassembled(pieces).select(F.hex("infohash").alias("infohash"), F.length("body").cast("bigint").alias("size"))
