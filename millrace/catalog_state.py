"""Queries of keyed state, whose SQL goes through each key's rows one by one. Registered with catalog's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import _t, query
from millrace.operators import merge
from millrace.sources.storage import scratch
from millrace.streaming import handlers, pipelines, state


def _exchanges(s, d, shards: int, ids: int) -> DataFrame:
    """Requests and responses: views and clicks ask for a hash, the others answer an id."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type").isin("view", "click"), "request").otherwise("response")
    return _t(s, d, "events").select("event_id", "ts", (F.col("user_id") % shards).alias("shard"), kind.alias("kind"), (F.col("event_id") % 50).alias("hash"), (k % 3).alias("peer"), (F.col("event_id") % ids).cast("int").alias("id"))


def _exchanges_sql(shards: int, ids: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY shard ORDER BY t, event_id) AS i FROM (SELECT event_id, epoch_us(ts) AS t, user_id % {shards} AS shard, event_type IN ('view', 'click') AS asks, event_id % 50 AS hash, (props->>'$.k')::BIGINT % 3 AS peer, (event_id % {ids})::INT AS id FROM events))"


_KNOWN = "list_filter(reg, lambda r: CASE WHEN e.asks THEN r.hash = e.hash ELSE r.id = e.id END)[1]"


@query(
    f"WITH RECURSIVE e AS MATERIALIZED {_exchanges_sql(16, 6)}, "
    "s AS (SELECT shard, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::INT AS given_id, NULL::BIGINT AS given_hash, range(0, 6)::INT[] AS free, []::STRUCT(id INT, hash BIGINT, peers BIGINT[])[] AS reg FROM (SELECT DISTINCT shard FROM e) "
    "UNION ALL SELECT shard, i, event_id, "
    "CASE WHEN asks THEN CASE WHEN known IS NULL THEN pool[1] WHEN NOT there THEN known.id END END, CASE WHEN NOT asks AND there THEN known.hash END, "
    "CASE WHEN asks AND known IS NULL THEN pool[2:] WHEN NOT asks AND known IS NOT NULL AND len(rest) = 0 THEN list_append(free, known.id) ELSE free END, "
    "CASE WHEN known IS NULL THEN CASE WHEN asks THEN list_append(CASE WHEN len(free) = 0 THEN [] ELSE reg END, {'id': pool[1], 'hash': hash, 'peers': [peer]}) ELSE reg END "
    "WHEN asks AND there THEN reg WHEN asks THEN list_append(others, {'id': known.id, 'hash': known.hash, 'peers': list_append(known.peers, peer)}) "
    "WHEN len(rest) = 0 THEN others ELSE list_append(others, {'id': known.id, 'hash': known.hash, 'peers': rest}) END "
    "FROM (SELECT *, coalesce(list_contains(known.peers, peer), false) AS there, list_filter(known.peers, lambda p: p <> peer) AS rest, list_filter(reg, lambda r: r.id <> known.id) AS others, CASE WHEN len(free) = 0 THEN list_sort(list_transform(reg, lambda r: r.id)) ELSE free END AS pool "
    f"FROM (SELECT e.*, s.free, s.reg, {_KNOWN} AS known FROM s JOIN e ON e.shard = s.shard AND e.i = s.i + 1))) SELECT event_id, given_id, given_hash FROM s WHERE i > 0"
)
def shared_request_ids(s, d):
    return state.by_rule(_exchanges(s, d, 16, 6), state.SharedIds(6), key="shard", time="ts", order="event_id").select("event_id", "given_id", "given_hash")


def _aged_sql(forget: str) -> str:
    age = 240 * state.MINUTE
    start = "since" if forget == "all" else "NULL::BIGINT"
    live = "held" if forget == "all" else f"list_filter(held, lambda x: t - x.t0 < {age})"
    return (
        f"WITH RECURSIVE e AS MATERIALIZED {_exchanges_sql(8, 4)}, "
        "s AS (SELECT shard, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::INT AS given_id, NULL::BIGINT AS given_hash, -1 AS turn, NULL::BIGINT AS since, []::STRUCT(id INT, peer BIGINT, hash BIGINT, t0 BIGINT)[] AS held FROM (SELECT DISTINCT shard FROM e) "
        "UNION ALL SELECT shard, i, event_id, CASE WHEN asks AND found IS NULL THEN id END, CASE WHEN NOT asks THEN found.hash END, turn, since, "
        f"CASE WHEN asks AND found IS NULL THEN list_append(held, {{'id': id, 'peer': peer, 'hash': hash, 't0': t}}) WHEN {'asks' if forget == 'each' else 'true'} OR found IS NULL THEN held ELSE list_filter(held, lambda x: NOT (x.id = id AND x.peer = peer)) END "
        "FROM (SELECT *, list_filter(held, lambda x: x.id = id AND x.peer = peer)[1] AS found FROM (SELECT shard, i, event_id, asks, hash, peer, t, turn, since, CASE WHEN asks THEN turn ELSE own END AS id, "
        f"{live} AS held FROM (SELECT shard, i, event_id, asks, hash, peer, t, id AS own, CASE WHEN asks THEN (turn + 1) % 4 ELSE turn END AS turn, CASE WHEN over THEN t ELSE {start} END AS since, CASE WHEN over THEN [] ELSE held END AS held "
        f"FROM (SELECT e.*, s.turn, coalesce(s.since, e.t) AS since, s.held, {'coalesce(e.t - s.since >= ' + str(age) + ', false)' if forget == 'all' else 'false'} AS over FROM s JOIN e ON e.shard = s.shard AND e.i = s.i + 1))))) SELECT event_id, given_id, given_hash FROM s WHERE i > 0"
    )


@query(_aged_sql("each"))
def aged_request_ids(s, d):
    return state.by_rule(_exchanges(s, d, 8, 4), state.AgedRequests(4, 240, "each"), key="shard", time="ts", order="event_id").select("event_id", "given_id", "given_hash")


@query(_aged_sql("all"))
def cleared_request_ids(s, d):
    return state.by_rule(_exchanges(s, d, 8, 4), state.AgedRequests(4, 240, "all"), key="shard", time="ts", order="event_id").select("event_id", "given_id", "given_hash")


_LIFE = 2880 * state.MINUTE


@query(
    "WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, epoch_us(ts) AS t, event_type, user_id AS node, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), "
    "s AS (SELECT event_type, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, 0 AS held, []::STRUCT(node BIGINT, t0 BIGINT)[] AS nodes FROM (SELECT DISTINCT event_type FROM e) "
    "UNION ALL SELECT event_type, i, event_id, CASE WHEN len(nodes) >= 32 THEN 'refused' WHEN known THEN 'renewed' ELSE 'added' END, CASE WHEN len(nodes) >= 32 OR known THEN len(nodes) ELSE len(nodes) + 1 END::INT, "
    "CASE WHEN len(nodes) >= 32 THEN nodes ELSE list_append(list_filter(nodes, lambda n: n.node <> node), {'node': node, 't0': t}) END "
    "FROM (SELECT *, len(list_filter(nodes, lambda n: n.node = node)) > 0 AS known FROM (SELECT e.event_type, e.i, e.event_id, e.t, e.node, "
    f"CASE WHEN len(s.nodes) >= 32 THEN list_filter(s.nodes, lambda n: e.t - n.t0 <= {_LIFE}) ELSE s.nodes END AS nodes FROM s JOIN e ON e.event_type = s.event_type AND e.i = s.i + 1))) SELECT event_id, action, held FROM s WHERE i > 0"
)
def full_routing_table(s, d):
    sightings = _t(s, d, "events").select("event_id", "ts", "event_type", F.col("user_id").alias("node"))
    return state.by_rule(sightings, state.RoutingTable(32, 2880), key="event_type", time="ts", order="event_id").select("event_id", "action", "held")


_DUE = "ts + (props->>'$.k')::BIGINT * INTERVAL 10 MINUTE"


@query(f"SELECT event_id, user_id, {_DUE} AS due, row_number() OVER (PARTITION BY user_id ORDER BY {_DUE}, event_id) AS place FROM events")
def delayed_events(s, d):
    delay = F.get_json_object("props", "$.k").cast("bigint") * 600
    items = _t(s, d, "events").select("event_id", "user_id", "ts", delay.alias("delay"))
    return state.by_rule(items, state.DelayQueue("event_id"), key="user_id", time="ts", order="event_id").select("event_id", "user_id", "due", "place")


@query(
    "SELECT event_id, CASE WHEN coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'blocked' "
    "WHEN event_type = 'error' THEN 'malformed' ELSE 'ok' END AS verdict FROM events"
)
def malformed_senders(s, d):
    packets = _t(s, d, "events").select("event_id", "ts", "user_id", (F.col("event_type") == "error").alias("malformed"))
    return state.by_rule(packets, state.MalformedSenders(), key="user_id", time="ts", order="event_id").select("event_id", "verdict")


@query("SELECT user_id, max(ts) AS visit_time FROM events GROUP BY 1")
def visit_log(s, d):
    """The visits' table after a stream of events in six files."""
    landed, table = scratch(s, "visits"), merge.VersionedTable(s, scratch(s, "visited"))
    events = _t(s, d, "events").select("user_id", F.col("ts").alias("visit_time"))
    events.repartition(6).write.parquet(landed)
    handlers.upserted(pipelines.read_stream(s, landed, events.schema, 2), table, ["user_id"], merge.VISIT, scratch(s, "visit-stream"))
    return table.read()
