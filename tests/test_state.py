import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.streaming import pipelines, state

START = datetime(2024, 1, 1)
SCHEMA = "n bigint, at timestamp, shard string, kind string, hash bigint, peer bigint, id int, node string, amount int, delay int, malformed boolean"


def _df(spark, rows):
    """Rows of (minute, fields), numbered in order."""
    made = [(k, START + timedelta(minutes=m), x.get("shard", "s"), x.get("kind", "request"), x.get("hash"), x.get("peer"), x.get("id"), x.get("node"), x.get("amount"), x.get("delay"), x.get("malformed")) for k, (m, x) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def _run(df, rule, *columns):
    found = state.by_rule(df, rule, key="shard", time="at", order="n").select("n", *columns).collect()
    return [tuple(r)[1:] for r in sorted(found, key=lambda r: r.n)]


def ask(hash, peer):
    return {"hash": hash, "peer": peer}


def answer(id, peer):
    return {"kind": "response", "id": id, "peer": peer}


def test_shared_ids(spark):
    rows = [ask(7, 1), ask(7, 2), ask(7, 1), ask(8, 1), answer(0, 2), answer(0, 2), answer(0, 1), ask(9, 1), ask(5, 1), answer(1, 3), answer(4, 1)]
    got = _run(_df(spark, list(enumerate(rows))), state.SharedIds(2), "given_id", "given_hash")
    # 0 is shared by two peers, the third row asks again; 0 is free after its last answer; the pool is dry at hash 5, so all are
    assert got == [(0, None), (0, None), (None, None), (1, None), (None, 7), (None, None), (None, 7), (0, None), (0, None), (None, None), (None, None)]


@pytest.mark.parametrize(("forget", "want"), [("each", [(0, None), (1, None), (None, 5), (None, None), (0, None), (1, None), (None, None)]), ("all", [(0, None), (1, None), (None, 5), (None, 5), (0, None), (1, None), (None, None)])])
def test_aged_requests_end_at_thirty_minutes(spark, forget, want):
    rows = [(0, ask(5, 1)), (1, ask(6, 2)), (29, answer(0, 1)), (29, answer(0, 1)), (30, ask(7, 1)), (31, ask(8, 2)), (62, answer(1, 2))]
    assert _run(_df(spark, rows), state.AgedRequests(2, 30, forget), "given_id", "given_hash") == want


def test_an_id_and_peer_that_are_registered_are_refused(spark):
    rows = [(0, ask(5, 1)), (1, ask(6, 1)), (2, ask(7, 1)), (31, ask(8, 1))]
    assert [x for x, _ in _run(_df(spark, rows), state.AgedRequests(1, 30), "given_id", "given_hash")] == [0, None, None, 0]
    with pytest.raises(ValueError):
        state.AgedRequests(1, 30, "some")


def test_a_full_table_refuses_known_nodes_too_until_some_are_old(spark):
    seen = lambda m, x: (m, {"node": x})
    rows = [seen(0, "a"), seen(1, "b"), seen(2, "a"), seen(3, "c"), seen(15, "d"), seen(16, "d"), seen(17, "c")]
    assert _run(_df(spark, rows), state.RoutingTable(2, 15), "action", "held") == [("added", 1), ("added", 2), ("refused", 2), ("refused", 2), ("refused", 2), ("added", 2), ("added", 2)]


def test_delay_queue_gives_out_in_order_of_due_times(spark):
    late = lambda m, d: (m, {"delay": d})
    got = _run(_df(spark, [late(0, 600), late(1, 60), late(2, 0), late(3, None), late(9, 60)]), state.DelayQueue("n"), "due", "place")
    assert got == [(START + timedelta(minutes=10), 4), (START + timedelta(minutes=2), 1), (START + timedelta(minutes=2), 2), (START + timedelta(minutes=3), 3), (START + timedelta(minutes=10), 5)]


def test_bucket_rule_equals_the_batch_operator(spark):
    df = _df(spark, [(k * 7 % 50, {"amount": k % 4, "shard": "xy"[k % 2]}) for k in range(60)])
    plain = {r.n: r.allowed for r in pipelines.token_bucket(df.select("n", "at", "amount", "shard"), "at", "amount", 4, 600, "n", "shard").collect()}
    assert _run(df, state.TokenBucket(4, 600), "allowed") == [(plain[k],) for k in range(60)]


RULES = {"shared": state.SharedIds(3), "each": state.AgedRequests(3, 30), "all": state.AgedRequests(3, 30, "all"), "table": state.RoutingTable(3, 20), "bucket": state.TokenBucket(4, 600), "delay": state.DelayQueue("n"), "malformed": state.MalformedSenders()}


@pytest.mark.parametrize("name", RULES)
def test_a_stream_gives_what_a_table_gives_over_a_restart(spark, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(3 * k, {"shard": "xyz"[k % 3], "kind": ("request", "request", "response")[k * k % 7 % 3], "hash": k % 5, "peer": k % 2, "id": k % 3, "node": f"n{k % 6}", "amount": k % 4, "delay": 600 * (k % 3), "malformed": k % 11 == 10}) for k in range(90)]
    df = _df(spark, [*rows, (10_000, {"shard": "end"})])  # the last row takes event time past all others

    def drain(since, until):
        df.filter((F.col("n") >= since) & (F.col("n") < until)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = pipelines.read_stream(spark, f"{tmp_path}/in", df.schema)
        out = state.by_rule(stream, RULES[name], key="shard", time="at", order="n")
        pipelines.run_once(out, f"{tmp_path}/checkpoint", batch=lambda b, k: b.write.mode("append").parquet(f"{tmp_path}/out"))
        time.sleep(0.1)

    for k in (0, 40):
        drain(k, k + 40)
    drain(80, 91)
    plain = state.by_rule(df, RULES[name], key="shard", time="at", order="n").filter("shard <> 'end'").collect()
    got = spark.read.parquet(f"{tmp_path}/out").filter("shard <> 'end'").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, plain)) and len(got) == 90


def test_sums_are_no_upsert_of_a_stream(spark, tmp_path):
    from millrace.streaming import handlers

    with pytest.raises(ValueError):
        handlers.upserted(spark.range(3), None, ["id"], {"n": "add"}, str(tmp_path))
