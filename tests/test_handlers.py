from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import trees
from millrace.streaming import handlers, pipelines


def _peer(a, b, c, d, port):
    return bytes([a, b, c, d]) + port.to_bytes(2, "big")


def test_found_prefers_public_peers_to_nodes(spark):
    node = lambda x, port: x * 20 + _peer(9, 9, 9, 9, port)
    rows = [
        (1, [_peer(8, 8, 8, 8, 1), _peer(8, 8, 8, 8, 1) + b"rest", _peer(10, 0, 0, 1, 2)], node(b"a", 5)),
        (2, [_peer(10, 0, 0, 1, 2)], node(b"b", 5) + node(b"c", 0) + b"cut"),
        (3, None, node(b"d", 7)), (4, [], None), (5, [None, b"x"], b""),
    ]
    peers, nodes = handlers.found(spark.createDataFrame(rows, "k int, values array<binary>, nodes binary"), "k")
    assert [(r.k, r.ip, r.port) for r in peers.collect()] == [(1, 0x08080808, 1)]
    assert sorted((r.k, bytes(r.node_id), r.port) for r in nodes.collect()) == [(2, b"b" * 20, 5), (3, b"d" * 20, 7)]


def test_replies(spark):
    nodes = [(bytes([k]) * 20, 256 + k, 1 + k) for k in range(10)] + [(b"short", 1, 1), (b"\xff" * 20, 1, 0), (None, 1, 1)]
    rows = [(1, "ping", b"s" * 20, None), (2, "find_node", b"s" * 20, b"\x09" * 20), (3, "get_peers", b"t" * 20, b"\x09" * 20), (4, "announce_peer", b"s" * 20, b"\x09" * 20), (5, "vote", b"s" * 20, None), (6, "get_peers", b"s" * 20, None), (7, None, None, None)]
    got = {r.request: r for r in handlers.replies(spark.createDataFrame(rows, "request int, command string, sender binary, target binary"), spark.createDataFrame(nodes, "node_id binary, ip bigint, port int"), F.lit(b"o" * 20)).collect()}
    near = sorted(range(10), key=lambda k: k ^ 9)[:8]
    packed = b"".join(bytes([k]) * 20 + (256 + k).to_bytes(4, "big") + (1 + k).to_bytes(2, "big") for k in near)
    assert sorted(got) == [1, 2, 3, 4, 6] and bytes(got[1].id) == b"s" * 10 + b"o" * 10
    assert [got[k].nodes and bytes(got[k].nodes) for k in (1, 2, 3, 4)] == [None, packed, packed, None] and bytes(got[6].nodes) == b""
    assert [got[k].token for k in (1, 2, 3, 4, 6)] == [None, None, "09", None, None]


def test_search_log_stream_equals_batch(spark, tmp_path):
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    rows = [("a", 1, "Firefox", at(1)), ("a", 1, None, at(5)), ("a", 2, None, at(9)), ("a", 1, "Googlebot/2", at(9)), (" ", 1, None, at(1)), (None, 1, None, at(1)), ("b", 1, "", at(2)), ("c", None, None, at(3))]
    log = spark.createDataFrame(rows, "word string, page int, agent string, ts timestamp")
    want = [("a", 2, at(5)), ("b", 1, at(2))]
    assert sorted(map(tuple, handlers.searched(log).collect())) == want
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = pipelines.read_stream(spark, str(tmp_path / "log"), log.schema, files_per_trigger=1)
    pipelines.run_once(handlers.searched(stream), str(tmp_path / "c"), mode="complete", name="search_log")
    assert sorted(map(tuple, spark.table("search_log").collect())) == want


def test_paths(spark):
    rows = [(1, "a/b/c", 4), (1, "a/b/c", 6), (1, "x", None), (1, None, 3), (2, "a//b", 1)]
    got = trees.from_paths(spark.createDataFrame(rows, "root int, name string, size bigint"), "root", "name", "size").collect()
    assert sorted((r.root, r.path or [], r.size) for r in got if r.root == 1) == [(1, [], 3), (1, ["a", "b", "c"], 6), (1, ["x"], None)]
    assert [(r.path, r.size) for r in got if r.root == 2] == [(["a", "", "b"], 1)]
