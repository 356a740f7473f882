"""What messages lead to: replies to requests, peers or nodes out of responses, and the log of searches. Each takes
streaming or plain DataFrames, but for replies(), which ranks nodes a target: give it each batch of a stream (foreachBatch)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import network, scalars
from millrace.operators import merge, relational


def valid_nodes(nodes: DataFrame, node: str = "node_id", port: str = "port") -> DataFrame:
    """Nodes with a port and an id of 20 bytes."""
    return nodes.filter((F.length(node) == 20) & (F.col(port) != 0))


def replies(requests: DataFrame, nodes: DataFrame, own: Column, n: int = 8) -> DataFrame:
    """request, id, nodes, token of the reply to each known command in requests (request, command, sender, target).

    The id is the sender's mixed with our own. find_node and get_peers get the n nodes (node_id, ip, port) nearest to
    their target as compact records, nearest first; get_peers also the first two hex digits of its target as a token."""
    asked = requests.filter(F.col("command").isin("ping", "find_node", "get_peers", "announce_peer"))
    targets = asked.filter(F.col("command").isin("find_node", "get_peers") & F.col("target").isNotNull()).select("target").distinct()
    near = relational.nearest_by_xor(targets, valid_nodes(nodes), target="target", node="node_id", n=n)
    record = F.struct("rank", F.hex(F.concat("node_id", network.to_compact(F.col("ip"), F.col("port")))).alias("hex"))
    packed = near.groupBy("target").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["hex"]), "")).alias("__nodes"))
    lists, hashed = F.col("command").isin("find_node", "get_peers"), F.col("command") == "get_peers"
    return asked.join(packed, "target", "left").select(
        "request", scalars.mixed_id(F.col("sender"), own).alias("id"), F.when(lists, F.coalesce("__nodes", F.unhex(F.lit("")))).alias("nodes"),
        F.when(hashed, F.substring(F.hex("target"), 1, 2)).alias("token"),
    )


def found(responses: DataFrame, *keys: str, values: str = "values", nodes: str = "nodes") -> tuple[DataFrame, DataFrame]:
    """(keys, ip, port of the public peers in the records of values; keys, node_id, ip, port of the valid nodes of those
    responses that name no public peer). Records that are cut off count for nothing."""
    each = F.transform(F.coalesce(F.col(values), F.array().cast("array<binary>")), lambda v: F.slice(network.compact_peers(v), 1, 1))
    public = F.array_distinct(F.filter(F.flatten(each), lambda p: F.coalesce(network.is_public(p["ip"]), F.lit(False))))
    read = responses.select(*keys, nodes, public.alias("__peers"))
    peers = read.select(*keys, F.explode("__peers").alias("__p")).select(*keys, "__p.ip", "__p.port")
    rest = read.filter(F.size("__peers") == 0).select(*keys, F.explode(network.compact_nodes(F.col(nodes))).alias("__n"))
    return peers, valid_nodes(rest.select(*keys, "__n.node_id", "__n.ip", "__n.port"))


def searched(requests: DataFrame, word: str = "word", page: str = "page", agent: str = "agent", time: str = "ts") -> DataFrame:
    """word, num, last_search_time of the searches that count: of first pages, not blank and not by crawlers. On a stream
    a state of one row a word; give each batch of changes to merge() with the rules of searches, or read it in whole."""
    real = requests.filter((F.col(page) == 1) & ~scalars.is_blank(F.col(word)) & ~scalars.is_crawler(F.col(agent)))
    return real.groupBy(word).agg(F.count("*").alias("num"), F.max(time).alias("last_search_time"))


def upserted(stream: DataFrame, table: merge.VersionedTable, keys: Sequence[str], rules: Mapping[str, str], checkpoint: str, order: str | None = None, seconds: int = 600) -> None:
    """Merges each micro-batch of a stream into a versioned table, as a log's consumer does. A batch that is tried again must
    change nothing more, so columns that add up are refused."""
    if "add" in rules.values():
        raise ValueError("a sum isn't safe to try again")

    def merged(batch: DataFrame, batch_id: int) -> None:
        columns = [*keys, *rules]
        old = table.read() if table.version() else batch.select(*columns).limit(0)
        table.commit(merge.merge(old, batch, keys, rules, order).select(*columns))

    query = stream.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream didn't end in {seconds} s")
