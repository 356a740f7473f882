"""Rules that a key's rows obey one after another, with state: registries of requests, a routing table, a token bucket, a
block-list of malformed senders, a delay queue.

A rule says what one row does to its key's state. by_rule() applies it to a plain DataFrame (each key's rows in order of time
pass through one task, which holds the state and an Arrow batch) or to a stream (transformWithState: the state is a row an
entry in the state store, so a row reads and writes only the entries it needs, and recovery is the checkpoint's). On a stream
the rows of a micro-batch are put in order, and earlier micro-batches come first; where a source gives rows in order of time,
the two results are the same. Keys are the caller's shards: a registry, table or queue each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

MINUTE = 60_000_000
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class Rule:
    """output: DDL of the columns that a rule adds. wakes: whether it acts as event time passes (due())."""

    output = ""
    wakes = False

    def step(self, state: Entries, row: dict, now: int) -> tuple | None:
        """The added columns of a row at time now (microseconds), or None to keep the row back."""
        raise NotImplementedError

    def due(self, state: Entries, now: int) -> Iterator[tuple[dict, tuple]]:
        """(row kept back, its added columns) of what time now releases; also the place to drop entries that are too old."""
        return iter(())

    def wake_at(self, state: Entries) -> int | None:
        """The time at which due() has something to do."""
        return None


class Entries:
    """A key's state: named tables of entries. In memory here; Stored keeps them in the state store."""

    def __init__(self):
        self._held: dict[tuple[str, Any], Any] = {}

    def get(self, table: str, key: Any = None, default: Any = None) -> Any:
        return self._held.get((table, key), default)

    def put(self, table: str, key: Any, value: Any) -> None:
        self._held[table, key] = value

    def drop(self, table: str, key: Any) -> None:
        self._held.pop((table, key), None)

    def items(self, table: str) -> list[tuple[Any, Any]]:
        """Sorted by key."""
        return sorted(((k, v) for (t, k), v in self._held.items() if t == table), key=lambda x: x[0])


class Stored(Entries):
    """Entries in a map state of (table, key) to a pickled value."""

    def __init__(self, table):
        self._table = table

    @staticmethod
    def _key(table: str, key: Any) -> tuple[str]:
        return (f"{table}\0{key!r}",)

    def get(self, table: str, key: Any = None, default: Any = None) -> Any:
        found = self._table.getValue(self._key(table, key))
        return default if found is None else pickle.loads(bytes.fromhex(found[0]))[1]

    def put(self, table: str, key: Any, value: Any) -> None:
        self._table.updateValue(self._key(table, key), (pickle.dumps((key, value)).hex(),))

    def drop(self, table: str, key: Any) -> None:
        self._table.removeKey(self._key(table, key))

    def items(self, table: str) -> list[tuple[Any, Any]]:
        return sorted((pickle.loads(bytes.fromhex(v[0])) for k, v in self._table.iterator() if k[0].startswith(f"{table}\0")), key=lambda x: x[0])


class SharedIds(Rule):
    """A registry in which the requests for one hash share an id of a small pool. Columns kind ('request' or 'response'), hash,
    peer, id. A request for a hash that has an id adds its peer to it, or is refused (given null) if the peer is there
    already; another takes the id that has been free longest. With no id free all registered ones become free, in order. A
    response (id, peer) is given the hash if the peer asked for it; the id becomes free when its last peer has answered."""

    output = "given_id int, given_hash bigint"

    def __init__(self, pool: int):
        self.pool = pool

    def step(self, state: Entries, row: dict, now: int) -> tuple:
        if row["kind"] == "request":
            return self._ask(state, row["hash"], row["peer"]), None
        known = state.get("id", row["id"])
        if known is None:
            return None, None
        peers = state.get("hash", known)[1]
        asked = row["peer"] in peers
        peers = peers - {row["peer"]}
        if peers:
            state.put("hash", known, (row["id"], peers))
        else:
            state.drop("hash", known)
            state.drop("id", row["id"])
            self._free(state, [row["id"]])
        return None, known if asked else None

    def _queue(self, state: Entries) -> tuple[int, int]:
        """Tickets first to last of the free ids; the first `pool` tickets are the ids themselves."""
        return state.get("queue", None, (0, self.pool))

    def _free(self, state: Entries, ids: list[int]) -> None:
        first, last = self._queue(state)
        for k, x in enumerate(ids):
            state.put("free", last + k, x)
        state.put("queue", None, (first, last + len(ids)))

    def _ask(self, state: Entries, wanted: int, peer: int) -> int | None:
        known = state.get("hash", wanted)
        if known is not None:
            if peer in known[1]:
                return None
            state.put("hash", wanted, (known[0], known[1] | {peer}))
            return known[0]
        first, last = self._queue(state)
        if first == last:
            taken = state.items("id")
            for x, h in taken:
                state.drop("id", x)
                state.drop("hash", h)
            self._free(state, [x for x, _ in taken])
            first, last = self._queue(state)
        given = first if first < self.pool else state.get("free", first)
        state.drop("free", first)
        state.put("queue", None, (first + 1, last))
        state.put("id", given, wanted)
        state.put("hash", wanted, (given, frozenset([peer])))
        return given


class AgedRequests(Rule):
    """A registry of (id, peer) with an age limit. Columns as for SharedIds. A request takes the next id in turn; it is refused
    (given null) if that id and peer are registered. each: an entry ends at its age, and a response that is given its hash
    removes it. all: everything is forgotten once the age has passed since the last time, and responses leave entries."""

    output = "given_id int, given_hash bigint"
    wakes = True

    def __init__(self, ids: int, minutes: int = 30, forget: str = "each"):
        if forget not in ("each", "all"):
            raise ValueError(forget)
        self.ids, self.age, self.forget = ids, minutes * MINUTE, forget

    def step(self, state: Entries, row: dict, now: int) -> tuple:
        if self.forget == "all" and now - state.get("since", None, now) >= self.age:
            self._clear(state, now)
        if self.forget == "all" and state.get("since") is None:
            state.put("since", None, now)
        if row["kind"] == "request":
            given = (state.get("turn", None, -1) + 1) % self.ids
            state.put("turn", None, given)
            if self._live(state, (given, row["peer"]), now) is not None:
                return None, None
            state.put("entry", (given, row["peer"]), (row["hash"], now))
            return given, None
        found = self._live(state, (row["id"], row["peer"]), now)
        if found is not None and self.forget == "each":
            state.drop("entry", (row["id"], row["peer"]))
        return None, found

    def _live(self, state: Entries, key: tuple, now: int) -> int | None:
        entry = state.get("entry", key)
        return entry[0] if entry and (self.forget == "all" or now - entry[1] < self.age) else None

    def _clear(self, state: Entries, now: int) -> None:
        for key, _ in state.items("entry"):
            state.drop("entry", key)
        state.put("since", None, now)

    def due(self, state: Entries, now: int) -> Iterator[tuple[dict, tuple]]:
        if self.forget == "each":  # these count as gone anyway
            for key, (_, at) in state.items("entry"):
                if now - at >= self.age:
                    state.drop("entry", key)
        return iter(())

    def wake_at(self, state: Entries) -> int | None:
        return min((at + self.age for _, (_, at) in state.items("entry")), default=None) if self.forget == "each" else None


class RoutingTable(Rule):
    """A table of at most `capacity` nodes. Column node. A full table first drops nodes that weren't seen for longer than the
    given minutes; if it is still full, the sighting is refused, that of a known node too."""

    output = "action string, held int"

    def __init__(self, capacity: int = 2048, minutes: int = 15):
        self.capacity, self.life = capacity, minutes * MINUTE

    def step(self, state: Entries, row: dict, now: int) -> tuple:
        held, oldest = state.get("size", None, (0, None))
        if held >= self.capacity and now - oldest > self.life:
            seen = state.items("node")
            for node, at in seen:
                if now - at > self.life:
                    state.drop("node", node)
                    held -= 1
            oldest = min((at for _, at in seen if now - at <= self.life), default=None)
        if held >= self.capacity:
            state.put("size", None, (held, oldest))
            return "refused", held
        known = state.get("node", row["node"]) is not None
        state.put("node", row["node"], now)
        held += not known
        # renewing the oldest leaves its old time here: too early a look costs time, not the result
        state.put("size", None, (held, now if oldest is None else min(oldest, now)))
        return "renewed" if known else "added", held


class TokenBucket(Rule):
    """Column amount: the bucket is filled to `capacity` by the first row `seconds` or more after it was last filled, and
    refuses what it can't meet, which then takes nothing."""

    output = "allowed boolean"

    def __init__(self, capacity: int, seconds: int):
        self.capacity, self.interval = capacity, seconds * 1_000_000

    def step(self, state: Entries, row: dict, now: int) -> tuple:
        left, due = state.get("bucket", None, (0, None))
        if due is None or now >= due:
            left, due = self.capacity, now + self.interval
        amount = row["amount"] or 0
        allowed = amount <= left
        state.put("bucket", None, (left - amount * allowed, due))
        return (allowed,)


class MalformedSenders(Rule):
    """Column malformed: from a key's first malformed row on, all its rows are blocked for good. verdict: ok, malformed, blocked."""

    output = "verdict string"

    def step(self, state: Entries, row: dict, now: int) -> tuple:
        if state.get("bad"):
            return ("blocked",)
        if row["malformed"]:
            state.put("bad", None, True)
        return ("malformed" if row["malformed"] else "ok",)


class DelayQueue(Rule):
    """Column delay (seconds): keeps a row back for that long, then gives it out: in order of the times at which rows are due,
    those of one time in order of the given columns, with its number in its key."""

    output = "due timestamp, place bigint"
    wakes = True

    def __init__(self, order: str):
        self.order = order

    def step(self, state: Entries, row: dict, now: int) -> None:
        state.put("item", (now + int((row["delay"] or 0) * 1_000_000), row[self.order]), row)

    def due(self, state: Entries, now: int) -> Iterator[tuple[dict, tuple]]:
        for key, row in state.items("item"):
            if key[0] > now:
                break
            place = state.get("place", None, 0) + 1
            state.put("place", None, place)
            state.drop("item", key)
            yield row, (EPOCH + timedelta(microseconds=key[0]), place)

    def wake_at(self, state: Entries) -> int | None:
        return min((key[0] for key, _ in state.items("item")), default=None)


class _Processor(StatefulProcessor):
    def __init__(self, rule: Rule, names: Sequence[str], added: Sequence[str], order: str):
        self.rule, self.names, self.added, self.order = rule, names, added, order

    def init(self, handle) -> None:
        self.handle = handle
        text = lambda name: StructType([StructField(name, StringType())])
        self.table = handle.getMapState("entries", text("k"), text("v"))

    def _out(self, row: dict, columns: tuple) -> Row:
        return Row(**{n: row[n] for n in self.names}, **dict(zip(self.added, columns, strict=True)))

    def _sleep(self, state: Entries) -> None:
        at = self.rule.wake_at(state) if self.rule.wakes else None
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = Stored(self.table)
        for row in sorted((r.asDict() for r in rows), key=lambda r: (r["__now"], r[self.order])):
            columns = self.rule.step(state, row, row["__now"])
            if columns is not None:
                yield self._out(row, columns)
        self._sleep(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = Stored(self.table)
        for row, columns in self.rule.due(state, timerValues.getCurrentWatermarkInMs() * 1000):
            yield self._out(row, columns)
        self._sleep(state)

    def close(self) -> None:
        pass


def by_rule(rows: DataFrame, rule: Rule, *, key: str, time: str, order: str, late: str = "0 seconds") -> DataFrame:
    """rows with the rule's columns. order: a column that decides between rows of one time, without nulls. Rows without a time
    or key take no part. Of a plain DataFrame a delay queue gives out everything, of a stream what event time has reached."""
    names, added, kinds = rows.columns, *zip(*(f.split() for f in rule.output.split(",")), strict=True)
    schema = rows.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in zip(added, kinds, strict=True))).schema
    timed = rows.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).withColumn("__now", F.unix_micros(F.col(time).cast("timestamp")))
    if rows.isStreaming:
        stamped = timed.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
        return stamped.groupBy(key).transformWithState(_Processor(rule, names, added, order), schema, "Append", "EventTime")

    def folded(batches):
        import pyarrow as pa

        of = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", tz="UTC")}
        held, state = None, Entries()

        def batch_of(out: list[tuple[dict, tuple]], like: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([r[n] for r, _ in out], like.schema.field(n).type) for n in names]
            columns += [pa.array([x[k] for _, x in out], of[kind]) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[*names, *added])

        last = None
        for batch in batches:
            out, last = [], batch
            for row in batch.to_pylist():
                if row[key] != held:
                    if rule.wakes and held is not None:
                        out += rule.due(state, 1 << 62)
                    held, state = row[key], Entries()
                columns = rule.step(state, row, row["__now"])
                if columns is not None:
                    out.append((row, columns))
                if rule.wakes:  # what is due by now goes out, as a timer would
                    out += rule.due(state, row["__now"]) if (rule.wake_at(state) or 1 << 62) < row["__now"] else ()
            yield batch_of(out, batch)
        if last is not None and rule.wakes:
            yield batch_of(list(rule.due(state, 1 << 62)), last)

    return timed.repartition(key).sortWithinPartitions(key, "__now", order).mapInArrow(folded, schema)
