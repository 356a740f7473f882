"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link if they differ in at most 3. Anchors are the words of a covering code; a
fingerprint is replicated to every anchor within covering radius plus threshold, and compared per anchor.

A pair at distance 3 or less differs in at most one bit in one of its two 32-bit halves, so each half has a
covering code of its own and threshold 1. The code is a sum of perfect codes: the binary Golay code on 23 bits
(radius 3), the Hamming code on 7 (radius 1), and both values of the last 2 bits: 2^18 anchors a half, and one
home anchor for every half. The anchors within radius + 1 at which a partner can be at home are the homes of
the half and of its 32 one-bit neighbours: about ten. If f and g are within one bit in a half, f's home is
among g's anchors, so they meet there.

Rows alike in fingerprint are one row before any comparison. Within an anchor's rows each fingerprint is
searched for among those not yet reached, so a dense crowd of n near copies costs about n comparisons and
gives n - 1 links, not a row a pair.

Defined results: A-Z are lowered; null texts and texts without words have fingerprint 0, and link like any
other; repeated rows each get a row; a null doc_id never names a component unless all its ids are null; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, small_batches, text_or_empty, written
from millrace.llm.graph import components

THRESHOLD = 3
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def fingerprint(text: str) -> int:
    """The unsigned fingerprint: a bit is set if more than half of the 3-word shingles' hashes have it."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest, space = xxhash.xxh64_intdigest, b" "
    if len(words) < 3:
        return digest(space.join(words), 42)
    hashes = np.array([digest(a + space + b + space + c, 42) for a, b, c in zip(words, words[1:], words[2:])], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "fp"])


@cache
def _golay_homes() -> np.ndarray:
    """Number of the codeword within distance 3 of each 23-bit word. The code is cyclic, generated by the
    polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value of the code's definition)."""
    words = np.zeros(1, np.uint32)
    for k in range(12):
        words = np.concatenate([words, words ^ np.uint32(0b101011100011 << k)])
    bit = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = {0, *map(int, bit), *(int(a ^ b) for a in bit for b in bit if a < b), *(int(a ^ b ^ c) for a in bit for b in bit if a < b for c in bit if b < c)}
    homes = np.full(1 << 23, -1, np.int16)
    for e in errors:
        homes[words ^ np.uint32(e)] = np.arange(4096)
    return homes


@cache
def _hamming_homes() -> np.ndarray:
    """Number of the codeword within distance 1 of each 7-bit word."""
    words = [w for w in range(128) if not any(bin(w & mask).count("1") % 2 for mask in (0b1010101, 0b1100110, 0b1111000))]
    homes = np.full(128, -1, np.int64)
    for n, w in enumerate(words):
        homes[[w, *(w ^ (1 << k) for k in range(7))]] = n
    return homes


def home_anchors(half: np.ndarray) -> np.ndarray:
    """The anchor (18 bits) whose ball holds each 32-bit word."""
    half = half.astype(np.int64)
    return _golay_homes()[half & 0x7FFFFF].astype(np.int64) << 6 | _hamming_homes()[half >> 23 & 127] << 2 | half >> 30


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.array([0, *(1 << k for k in range(32))], np.int64)
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        u = fp.view(np.uint64)
        for half, words in ((0, u & np.uint64(0xFFFFFFFF)), (1, u >> np.uint64(32))):
            near = np.sort(home_anchors(words.astype(np.int64)[:, None] ^ flips[None, :]), axis=1)
            fresh = np.ones(near.shape, bool)
            fresh[:, 1:] = near[:, 1:] != near[:, :-1]
            row, column = np.nonzero(fresh)
            yield pa.RecordBatch.from_arrays([pa.array((near[row, column] << 1 | half).astype(np.int32)), pa.array(fp[row])], ["anchor", "fp"])


def spanning_links(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join all of fps (distinct) which steps of at most threshold bits can join."""
    links, rest = [], fps.view(np.uint64)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                found, rest = rest[near], rest[~near]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by anchor, and an anchor's rows may run on into the next batch."""

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(anchor)]]))
        small = np.repeat(sizes <= 8, sizes)
        u, pairs = fp.view(np.uint64), []
        for d in range(1, 8):  # small groups: neighbour by neighbour, all groups at once
            if len(u) > d:
                at = np.flatnonzero((anchor[d:] == anchor[:-d]) & small[d:] & (np.bitwise_count(u[d:] ^ u[:-d]) <= THRESHOLD))
                pairs.append(np.stack([u[at], u[at + d]], 1))
        for k in np.flatnonzero(sizes > 8):
            if found := spanning_links(fp[starts[k] : starts[k] + sizes[k]]):
                pairs.append(np.array(found, np.uint64))
        got = np.unique(np.concatenate(pairs), axis=0).view(np.int64) if pairs else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, 0])), pa.array(np.ascontiguousarray(got[:, 1]))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        anchor, fp = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last or (held and held[-1][0][-1] != anchor[-1]):
            whole = [*held, (anchor[:last], fp[:last])]
            yield links(np.concatenate([a for a, _ in whole]), np.concatenate([f for _, f in whole]))
            held = []
        held.append((anchor[last:], fp[last:]))
    if held:
        yield links(np.concatenate([a for a, _ in held]), np.concatenate([f for _, f in held]))


def near_links(fingerprints: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) whose components are those of all pairs within THRESHOLD bits."""
    spark = fingerprints.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    spread = fingerprints.select("fp").mapInArrow(_anchors, "anchor int, fp bigint")
    found = spread.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare, "a bigint, b bigint")
    return written(found, "simhash-links")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its group) of every row of docs
    (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = written(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "simhash-docs")
    nodes = written(keyed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    links = near_links(nodes)
    joined = components(links)
    rooted = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = written(rooted.join(named, "root").select("fp", "component_id"), "simhash-groups")
    discard(links)
    return keyed.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, as it is: the one with the smallest doc_id (null last)."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("tid"), F.struct(*docs.columns).alias("row")), "simhash-numbered")
    grouped = near_groups(rows.select(F.col("tid").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("tid"), "component_id")
    ids = rows.select("tid", F.col("row.doc_id").alias("doc_id")).join(grouped, "tid")
    chosen = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("m"))
    return rows.join(chosen.select(F.col("m.tid").alias("tid")), "tid", "left_semi").select("row.*")
