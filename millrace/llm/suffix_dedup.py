"""Removal of repeated byte strings by suffix arrays, built by two-stage sorting.

A byte goes if it is covered by a string of `width` bytes that also starts anywhere else. Strings are judged on
the input.

One suffix array of a corpus can't be built in one place, so starts are first dealt into groups that can share
strings: each window of `width` bytes is dealt by the least hash of the GRAM-byte strings inside it. Equal windows
have equal least hashes, so they meet; a run of starts with one least hash is a segment, and its bytes carry
exactly its windows. Then, with counts combined before any shuffle:

1. a least hash that occurs once in the corpus holds no repeat (nearly all text ends here);
2. segments that are alike, byte for byte, are one segment with a count; if a hash has no other, all its windows
   repeat, and no bytes are needed;
3. the segments of the other hashes are suffix-sorted in blocks of whole hashes. Stage one directly sorts only the
   suffixes smaller than their successors; stage two induces the rest by scanning buckets in order; adjacent common
   prefixes then show the windows that occur twice.

A hash whose different segments don't fit in a block (a very common passage in ever new surroundings) is not cut
short: its windows are compared by 128-bit digests in a distributed count instead, which is exact and splits.

Defined results: null text is empty; texts under `width` bytes lose nothing; repeated rows are copies of each other;
every row gets a row, whatever its id; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import batch_rows, discard, text_or_empty, written

WIDTH, GRAM = 400, 128
BLOCK_BYTES = 1 << 20
HOT_BYTES = 1 << 23
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE_HASH = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)
#: Never a byte of UTF-8: ends each text or segment.
END = 0xFF


def _doubled(raw: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of the strings of 1, 2, 4 .. top bytes at each place (places near the end read END bytes)."""
    found = {1: _BYTE_HASH[raw]}
    size = 1
    while size < top:
        h = found[size]
        step = np.uint64(pow(_MULTIPLIER, size, 1 << 64))
        after = np.concatenate([h[size:], np.zeros(min(size, len(h)), np.uint64)])
        found[2 * size] = h * step + after
        size *= 2
    return found


def segments(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts: number of the text, start in it, length, least hash, digest of the bytes, and whether the
    least hash occurs in it twice (only then can the segment repeat a window of its own)."""
    whole = b"".join(texts)
    raw = np.frombuffer(whole, np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    begins = ends - [len(x) for x in texts]
    if not len(raw):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = _doubled(raw, gram)[gram]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least, size, need = h, 1, width - gram + 1
    while size * 2 <= need:
        least = np.minimum(least, np.concatenate([least[size:], least[-1:].repeat(min(size, len(least)))]))
        size *= 2
    if size < need:
        shift = need - size
        least = np.minimum(least, np.concatenate([least[shift:], least[-1:].repeat(min(shift, len(least)))]))
    text_of = np.repeat(np.arange(len(texts)), ends - begins)
    starts = np.flatnonzero(np.arange(len(raw)) <= ends[text_of] - width)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    key, owner = least[starts], text_of[starts]
    cut = np.flatnonzero((key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(starts)]]) - 1
    a, b = starts[first], starts[last] + width
    view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
    seg = np.array([digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
    again = np.array([np.count_nonzero(h[x:y] == k) > 1 for x, y, k in zip(a.tolist(), (b - gram + 1).tolist(), key[first], strict=True)], np.int64)
    return owner[first], a - begins[owner[first]], b - a, key[first].view(np.int64), seg.view(np.int64), again


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """(tids, texts) of about a MB, or one longer text."""
    tids, texts, held = [], [], 0
    for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text"), strict=True):
        tids.append(tid)
        texts.append(text.as_buffer().to_pybytes())
        held += len(texts[-1])
        if held > 1 << 20:
            yield tids, texts
            tids, texts, held = [], [], 0
    if texts:
        yield tids, texts


OCCURRENCE = "key bigint, seg bigint, tid bigint, start int, len int, again bigint"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tids, texts in _chunks(batch):
            owner, start, size, key, seg, again = segments(texts)
            columns = [pa.array(key), pa.array(seg), pa.array(np.array(tids, np.int64)[owner]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "seg", "tid", "start", "len", "again"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, alike segments combined as far as a batch goes: one of them, and how many."""
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch]).group_by(["key", "seg"], use_threads=False).aggregate([("tid", "first"), ("start", "first"), ("len", "first"), ("again", "first"), ("tid", "count")])
        table = table.select(["key", "seg", "tid_first", "start_first", "len_first", "again_first", "tid_count"]).rename_columns(["key", "seg", "tid", "start", "len", "again", "n"])
        yield from table.combine_chunks().to_batches()


def _sort_direct(raw: np.ndarray, at: np.ndarray, h: dict[int, np.ndarray], depth: int) -> np.ndarray:
    """at (places) in the order of the suffixes there, to depth bytes; ties in order of place.

    Refines groups of ties by eight bytes at a time; before that, each group skips what all of it share."""
    words = np.zeros(len(raw), np.uint64)
    for k in range(8):
        words[: len(raw) - k] |= raw[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = at[np.argsort(words[at], kind="stable")]
    value = words[order]
    head = np.concatenate([[True], value[1:] != value[:-1]])
    group = np.cumsum(head) - 1
    sizes = np.bincount(group)
    live = np.flatnonzero(sizes[group] > 1)  # places in order that are still tied
    if not len(live):
        return order
    done = np.full(len(live), 8, np.int64)
    tied = group[live]
    limit = len(raw) - 1
    while len(live):
        cuts = np.flatnonzero(np.concatenate([[True], tied[1:] != tied[:-1]]))
        of = np.repeat(np.arange(len(cuts)), np.diff(np.concatenate([cuts, [len(live)]])))
        for size in (256, 128, 64, 32, 16, 8):
            ahead = h[size][np.minimum(order[live] + done, limit)]
            same = np.logical_and.reduceat(ahead == ahead[cuts][of], cuts)
            done += np.where(same[of] & (done < depth), size, 0)
        more = done < depth
        if not more.any():
            break
        live, done, tied = live[more], done[more], tied[more]
        value = words[np.minimum(order[live] + done, limit)]
        turn = np.lexsort((value, tied))
        order[live] = order[live][turn]
        value, done = value[turn], done[turn] + 8
        fresh = np.concatenate([[True], (tied[1:] != tied[:-1]) | (value[1:] != value[:-1])])
        tied = np.cumsum(fresh) - 1
        keep = np.bincount(tied)[tied] > 1
        live, done, tied = live[keep], done[keep], tied[keep]
    return order


def suffix_array(raw: np.ndarray, h: dict[int, np.ndarray], depth: int) -> np.ndarray:
    """Places of raw (which ends in END) in the order of their suffixes, to at least depth bytes."""
    n = len(raw)
    # a suffix is smaller than its successor if its byte is smaller than the next other byte
    change = np.flatnonzero(raw[1:] != raw[:-1])
    nxt = np.searchsorted(change, np.arange(n))
    inside = nxt < len(change)
    smaller = np.zeros(n, bool)
    smaller[inside] = raw[inside] < raw[change[nxt[inside]] + 1]
    direct = _sort_direct(raw, np.flatnonzero(smaller), h, depth)
    bucket = np.searchsorted(raw[direct], np.arange(257))
    larger_of = [[] for _ in range(256)]  # in each bucket: what has been induced so far, in order
    # the last suffix has no successor; it is the least of those that begin with its byte and aren't smaller
    larger_of[int(raw[-1])].append(np.array([n - 1]))
    out = []
    for b in range(256):
        new = larger_of[b]
        k = 0
        while k < len(new):  # what this bucket induces into itself joins it, and induces in turn
            scan(new[k], b, raw, smaller, larger_of)
            k += 1
        out += new
        ordered = direct[bucket[b] : bucket[b + 1]]
        if len(ordered):
            scan(ordered, b, raw, smaller, larger_of)
            out.append(ordered)
    return np.concatenate(out)


def scan(ordered: np.ndarray, b: int, raw: np.ndarray, smaller: np.ndarray, larger_of: list[list[np.ndarray]]) -> None:
    """Puts the predecessors that are not smaller than their successors at the ends of their buckets."""
    before = ordered[ordered > 0] - 1
    before = before[~smaller[before]]
    if not len(before):
        return
    first = raw[before]
    turn = np.argsort(first, kind="stable")
    before, first = before[turn], first[turn]
    cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    for piece in np.split(before, cuts[1:]):
        larger_of[int(raw[piece[0]])].append(piece)


def common_prefixes(order: np.ndarray, h: dict[int, np.ndarray], depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order (0 for the first), counted to depth at least."""
    a, b = order[:-1].copy(), order[1:].copy()
    n, shared = len(h[1]), np.zeros(len(order), np.int64)
    top = 1
    while top * 2 <= depth:
        top *= 2
    size = top
    while size:
        fits = (np.maximum(a, b) + size <= n)
        same = fits.copy()
        same[fits] = h[size][a[fits]] == h[size][b[fits]]
        shared[1:] += np.where(same, size, 0)
        a += np.where(same, size, 0)
        b += np.where(same, size, 0)
        size //= 2
    return shared


def repeats_in(parts: list[bytes], keys: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each segment, the starts of its windows that occur twice or more among the segments of its key."""
    raw = np.frombuffer(bytes([END]).join(parts) + bytes([END]), np.uint8)
    sizes = np.array([len(x) for x in parts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    h = _doubled(raw, 256)
    order = suffix_array(raw, h, width)
    shared = common_prefixes(order, h, width)
    segment = np.repeat(np.arange(len(parts)), sizes + 1)
    run = np.cumsum(shared < width)
    real = np.arange(len(raw)) <= (begins + sizes - width)[segment]
    kept = real[order]
    place, run = order[kept], run[kept]
    own = segment[place]
    turn = np.lexsort((keys[own], run))
    place, run, own = place[turn], run[turn], own[turn]
    fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (keys[own][1:] != keys[own][:-1])]) if len(place) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    twice = np.bincount(group, weights=counts[own])[group] >= 2 if len(place) else np.zeros(0, bool)
    place = np.sort(place[twice])
    return [place[i:j] - b for i, j, b in zip(np.searchsorted(place, begins), np.searchsorted(place, begins + sizes + 1), begins, strict=True)]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals (starts ascending) cover; intervals that touch are one run."""
    if not len(starts):
        return starts, ends
    far = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > far[:-1]])
    return starts[new], far[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(far) - 1]])]


FOUND = "key bigint, seg bigint, a array<int>, b array<int>"


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; blocks end between keys."""
    rows: list[tuple[int, int, int, bytes]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        keys = np.array([r[0] for r in rows], np.int64)
        found = repeats_in([r[3] for r in rows], keys, np.array([r[2] for r in rows], np.int64))
        out = [(r[0], r[1], *merged(x, x + WIDTH)) for r, x in zip(rows, found, strict=True) if len(x)]
        columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), *(pa.array([r[k].tolist() for r in out], pa.list_(pa.int32())) for k in (2, 3))]
        return pa.RecordBatch.from_arrays(columns, ["key", "seg", "a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("key", "seg", "n", "body")), strict=True):
            if held > BLOCK_BYTES and row[0] != rows[-1][0]:
                yield flush()
                rows, held = [], 0
            rows.append(row)
            held += len(row[3])
    if rows:
        yield flush()


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for key, seg, n, body in zip(*(batch.column(k).to_pylist() for k in ("key", "seg", "n", "body")), strict=True):
            view, count = memoryview(body), len(body) - WIDTH + 1
            for k in range(0, count, 20_000):
                places = range(k, min(count, k + 20_000))
                m = len(places)
                columns = [pa.array([key] * m, pa.int64()), pa.array([seg] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array(places, pa.int32()), pa.array([digest(view[p : p + WIDTH]) for p in places], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "seg", "n", "place", "digest"])


def _hot_repeats(bodies: DataFrame) -> DataFrame:
    """FOUND rows, an interval a window, of segments whose key has too many for one block."""
    windows = written(bodies.mapInArrow(_window_digests, "key bigint, seg bigint, n bigint, place int, digest binary"), "suffix-windows")
    twice = windows.groupBy("digest").agg(F.sum("n").alias("total")).filter("total >= 2").select("digest")
    return windows.join(twice, "digest", "left_semi").select("key", "seg", F.array("place").alias("a"), F.array(F.col("place") + WIDTH).alias("b"))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            text = batch.column("text")[row].as_buffer().to_pybytes()
            wanted = batch.column("wanted")[row].as_py()
            columns = [pa.array([w[k] for w in wanted], pa.int64()) for k in ("key", "seg", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([text[w["start"] : w["start"] + w["len"]] for w in wanted], pa.binary())], ["key", "seg", "n", "body"])


def _release() -> None:
    """Shuffle files whose tables have been written are dropped when the driver collects its garbage: a second time, for what
    the first one lets go."""
    for _ in range(2):
        gc.collect()
        SparkSession.getActiveSession()._jvm.System.gc()
        time.sleep(0.5)


def repeated_spans(numbered: DataFrame) -> DataFrame:
    """tid, a, b (arrays): intervals to remove, of the texts of numbered (tid, text) that have any."""
    long = numbered.filter(F.octet_length("text") >= WIDTH)
    alike = (
        long.mapInArrow(_occurrences, OCCURRENCE).mapInArrow(_counted, OCCURRENCE + ", n bigint")
        .repartition("key").groupBy("key", "seg").agg(F.sum("n").alias("n"), F.first("tid").alias("tid"), F.first("start").alias("start"), F.first("len").alias("len"), F.first("again").alias("again"))
    )
    from pyspark.sql import Window

    by_key = Window.partitionBy("key")
    repeated = written(
        alike.withColumns({"variants": F.count("*").over(by_key), "total": F.sum("n").over(by_key), "bytes": F.sum("len").over(by_key)}).filter("total >= 2 OR again > 0"), "suffix-repeated"
    )
    _release()
    copies = repeated.filter("variants = 1 AND total >= 2").select("key", "seg", F.array(F.lit(0)).alias("a"), F.array("len").alias("b"))
    wanted = repeated.filter("variants > 1 OR total = 1").groupBy("tid").agg(F.collect_list(F.struct("key", "seg", "n", "start", "len")).alias("wanted"))
    bodies = written(long.join(wanted, "tid").select("text", "wanted").mapInArrow(_bodies, "key bigint, seg bigint, n bigint, body binary"), "suffix-bodies")
    _release()
    hot = repeated.filter("variants > 1 OR total = 1").filter(F.col("bytes") > HOT_BYTES).select("key").distinct()
    cold = bodies.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "seg")
    found = written(cold.mapInArrow(_sorted_blocks, FOUND), "suffix-found").unionByName(copies)
    if not hot.isEmpty():
        found = found.unionByName(_hot_repeats(bodies.join(hot, "key", "left_semi")))
    discard(bodies)
    spans = long.mapInArrow(_occurrences, OCCURRENCE).join(found, ["key", "seg"])
    spans = spans.select("tid", F.transform("a", lambda x: x + F.col("start")).alias("a"), F.transform("b", lambda x: x + F.col("start")).alias("b"))
    out = written(spans.groupBy("tid").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b")), "suffix-spans")
    _release()
    return out


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, repeats boolean, removed array<struct<start: int, end: int>>"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for row in range(len(batch)):
            text = batch.column("text")[row].as_buffer().to_pybytes()
            a, b = (np.array(batch.column(k)[row].as_py() or [], np.int64) for k in ("a", "b"))
            turn = np.argsort(a, kind="stable")
            a, b = merged(a[turn], b[turn])
            digest, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                digest.update(text[at:x])
                at = y
            digest.update(text[at:])
            for column, value in zip(out, (batch.column("doc_id")[row].as_py(), len(text), int((b - a).sum()), len(a), digest.hexdigest(), len(a) > 0, [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]), strict=True):
                column.append(value)
        kinds = [*[pa.int64()] * 4, pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "removed"])


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, a, b: every row of docs (doc_id, text), with the intervals of bytes to remove (null: none)."""
    numbered = written(docs.select(F.monotonically_increasing_id().alias("tid"), "doc_id", text_or_empty().alias("text")), "suffix-texts")
    return numbered.join(repeated_spans(numbered), "tid", "left").select("doc_id", "text", "a", "b")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """RESULT: what is removed from every row of docs (doc_id, text): its bytes, spans (removed: start, and end after the last
    byte) and whether there are any (repeats); and the digest of what stays."""
    with batch_rows(docs.sparkSession, 500):
        return written(with_spans(docs).mapInArrow(_removed, RESULT), "suffix-result")
