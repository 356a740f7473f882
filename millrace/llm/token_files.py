"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id, so that file k holds smaller ids than file k + 1, and each
task writes its documents in order. A file is a run of pages, a page about 64k token ids of whole
documents: its document ids and token counts, and one payload:

    magic "PFR1", n ids, n blocks                                   (3 x u32)
    block starts: the byte at which each block's packed ids begin   (u32 each: the block index)
    block minimum (u32), packed width in bits (u8), exceptions (u8) (one a block)
    packed differences: as many planes of 128 bits a block as its width, lowest bits first
    exceptions: place in the block (u8), whole difference (u32)

A block's width is that of the 90th percentile of its differences from the block's minimum; larger
differences keep their low bits in place and their whole value in the exception list.

Spark's own committed writer stores the pages (as rows of a Parquet container), so a task that is
retried after a lost executor can't leave half a file, and any store that Spark reaches will do.

Defined results: null and empty texts hold the end id alone; a null doc_id comes before all others;
rows that repeat a doc_id are ordered by a hash of their texts; other columns are ignored; an empty
table gives no pages and no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, text_or_empty

BLOCK, PERCENTILE, PAGE_IDS = 128, 0.9, 65536
PAGES = "part int, page int, doc_ids array<bigint>, counts array<bigint>, payload binary"

_KEPT_UNITS, _UNITS_A_CALL = 800_000, 500
#: Texts are encoded together up to so many bytes (or one longer text), so that a frequent unit is looked up once for many texts.
_GROUP_BYTES = 1 << 22
#: Stand for a comma, a full stop, a full stop at a line's end, and a line's end before a unit.
_COMMA, _STOP, _STOP_LINE, _LINE = "\1", "\2", "\3", "\4"
_CUTS = ((", ", f" {_COMMA} "), (". ", f" {_STOP} "), (".\n", f" {_STOP_LINE} {_LINE}"))
_LOADED: dict[str, "UnitEncoder"] = {}


class _Places(dict):
    """Unit to its number; a unit that is asked for the first time gets the next one."""

    def __missing__(self, unit: str) -> int:
        self[unit] = place = len(self)
        self.new.append(unit)
        return place


class UnitEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct unit.

    The byte-level rule begins a new piece at every space that has no other white space beside it, and merges
    happen inside pieces only. So the ids of a text are those of its first unit and of each space with what
    follows up to the next. A comma or full stop that ends such a unit is a piece of its own if it follows a
    letter or decimal digit, and so is a line's end between a full stop and a unit; these are cut off too, so
    that fewer units are distinct. Where any of this isn't certain (white space beside white space, special
    strings, control characters used as marks), the library gets the whole text.

    The units used most stay known; flat holds their ids one after another."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes_of[k] = len(token)  # byte-level tokens have a character a byte
        self.place = _Places({_COMMA: 0, _STOP: 1, _STOP_LINE: 2})
        self.place.new = []
        self.flat = np.array([self._whole([x])[0].ids[0] for x in ",.."], np.uint32)
        self.sizes = np.ones(3, np.int64)
        self.uses = np.full(3, 1 << 40)
        self.sure = np.ones(3, bool)  # not empty, and no white space at either end
        self.open = np.zeros(3, bool)  # ends in a letter or decimal digit
        self.starts = np.arange(3)

    def _whole(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn(self) -> None:
        """Encodes the new units, many to a text: the library splits them there again. How many ids each has shows
        in the ids' byte lengths, for no id reaches over the start of a unit."""
        new, self.place.new = self.place.new, []
        bare = [x.removeprefix(_LINE) for x in new]
        sure = np.fromiter((x != "" and x == x.strip() for x in bare), bool, len(new))
        line = np.fromiter(map(len, new), np.int64, len(new)) > np.fromiter(map(len, bare), np.int64, len(new))
        sizes, begin, flat, held = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.flat], len(self.flat)
        for lead, group in ((" ", np.flatnonzero(sure & ~line)), ("\n", np.flatnonzero(sure & line))):
            units = [lead + bare[k] for k in group.tolist()]
            runs = ["".join(units[k : k + _UNITS_A_CALL]) for k in range(0, len(units), _UNITS_A_CALL)]
            ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in self._whole(runs)), np.uint32)
            ends = np.cumsum(self.bytes_of[ids])
            starts = np.cumsum([0, *map(len, map(str.encode, units))])
            found = np.searchsorted(ends, starts, side="right")
            begin[group], sizes[group] = held + found[:-1], np.diff(found)
            flat.append(ids)
            held += len(ids)
        self.flat = np.concatenate(flat)
        self.starts = np.concatenate([self.starts, begin])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.sure = np.concatenate([self.sure, sure])
        self.open = np.concatenate([self.open, np.fromiter((x[-1:].isalpha() or x[-1:].isdecimal() for x in new), bool, len(new))])

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: _KEPT_UNITS // 2])
        units = list(self.place)
        self.place = _Places({units[k]: n for n, k in enumerate(kept)})
        self.place.new = []
        sizes = self.sizes[kept]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.starts[kept] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.sizes, self.starts = sizes, ends - sizes
        self.uses, self.sure, self.open = np.minimum(self.uses[kept], 1 << 40) // 2, self.sure[kept], self.open[kept]
        self.uses[:3] = 1 << 40

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """How many units each text has, all of them, and which texts the library gets whole (these have one empty unit)."""
        whole = pc.match_substring_regex(texts, f"[{_COMMA}-{_LINE}]")
        for special in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        cut = pc.if_else(whole, pa.scalar("", texts.type), texts)
        for what, by in _CUTS:
            cut = pc.replace_substring(cut, what, by)
        units = pc.split_pattern(cut, " ")
        return pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64), units.flatten(), whole.to_numpy(zero_copy_only=False)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        if len(self.place) > _KEPT_UNITS:
            self._forget()
        count, units, whole = self._units(texts)
        begin = np.cumsum(count) - count
        coded = units.dictionary_encode()
        code = coded.indices.to_numpy()
        later = np.ones(len(code), bool)
        later[begin] = False  # the first unit of each text is seen to below
        code = code[later]
        # each distinct unit is looked up once, however often the texts have it
        times = np.bincount(code, minlength=len(coded.dictionary))
        some = np.flatnonzero(times)
        names = coded.dictionary.take(pa.array(some)).to_numpy(zero_copy_only=False)
        place = np.zeros(len(times), np.int64)
        place[some] = np.fromiter(map(self.place.__getitem__, names), np.int64, len(some))
        if self.place.new:
            self._learn()
        self.uses[place[some]] += times[some]
        at = place[code]
        firsts = units.take(pa.array(begin)).to_pylist()
        count -= 1
        ends = np.cumsum(count)
        # a mark must follow a letter or digit, and more must follow it
        marked = at < 3
        ok = self.sure[at]
        ok[1:] &= ~marked[1:] | self.open[at[:-1]]
        some = np.flatnonzero(count)
        begin = ends[some] - count[some]
        ok[begin] = self.sure[at[begin]]  # what comes before these is the first unit
        fits = ~whole
        if len(some):
            fits[some] &= np.logical_and.reduceat(ok, begin) & ~marked[ends[some] - 1]
        first_marked = np.zeros(len(texts), bool)
        first_marked[some] = marked[begin]
        for k, first in enumerate(firsts):
            if fits[k]:
                fits[k] = not (first[:1].isspace() or first[-1:].isspace() or not first and count[k]) and (not first_marked[k] or first[-1:].isalpha() or first[-1:].isdecimal())
            if not fits[k]:
                firsts[k] = texts[k].as_py()
        sizes = self.sizes[at]
        until = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - (until - sizes), sizes) + np.arange(until[-1] if len(until) else 0)]
        until = np.concatenate([[0], until])
        out = []
        for k, got in enumerate(self._whole(firsts)):
            own = np.array(got.ids, np.uint32)
            out.append(np.concatenate([own, ids[until[ends[k] - count[k]] : until[ends[k]]]]) if fits[k] and count[k] else own)
        return out


_BITS = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)


def _turned(bytes_: np.ndarray) -> np.ndarray:
    """Each eight bytes (the last axis) as a square of bits, its rows turned to columns."""
    x = np.ascontiguousarray(bytes_).view(">u8").astype(np.uint64)
    for step, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(step))) & np.uint64(mask)
        x ^= t ^ (t << np.uint64(step))
    return x.astype(">u8").view(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """A page's payload."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return b"PFR1" + np.array([0, 0], np.uint32).tobytes()
    x = np.pad(ids.astype(np.uint32), (0, blocks * BLOCK - n), mode="edge").reshape(blocks, BLOCK)
    low = x.min(1)
    rest = x - low[:, None]
    bits = _BITS[rest] if rest.max() < len(_BITS) else np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = int(BLOCK * PERCENTILE)
    width = np.partition(bits, at, axis=1)[:, at]
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    eights = [_turned((rest >> np.uint32(8 * k)).astype(np.uint8).reshape(blocks, BLOCK // 8, 8)) for k in range(max(1, -(-int(bits.max()) // 8)))]
    planes = np.concatenate([x[:, :, ::-1].transpose(0, 2, 1) for x in eights], axis=1)  # lowest bits first
    packed = planes[np.arange(planes.shape[1]) < width[:, None]]
    odd = bits > width[:, None]
    places = np.nonzero(odd)[1].astype(np.uint8)
    return b"".join(
        (
            b"PFR1", np.array([n, blocks], np.uint32).tobytes(), starts.astype(np.uint32).tobytes(), low.tobytes(),
            width.tobytes(), odd.sum(1).astype(np.uint8).tobytes(), packed.tobytes(), places.tobytes(), rest[odd].tobytes(),
        )
    )


def unpack(payload: bytes) -> np.ndarray:
    """The ids of pack()."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a page of token ids")
    n, blocks = (int(x) for x in np.frombuffer(payload, np.uint32, 2, 4))
    if not n:
        return np.zeros(0, np.uint32)
    at = 12

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, count, at)
        at += got.nbytes
        return got

    _, low, width, odd = take(np.uint32, blocks), take(np.uint32, blocks), take(np.uint8, blocks), take(np.uint8, blocks)
    packed = take(np.uint8, int(width.astype(np.int64).sum()) * (BLOCK // 8))
    places = take(np.uint8, int(odd.astype(np.int64).sum()))
    values = np.frombuffer(payload[at:], np.uint32)
    n_bytes = max(1, -(-int(width.max()) // 8))
    planes = np.zeros((blocks, 8 * n_bytes, BLOCK // 8), np.uint8)
    planes[np.arange(8 * n_bytes) < width[:, None]] = packed.reshape(-1, BLOCK // 8)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for k in range(n_bytes):
        eight = planes[:, 8 * k : 8 * k + 8].transpose(0, 2, 1)[:, :, ::-1]
        rest |= _turned(eight).reshape(blocks, BLOCK).astype(np.uint32) << np.uint32(8 * k)
    rest[np.repeat(np.arange(blocks), odd), places] = values
    return (rest + low[:, None]).reshape(-1)[:n]


def block_of(payload: bytes, place: int) -> np.ndarray:
    """The ids of the one block that holds a page's id number `place`, found by the block index."""
    n, blocks = (int(x) for x in np.frombuffer(payload, np.uint32, 2, 4))
    b = place // BLOCK
    start = int(np.frombuffer(payload, np.uint32, 1, 12 + 4 * b)[0])
    low = int(np.frombuffer(payload, np.uint32, 1, 12 + 4 * (blocks + b))[0])
    width, odd = (np.frombuffer(payload, np.uint8, blocks, 12 + 8 * blocks + k * blocks).astype(np.int64) for k in (0, 1))
    body = 12 + 10 * blocks
    w, exceptions, before = int(width[b]), body + int(width.sum()) * (BLOCK // 8), int(odd[:b].sum())
    rest = np.zeros(BLOCK, np.uint64)
    if w:
        planes = np.unpackbits(np.frombuffer(payload, np.uint8, w * BLOCK // 8, body + start)).reshape(w, BLOCK)
        rest = (np.uint64(1) << np.arange(w, dtype=np.uint64)) @ planes.astype(np.uint64)
    places = np.frombuffer(payload, np.uint8, int(odd[b]), exceptions + before)
    rest[places] = np.frombuffer(payload[exceptions + int(odd.sum()) + 4 * before :], np.uint32, int(odd[b]))
    return (rest + low).astype(np.uint32)[: min(BLOCK, n - b * BLOCK)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """(doc_ids, texts) of about _GROUP_BYTES, in order, over the borders of batches."""
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < len(batch):
            to = min(len(batch), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _GROUP_BYTES - held)) + 1)
            parts.append(batch.slice(at, to - at))
            held += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if held >= _GROUP_BYTES:
                yield list(itertools.chain.from_iterable(x.column("doc_id").to_pylist() for x in parts)), pa.concat_arrays([x.column("text") for x in parts])
                parts, held = [], 0
    if parts:
        yield list(itertools.chain.from_iterable(x.column("doc_id").to_pylist() for x in parts)), pa.concat_arrays([x.column("text") for x in parts])


def _pages(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = UnitEncoder(path)
        encoder, part, page = _LOADED[path], TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            counts = [len(x) + 1 for x in ids]
            payload = pack(np.concatenate([y for x in ids for y in (x, end)]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([page], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                ],
                ["part", "page", "doc_ids", "counts", "payload"],
            )

        for group, texts in _groups(batches):
            for doc_id, got in zip(group, encoder.encode(texts), strict=True):
                doc_ids.append(doc_id)
                ids.append(got)
                held += len(got) + 1
                if held >= PAGE_IDS:
                    yield flush()
                    doc_ids, ids, held, page = [], [], 0, page + 1
        if ids:
            yield flush()

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, out_dir: str, tokenizer_path: str, *, end_id: int = 0) -> None:
    """Encodes docs (doc_id, text), appends end_id to each, and writes them in ascending doc_id order."""
    small_batches(spark)
    (
        docs.select("doc_id", text_or_empty().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(_pages(tokenizer_path, end_id), PAGES)
        .write.parquet(out_dir)
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "page", "doc_id", "before", "n_tokens", "ids_crc32"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for part, page, doc_ids, counts, payload in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            ids = unpack(payload)
            ends = np.cumsum(np.array(counts, np.int64))
            if ends[-1] != len(ids):
                raise ValueError(f"page {page} of part {part} holds {len(ids)} ids, its documents {ends[-1]}")
            crc = [zlib.crc32(ids[e - c : e].astype("<u4")) for e, c in zip(ends, counts, strict=True)]
            n = len(doc_ids)
            columns = [[part] * n, [page] * n, doc_ids, ends - counts, counts, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """The pages of write_token_files, with `start`: the ids in all files and pages before."""
    from pyspark.sql import Window

    pages = spark.read.schema(PAGES).parquet(out_dir)
    sizes = pages.select("part", "page", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    # sums by file first; what then meets in one task is a row a file, not a row a document
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = sizes.join(parts, "part").select(
        "part", "page", (F.col("part_start") + F.sum("n").over(Window.partitionBy("part").orderBy("page")) - F.col("n")).alias("page_start")
    )
    return pages, starts


def token_file_digests(spark: SparkSession, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    pages, starts = read_token_files(spark, out_dir)
    got = pages.mapInArrow(_digests, "part int, page int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    return got.join(starts, ["part", "page"]).select(
        "doc_id", (F.col("page_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
