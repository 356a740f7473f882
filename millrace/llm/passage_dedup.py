"""Near-duplicate passages by compact windows.

A passage is a run of 50 words: 46 shingles of 5 words. Two passages are similar if at least 41 of their shingles agree (a
Jaccard similarity of 41 / 51 >= 0.8, shingles that repeat counted as often as they repeat). A word is repeated if it
lies in a passage that has a similar one elsewhere, between the first and the last shingle in which they agree; longer
passages are the union of those.

For a hash function, the Cartesian tree over the shingles' hashes has a node for each shingle c that is the least of a
range [lo, hi] around it: every passage within the range that contains c has c's hash as its min-hash. Ranges shorter
than a passage hold none; the others, about 2 / 46 of the text's length, stand for all of its passages.

1. The windows of FUNCTIONS hash functions are dealt by hash. Those whose hash occurs once in the corpus go; those whose
   surroundings (all passages that contain c) occur twice, word for word, are repeated as they stand, and one of them
   represents the others from here on.
2. Interval join within each text: a window stays if a passage fits into it and into a window of another function, with
   both minima. So similar passages are asked to agree in ENOUGH min-hashes; as all but ENOUGH - 1 functions then have
   a window for each pair, only those carry their surroundings on.
3. Verification per hash: the surroundings of its windows are compared, all with all if there are few. If there are many,
   windows are compared with the first one; then a passage that is still without a similar one needs a partner that
   shares one of the 6 least frequent of its 46 shingles (else they can't agree in 41), so only windows that share such
   a shingle are compared, one after the other until every passage that asks for one has a similar one.

Common lines shorter than a passage cost little that way: what is around them is rare. Windows whose surroundings repeat
often are combined before they are shuffled.

Defined results: A-Z and other letters are lowered, words are separated by white space; null and empty texts, and texts
under 50 words, have no passages; a passage that repeats in its own text counts if its copies don't overlap; repeated rows
repeat each other; each row is judged by itself, whatever its id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_rows, discard, text_or_empty, written
from millrace.llm.suffix_dedup import _release, merged
from millrace.llm.words import word_hashes

SHINGLE, MIN_WORDS, FUNCTIONS, ENOUGH = 5, 50, 4, 2
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
AGREE = 41  # of the shingles of two passages: the least with a Jaccard similarity of 0.8
RARE = MIN_SHINGLES - AGREE + 1
AROUND = MIN_SHINGLES - 1  # shingles on either side of a minimum that passages with it reach
WIDTH = 2 * AROUND + 1
SMALL = 64  # windows of a hash that are compared all with all
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([xxhash.xxh64_intdigest(bytes([k]), 3) | 1 for k in range(FUNCTIONS)], np.uint64)


def texts_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 5-word shingles of texts (never 0), in one array in which AROUND zeros come before, after and
    between texts; and where each text begins in it, and a next one would."""
    words, n_words = word_hashes([x.lower().split() for x in texts])
    n = np.maximum(0, n_words - SHINGLE + 1)
    begin = AROUND + np.concatenate([[0], np.cumsum(n + AROUND)])
    out = np.zeros(begin[-1], np.uint64)
    h = words[: max(0, len(words) - SHINGLE + 1)].copy()
    for k in range(1, SHINGLE):
        h = (h ^ (h >> np.uint64(31))) * _ODD + words[k : k + len(h)]
    total = int(n.sum())
    each = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(begin[:-1], n) + each] = h[np.repeat(np.cumsum(n_words) - n_words, n) + each] | np.uint64(1)
    return out, begin


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the 5-word shingles (never 0)."""
    return texts_shingles([text])[0][AROUND:-AROUND]


def compact_windows(h: np.ndarray, least: int = MIN_SHINGLES, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, c, hi of the nodes of the Cartesian tree of h whose range has at least `least` places. Zeros in h end
    sequences. Equal least hashes are one node, with its first place. With reach (least - 1 or more), ranges end that
    far from c, and each of equal least hashes is a node that is the first one of a passage."""
    n = len(h)
    if n < least:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    bits = np.uint64(max(1, n.bit_length()))
    low = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= least:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: n - least + 1], low[least - size : least - size + n - least + 1])
    # the passages of a node follow one another
    c = (low[np.concatenate([[True], low[1:] != low[:-1]])] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    c = c[h[c] > 0]
    mins, size = [h], 1
    while size * 2 <= min(n, n if reach is None else reach):
        mins.append(np.minimum(mins[-1][:-size], mins[-1][size:]))
        size *= 2
    value, lo, hi = h[c], c.copy(), c.copy()
    for k in range(len(mins) - 1, -1, -1):
        size = 1 << k
        fits = lo >= size
        fits[fits] = mins[k][lo[fits] - size] >= value[fits]
        lo -= np.where(fits, size, 0)
        fits = hi + size < n
        fits[fits] = mins[k][hi[fits] + 1] >= value[fits]
        hi += np.where(fits, size, 0)
    if reach is not None:
        return np.maximum(lo, c - reach), c, np.minimum(hi, c + reach)
    order = np.lexsort((c, hi, lo))
    lo, c, hi = lo[order], c[order], hi[order]
    first = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(c) else np.zeros(0, bool)
    return lo[first], c[first], hi[first]


def _alone(v: np.ndarray, lo: np.ndarray, c: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order of v and c: those with the same hash in their range before them keep the part in which they are alone;
    and which nodes then still hold a passage (so copies in one text count if they don't overlap)."""
    again = np.concatenate([[False], (v[1:] == v[:-1]) & (c[:-1] >= lo[1:])]) if len(v) else np.zeros(0, bool)
    before, after = np.concatenate([[-1], c[:-1]]), np.concatenate([c[1:], [0]])
    more = np.concatenate([(v[1:] == v[:-1]) & (c[1:] <= hi[:-1]), [False]]) if len(v) else again
    lo, hi = np.where(again, np.maximum(lo, before + 1), lo), np.where(again & more, np.minimum(hi, after - 1), hi)
    return lo, hi, hi - lo + 1 >= MIN_SHINGLES


def _surroundings(h: np.ndarray) -> np.ndarray:
    """A hash of the WIDTH places around each place of h (which begins and ends with AROUND zeros)."""
    n, sums, size = len(h) - WIDTH + 1, [h], 1
    while size * 2 <= WIDTH:
        last = sums[-1]
        sums.append((last[:-size] ^ (last[:-size] >> np.uint64(29))) * _ODD + last[size:])
        size *= 2
    out, at = np.zeros(n, np.uint64), 0
    for k in range(len(sums) - 1, -1, -1):
        if WIDTH >> k & 1:
            out = (out ^ (out >> np.uint64(31))) * _SEEDS[0] + sums[k][at : at + n]
            at += 1 << k
    return np.concatenate([np.zeros(AROUND, np.uint64), out, np.zeros(AROUND, np.uint64)])


WINDOW = "v bigint, ctx bigint, f tinyint, tid bigint, c int, lo tinyint, hi tinyint, twice boolean"
_WINDOW = ["v", "ctx", "f", "tid", "c", "lo", "hi", "twice"]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOW rows; lo and hi are the ends of the range within AROUND of c, relative to c. twice: known to be repeated."""

    def made(tids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        whole, begin = texts_shingles(texts)
        around = _surroundings(whole)
        for f in range(FUNCTIONS):
            h = (whole ^ _SEEDS[f]) * _ODD
            h = (h ^ (h >> np.uint64(32))) * _SEEDS[f]
            h = np.where(whole > 0, h | np.uint64(1), np.uint64(0))
            lo, c, hi = compact_windows(h, reach=AROUND)
            of = np.searchsorted(begin, c, side="right") - 1
            turn = np.lexsort((c, h[c], of))
            lo, c, hi, of = lo[turn], c[turn], hi[turn], of[turn]
            lo, hi, kept = _alone(h[c], lo, c, hi)
            # of those alike in hash and surroundings only two go on; the others are known to be repeated
            turn = np.flatnonzero(kept)
            turn = turn[np.lexsort((around[c[turn]], h[c[turn]]))]
            lo, c, hi, of = lo[turn], c[turn], hi[turn], of[turn]
            v, ctx = h[c], around[c]
            alike = np.concatenate([[False], (v[1:] == v[:-1]) & (ctx[1:] == ctx[:-1])]) if len(c) else np.zeros(0, bool)
            twice = alike & np.concatenate([[False], alike[:-1]]) if len(c) else alike
            tid = np.array(tids, np.int64)[of]
            v = np.where(twice, tid.view(np.uint64) * _ODD, v)
            columns = [v.view(np.int64), ctx.view(np.int64), np.full(len(c), f, np.int8), tid, (c - begin[of]).astype(np.int32), (lo - c).astype(np.int8), (hi - c).astype(np.int8), twice]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], _WINDOW)

    for batch in batches:
        for tids, texts in _some_texts(batch, "tid"):
            yield from made(tids, texts)


def _some_texts(batch: pa.RecordBatch, *others: str) -> Iterator[tuple]:
    """The columns others and text of about a MB of texts, or one longer text."""
    held, first = 0, 0
    for k, text in enumerate(batch.column("text")):
        held += len(text.as_buffer())
        if held > 1 << 20 or k + 1 == len(batch):
            some = batch.slice(first, k + 1 - first)
            yield *(some.column(x).to_pylist() for x in others), some.column("text").to_pylist()
            held, first = 0, k + 1


MEMBER = "v bigint, f tinyint, tid bigint, c int, lo tinyint, hi tinyint, exact boolean, n int"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by v and ctx, and a v may run on into the next batch. exact: the surroundings repeat; n: how many
    the row represents in the comparison of its v (0: it takes no part)."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        v, ctx = (rows.column(k).to_numpy() for k in ("v", "ctx"))
        done = rows.column("twice").to_numpy(zero_copy_only=False)
        fresh = np.concatenate([[True], (v[1:] != v[:-1]) | (ctx[1:] != ctx[:-1]) | done[1:] | done[:-1]])
        kind = np.cumsum(fresh) - 1
        alike = np.bincount(kind)
        group = np.cumsum(np.concatenate([[True], (v[1:] != v[:-1]) | done[1:] | done[:-1]])) - 1
        kinds = np.bincount(group, weights=fresh)
        odd = np.bincount(group, weights=fresh & (alike[kind] == 1))
        compare = fresh & (kinds[group] > 1) & (odd[group] > 0)
        exact = done | (alike[kind] > 1)
        kept = exact | compare
        n = np.where(compare, alike[kind], 0).astype(np.int32)
        out = rows.select(["v", "f", "tid", "c", "lo", "hi"]).append_column("exact", pa.array(exact)).append_column("n", pa.array(n))
        return out.filter(pa.array(kept)).combine_chunks()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        v = batch.column("v").to_numpy()
        last = int(np.searchsorted(v, v[-1]))
        if last or held and held[-1].column("v")[0].as_py() != v[-1]:
            yield from judged(pa.Table.from_batches([*held, batch.slice(0, last)])).to_batches()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from judged(pa.Table.from_batches(held)).to_batches()


def agreeing(c: np.ndarray, f: np.ndarray, lo: np.ndarray, hi: np.ndarray, enough: int = ENOUGH) -> np.ndarray:
    """Which windows of one text (c ascending) have a passage that contains the minima of `enough` functions' windows, their
    own among them, within all of their ranges. A sweep: minima of one passage are at most AROUND apart."""
    n = len(c)
    found = np.full(n, enough < 2)
    left, right = c + lo, c + hi
    d = 1
    while d < n and not found.all():
        near = np.flatnonzero(c[d:] - c[:-d] <= AROUND)
        if not len(near):
            break
        a, b = near, near + d
        x, y = np.maximum(left[a], left[b]), np.minimum(right[a], right[b])
        ok = (f[a] != f[b]) & (y - x + 1 >= MIN_SHINGLES) & (x <= c[a]) & (y >= c[b])
        found[a[ok]] = found[b[ok]] = True
        d += 1
    return found


CONTEXT = "v bigint, tid bigint, c int, n int, body binary, a int, b int"
_CONTEXT = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with its windows: the surroundings of those to compare (three bytes a shingle; zero beyond the text's
    ends), and in rows with an empty body the spans of shingles that repeat as they stand."""

    def made(some: pa.RecordBatch) -> pa.RecordBatch:
        whole, begin = texts_shingles(some.column("text").to_pylist())
        lists = some.column("windows")
        kept, of = lists.flatten(), np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
        v, f, lo, hi, exact, n = (kept.field(k).to_numpy(zero_copy_only=False) for k in ("v", "f", "lo", "hi", "exact", "n"))
        c = kept.field("c").to_numpy() + begin[of]
        turn = np.argsort(c, kind="stable")
        v, f, c, lo, hi, exact, n, of = (x[turn] for x in (v, f, c, lo, hi, exact, n, of))
        tid = some.column("tid").to_numpy()
        a, b = merged(np.maximum(begin[of[exact]], c[exact] - AROUND), np.minimum(begin[of[exact] + 1] - AROUND, c[exact] + AROUND + 1))
        in_text = np.searchsorted(begin, a, side="right") - 1
        go = (n > 0) & (f < FUNCTIONS - ENOUGH + 1) & agreeing(c, f, lo.astype(np.int64), hi.astype(np.int64))
        marks = np.where(whole > 0, whole >> np.uint64(40) | np.uint64(1), np.uint64(0)).astype("<u4")
        bodies = marks.view(np.uint8).reshape(-1, 4)[:, :3][c[go][:, None] + np.arange(-AROUND, AROUND + 1)]
        k, m = int(go.sum()), len(a)
        offsets = np.concatenate([np.arange(k + 1), np.full(m, k)]).astype(np.int32) * (3 * WIDTH)
        body = pa.Array.from_buffers(pa.binary(), k + m, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bodies))])
        own = tid[of[go]], tid[in_text]
        none = np.zeros(m, np.int32)
        columns = [
            np.concatenate([v[go], own[1] * np.int64(0x9E3779B9)]), np.concatenate(own), np.concatenate([(c - begin[of])[go].astype(np.int32), none]), np.concatenate([n[go], none]),
            body, *(np.concatenate([np.zeros(k, np.int32), (x - begin[in_text]).astype(np.int32)]) for x in (a, b)),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _CONTEXT, strict=True)], ["v", "tid", "c", "n", "body", "a", "b"])

    for batch in batches:
        held, first = 0, 0
        for k, text in enumerate(batch.column("text")):
            held += len(text.as_buffer())
            if held > 1 << 20 or k + 1 == len(batch):
                yield made(batch.slice(first, k + 1 - first))
                held, first = 0, k + 1


_PLACES = np.uint64(1) << np.arange(MIN_SHINGLES, dtype=np.uint64)


def _within(hit: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Places in passages that hit (by first place), from where a run of them first agrees to where it last does."""
    n = np.cumsum(np.pad(hit, ((0, 0), (1, WIDTH - hit.shape[1]))), axis=1, dtype=np.int16)
    inside = n[:, 1:] - np.pad(n, ((0, 0), (MIN_SHINGLES, 0)))[:, 1 : WIDTH + 1] > 0
    places, out = np.arange(WIDTH, dtype=np.int16), inside
    for way in (slice(None), slice(None, None, -1)):
        i, m = inside[:, way], agree[:, way] & inside[:, way]
        begins = np.maximum.accumulate(np.where(i & ~np.pad(i, ((0, 0), (1, 0)))[:, :-1], places, -1), axis=1)
        out = out & (np.maximum.accumulate(np.where(m, places, -1), axis=1) >= begins)[:, way]
    return out


def similar_passages(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """For rows of surroundings a and b (WIDTH shingles with the same one in the middle): the rows with similar passages;
    which of the passages of a and of b, by their first place, are similar to one of the other (booleans, rows x
    MIN_SHINGLES); and the places of a and of b in those, from where they first agree to where they last do.

    With 41 of 46 shingles in common, what is inserted or left out is one word: places differ by one at most."""
    m = MIN_SHINGLES
    same = (a == b) & (a > 0)
    up, down = np.zeros_like(same), np.zeros_like(same)
    up[:, :-1] = (a[:, :-1] == b[:, 1:]) & (a[:, :-1] > 0) & ~same[:, :-1] & ~same[:, 1:]
    down[:, 1:] = (a[:, 1:] == b[:, :-1]) & (a[:, 1:] > 0) & ~same[:, 1:] & ~same[:, :-1]
    able = np.flatnonzero(np.count_nonzero(same, 1) + np.count_nonzero(up, 1) + np.count_nonzero(down, 1) >= AGREE)
    same, up, down = same[able], up[able], down[able]
    s, u, d = (np.concatenate([np.zeros((len(able), 1), np.int16), np.cumsum(x, 1, dtype=np.int16)], 1) for x in (same, up, down))
    whole_a, whole_b = ((x[able, :m] > 0) & (x[able, m - 1 :] > 0) for x in (a, b))

    def between(x: np.ndarray, first: int, last: int, count: int) -> np.ndarray:
        """Of each passage, from its place `first` to its place `last`."""
        return x[:, last + 1 : last + 1 + count] - x[:, first : first + count]

    got_a, got_b = np.zeros((len(able), m), bool), np.zeros((len(able), m), bool)
    level = (between(s, 0, m - 1, m) + between(u, 0, m - 2, m) + between(d, 1, m - 1, m) >= AGREE) & whole_a & whole_b
    got_a |= level
    got_b |= level
    later = (between(s, 1, m - 1, m - 1) + between(u, 0, m - 1, m - 1) + between(d, 2, m - 1, m - 1) >= AGREE) & whole_a[:, :-1] & whole_b[:, 1:]
    got_a[:, :-1] |= later
    got_b[:, 1:] |= later
    s, u, d = s[:, 1:], u[:, 1:], d[:, 1:]  # passages of a from place 1 with those of b from place 0
    sooner = (between(s, 0, m - 2, m - 1) + between(u, 0, m - 3, m - 1) + between(d, 0, m - 1, m - 1) >= AGREE) & whole_a[:, 1:] & whole_b[:, :-1]
    got_a[:, 1:] |= sooner
    got_b[:, :-1] |= sooner
    some = np.flatnonzero(got_a.any(1))
    got_a, got_b, same, up, down = (x[some] for x in (got_a, got_b, same, up, down))
    in_b = same.copy()
    in_b[:, 1:] |= up[:, :-1]
    in_b[:, :-1] |= down[:, 1:]
    return able[some], got_a, got_b, _within(got_a, same | up | down), _within(got_b, in_b)


class Comparison:
    """The windows of one or more hashes: surroundings x, texts and places; covered has a bit for each of the passages of a
    window (by first place) that has a similar one, shown for each of the places that are repeated."""

    def __init__(self, x: np.ndarray, tid: np.ndarray, c: np.ndarray):
        self.x, self.tid, self.c = x, tid, c
        self.covered = np.zeros(len(x), np.uint64)
        self.shown = np.zeros((len(x), 2), np.uint64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compares windows a with windows b. Copies within a text must not overlap."""
        for k in range(0, len(a), 8192):
            i, j = a[k : k + 8192], b[k : k + 8192]
            apart = (self.tid[i] != self.tid[j]) | (np.abs(self.c[i] - self.c[j]) >= MIN_SHINGLES)
            i, j = i[apart], j[apart]
            able, hit_i, hit_j, seen_i, seen_j = similar_passages(self.x[i], self.x[j])
            for at, hit, seen in ((i[able], hit_i, seen_i), (j[able], hit_j, seen_j)):
                np.bitwise_or.at(self.covered, at, hit @ _PLACES)
                np.bitwise_or.at(self.shown[:, 0], at, seen[:, :MIN_SHINGLES] @ _PLACES)
                np.bitwise_or.at(self.shown[:, 1], at, seen[:, MIN_SHINGLES:] @ _PLACES[: WIDTH - MIN_SHINGLES])

    def small(self, first: np.ndarray, size: np.ndarray) -> None:
        """All with all, of groups of neighbouring rows."""
        for n in np.unique(size):
            at = first[size == n]
            x, y = np.triu_indices(int(n), 1)
            step = max(1, 200_000 // len(x))
            for k in range(0, len(at), step):
                some = at[k : k + step, None]
                self.pairs((some + x).ravel(), (some + y).ravel())

    def _asking(self, rows: np.ndarray) -> np.ndarray:
        """Bits of the passages without a similar one."""
        x = self.x[rows]
        return (((x[:, :MIN_SHINGLES] > 0) & (x[:, MIN_SHINGLES - 1 :] > 0)) @ _PLACES) & ~self.covered[rows]

    def crowd(self, rows: np.ndarray) -> None:
        """Rows of one hash, however many; what most others resemble should come first."""
        self.pairs(rows[1:], np.full(len(rows) - 1, rows[0]))
        shingle, back = np.unique(self.x[rows], return_inverse=True)
        back = back.reshape(len(rows), WIDTH)
        count = np.bincount(back.ravel(), minlength=len(shingle))
        turn = np.argsort(count, kind="stable")
        rank = np.empty(len(turn), np.int32)
        rank[turn] = np.arange(len(turn))
        shared = int(np.searchsorted(count[turn], 2))  # ranks from here on occur twice
        entries = []  # rank, row, first place of a passage of the row that has it among its RARE least
        for k in range(0, len(rows), 1024):
            ranks = rank[back[k : k + 1024]]
            passages = np.lib.stride_tricks.sliding_window_view(ranks, MIN_SHINGLES, axis=1)
            least = np.partition(passages, RARE - 1, axis=2)[:, :, :RARE]
            whole = (self.x[rows[k : k + 1024], :MIN_SHINGLES] > 0) & (self.x[rows[k : k + 1024], MIN_SHINGLES - 1 :] > 0)
            row, place, at = np.nonzero((least >= shared) & whole[:, :, None])
            entries.append(np.stack([least[row, place, at].astype(np.int64), row + k, place]))
        key, row, place = np.concatenate(entries, axis=1)
        turn = np.lexsort((row, key))
        key, row, place = key[turn], row[turn], place[turn]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        if not len(starts):
            return
        bits = np.bitwise_or.reduceat(_PLACES[place], starts)
        key, row = key[starts], rows[row[starts]]
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                self._in_turn(row[a:b], bits[a:b])

    def _in_turn(self, rows: np.ndarray, bits: np.ndarray) -> None:
        """Compares the rows of which a passage in bits asks for a similar one with all of rows, one after the other."""
        for k in range(len(rows)):
            asking = rows[(bits & self._asking(rows)) > 0] if k % 16 == 0 or len(asking) > SMALL else asking
            if not len(asking):
                return
            if len(asking) <= SMALL:
                a, b = np.repeat(asking, len(rows) - k), np.tile(rows[k:], len(asking))
                self.pairs(a[a != b], b[a != b])
                return
            others = asking[asking != rows[k]]
            self.pairs(others, np.full(len(others), rows[k]))

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """tid, first shingle and the one after the last of what is repeated."""
        some = np.flatnonzero(self.covered)
        bits = np.concatenate([(self.shown[some, k, None] & _PLACES) > 0 for k in range(2)], axis=1)[:, :WIDTH]
        edge = np.diff(np.pad(bits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        begin = self.c[some[row]] - AROUND
        return self.tid[some[row]], begin + first, begin + end


SPAN = "tid bigint, a int, b int"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by v and falling n."""

    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        v, tid, c = (rows.column(k).to_numpy() for k in ("v", "tid", "c"))
        raw = np.frombuffer(pa.concat_arrays(rows.column("body").chunks).cast(pa.binary(3 * WIDTH)).buffers()[1], np.uint8)[: len(v) * WIDTH * 3].reshape(len(v), WIDTH, 3)
        x = np.zeros((len(v), WIDTH), np.uint32)
        for k in range(3):
            x |= raw[:, :, k].astype(np.uint32) << np.uint32(8 * k)
        comparison = Comparison(x, tid, c.astype(np.int64))
        first = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
        size = np.diff(np.concatenate([first, [len(v)]]))
        few = (size <= SMALL) & (size > 1)
        comparison.small(first[few], size[few])
        for k in np.flatnonzero(size > SMALL):
            comparison.crowd(np.arange(first[k], first[k] + size[k]))
        tid, a, b = comparison.spans()
        return pa.RecordBatch.from_arrays([pa.array(tid), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["tid", "a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        plain = pc.equal(pc.binary_length(batch.column("body")), 0)
        yield batch.filter(plain).select(["tid", "a", "b"])
        batch = batch.filter(pc.invert(plain))
        if not len(batch):
            continue
        v = batch.column("v").to_numpy()
        last = int(np.searchsorted(v, v[-1]))
        if (last or held and held[-1].column("v")[0].as_py() != v[-1]) and sum(map(len, held)) + last:
            yield spans([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield spans(held)


def repeated_passages(numbered: DataFrame) -> DataFrame:
    """tid, a, b (arrays of first words and words after the last) of the texts of numbered (tid, text) that repeat passages."""
    members = written(numbered.mapInArrow(_windows, WINDOW).repartition("v").sortWithinPartitions("v", "ctx").mapInArrow(_members, MEMBER), "passage-members")
    _release()
    windows = members.groupBy("tid").agg(F.collect_list(F.struct("v", "f", "c", "lo", "hi", "exact", "n")).alias("windows"))
    contexts = windows.join(numbered, "tid").mapInArrow(_contexts, CONTEXT)
    spans = written(contexts.repartition("v").sortWithinPartitions("v", F.desc("n"), "tid", "c").mapInArrow(_compare, SPAN), "passage-spans")
    discard(members)
    _release()
    return spans.groupBy("tid").agg(F.collect_list("a").alias("a"), F.collect_list(F.col("b") + SHINGLE - 1).alias("b"))


RESULT = "doc_id bigint, n_words bigint, n_repeated bigint, n_spans bigint, spans array<struct<start: int, end: int>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for row in range(len(batch)):
            a, b = (np.array(batch.column(k)[row].as_py(), np.int64) for k in ("a", "b"))
            turn = np.argsort(a, kind="stable")
            a, b = merged(a[turn], b[turn])
            n = len(batch.column("text")[row].as_py().split())
            for column, value in zip(out, (batch.column("doc_id")[row].as_py(), n, int((b - a).sum()), len(a), [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_words", "n_repeated", "n_spans", "spans"])


def near_duplicate_passages(docs: DataFrame) -> DataFrame:
    """RESULT, a row for every row of docs (doc_id, text) that repeats a passage: its maximal runs of repeated words
    (start, and end after the last word)."""
    with batch_rows(docs.sparkSession, 500):
        numbered = written(docs.select(F.monotonically_increasing_id().alias("tid"), "doc_id", text_or_empty().alias("text")), "passage-texts")
        found = written(numbered.join(repeated_passages(numbered.select("tid", "text")), "tid").mapInArrow(_spans, RESULT), "passages")
        discard(numbered)
    return found
