"""Hashes of the words of texts, many at a time and without a table of words."""

from __future__ import annotations

import numpy as np
import xxhash

_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 21) for b in range(256)], np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1024)], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PIECE, _STEP = 1 << 20, 1 << 15


def _powers(base: int, count: int) -> np.ndarray:
    found = np.full(count, base, np.uint64)
    found[0] = 1
    return np.cumprod(found)


_UP, _DOWN = _powers(0x9E3779B97F4A7C15, 2 * _STEP), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), 2 * _STEP)


def _hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of raw, which are what lies between bytes up to 32; and where each begins."""
    inside = raw > 32
    edges = np.flatnonzero(np.concatenate([inside[:1], inside[1:] != inside[:-1]]))
    if not len(edges):
        return np.zeros(0, np.uint64), edges
    starts, ends = edges[::2], edges[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(raw))
    if len(raw) <= len(_UP) and (ends - starts).max() <= 1024:
        # the terms of all bytes are summed once; a word's are those up to its end less those before it, moved to power 0
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _UP[: len(raw)])])
        h = (sums[ends] - sums[starts]) * _DOWN[starts]
    else:
        body = raw[inside]
        first = np.cumsum(ends - starts) - (ends - starts)
        at = np.arange(len(body)) - np.repeat(first, ends - starts)
        h = np.add.reduceat(_BYTE[body] * _POWERS[at & 1023], first)
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27)), starts


def bytes_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of parts (words are what lies between bytes up to 32), and how many each part has."""
    found, sizes, k = [], [], 0
    while k < len(parts):
        held, first = 0, k
        while k < len(parts) and (k == first or held + len(parts[k]) < _PIECE):
            held += len(parts[k]) + 1
            k += 1
        raw = np.frombuffer(b"\n".join(parts[first:k]), np.uint8)
        hashes, starts = _pieces(raw)
        cuts = np.cumsum([0, *(len(x) + 1 for x in parts[first:k])])
        sizes.append(np.diff(np.searchsorted(starts, cuts)))
        found.append(hashes)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def _pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, begun, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        end = min(len(raw), at + _STEP)
        while end < len(raw) and raw[end] > 32:  # pieces end between words
            end += 1
        hashes, starts = _hashes(raw[at:end])
        found.append(hashes)
        begun.append(starts + at)
        at = end
    return np.concatenate(found), np.concatenate(begun)


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts (lists of words without white space), and how many each text has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer("\n".join(" ".join(x) for x in texts).encode("utf-8", "surrogatepass"), np.uint8)
    h, _ = _pieces(raw)
    if len(h) != sizes.sum():  # words with control characters
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 22) for x in texts for w in x), np.uint64, int(sizes.sum()))
    return h, sizes
