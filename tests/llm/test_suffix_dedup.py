import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffix_dedup as sd

DOCS = "doc_id bigint, text string, tid string, key int"


def _brute(rows, width=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def _rows(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["lorem", "é", "Ñu", "ab", "x" * r.randint(1, 9), "日本", str(r.randint(0, 99999))])
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (40, 90, 100, 150, 300)]
    rows = []
    for k in range(60):
        text = prose(r.randint(0, 250))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            text += r.choice(["", " ", "\n"]) + p[a : a + r.randint(200, 900)] + prose(r.randint(0, 40))
        rows.append((k, text))
    base = rows[3][1] + prose(200)
    rows += [(100 + k, base) for k in range(12)] + [(200 + k, base[: 500 + k] + str(k) + base[500 + k :]) for k in range(12)]
    return rows


EDGE = [
    (1, "a" * 399), (2, "a" * 400), (3, "b" * 400), (4, "b" * 401), (5, "ab" * 900), (None, None), (6, ""), (6, "z" * 30000), (7, "c" * 400), (7, "c" * 400),
    (8, "line of text\n" * 500), (9, "x" + "c" * 399), (None, "c" * 399 + "y"), (10, "\0" * 450), (11, "é" * 250),
]


@pytest.mark.parametrize("rows", [_rows(1), EDGE, [], [(1, "short")]])
def test_removal_equals_brute_force(spark, rows):
    got = sd.remove_repeats(spark.createDataFrame([(*x, "extra", 1) for x in rows], DOCS).repartition(4)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == _brute(rows)


def test_planted_passages_go_and_clean_texts_stay(spark):
    """By n_removed, spans and the flag: passages of 400 bytes and more that stand in several texts, in new surroundings."""
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choices(["ka", "lo", "mi", "ta", "re", "sun"], k=r.randint(1, 4))) for _ in range(n))
    passages = [prose(n) for n in (70, 90, 120, 200)]
    rows, planted = [], {}
    for k in range(160):
        before, after = prose(r.randint(0, 150)) + " ", " " + prose(r.randint(0, 150))
        p = passages[k // 2 % 4] if k % 2 else ""
        rows.append((k, before + p + after))
        if p:
            assert len(p) >= 400
            planted[k] = (len(before), len(before) + len(p))
    got = {x.doc_id: x for x in sd.remove_repeats(spark.createDataFrame([(*x, "e", 1) for x in rows], DOCS)).collect()}
    for k, x in got.items():
        assert x.repeats == (x.n_removed > 0) == (k in planted) and x.n_spans == len(x.removed)
        if k in planted:
            (s,), (a, b) = x.removed, planted[k]
            assert a - 30 <= s.start <= a and b <= s.end <= b + 30 and x.n_removed == s.end - s.start


def test_hot_hashes_take_the_exact_other_way(spark, monkeypatch):
    rows = _rows(2)
    monkeypatch.setattr(sd, "HOT_BYTES", 3000)
    got = sd.remove_repeats(spark.createDataFrame([(*x, "extra", 1) for x in rows], DOCS)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == _brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    r = np.random.default_rng(seed)
    unit = r.integers(97, 97 + 1 + seed, 60)
    raw = np.concatenate([r.integers(97, 97 + 1 + seed, 900), unit, unit, r.integers(97, 100, 90), np.repeat(98, 150), unit, [sd.END]]).astype(np.uint8)
    h = sd._doubled(raw, 256)
    order = sd.suffix_array(raw, h, 400)
    assert sorted(order.tolist()) == list(range(len(raw)))
    body = raw.tobytes()
    got = [body[k : k + 400] for k in order]
    assert all(a <= b for a, b in zip(got, got[1:], strict=False))
    shared = sd.common_prefixes(order, h, 400)
    for k in range(1, len(order)):
        a, b = body[order[k - 1] :], body[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == n or min(shared[k], n) >= 400


def test_equal_windows_meet():
    r = np.random.default_rng(3)
    passage = r.integers(97, 123, 405).astype(np.uint8).tobytes()
    texts = [r.integers(97, 123, 300).astype(np.uint8).tobytes() + passage + r.integers(97, 123, 250).astype(np.uint8).tobytes() for _ in range(3)]
    owner, start, size, key, _, _ = sd.segments(texts)
    for k in range(6):
        keys = {int(key[j]) for t in range(3) for j in range(len(owner)) if owner[j] == t and start[j] <= 300 + k <= start[j] + size[j] - 400}
        assert len(keys) == 1
