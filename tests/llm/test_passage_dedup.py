import random

import time
from collections import Counter

import numpy as np
import pytest

from millrace.llm import passage_dedup as pd_

DOCS = "doc_id bigint, text string, tid string, key int"
R = random.Random(8)


def _prose(n):
    return ["".join(R.choices(["ka", "lo", "mi", "ta", "re", "sun"], k=R.randint(1, 5))) for _ in range(n)]


def test_planted_passages_are_found_and_others_are_not(spark):
    passages = [_prose(n) for n in (51, 60, 90, 200)]
    rows, planted = [], {}
    for k in range(120):
        words = _prose(R.choice([0, 20, 120, 400]))
        if k % 4 == 0:
            p = list(passages[k // 4 % 4])
            if k % 8 and len(p) > 80:
                p[len(p) // 2] = "changed"  # five shingles on either side differ
            planted[k] = (len(words), len(words) + len(p))
            words += p + _prose(R.choice([0, 10, 300]))
        rows.append((k, " ".join(words).upper() if k % 3 == 0 else "\n".join(words)))
    twice = _prose(70)
    rows += [(200, " ".join(twice + _prose(90) + twice)), (201, None), (202, ""), (None, rows[4][1]), (203, "again " * 3000)]
    got = pd_.near_duplicate_passages(spark.createDataFrame([(*x, "e", 1) for x in rows], DOCS).repartition(5)).collect()
    found = {r.doc_id: r for r in got}
    assert set(found) - {203} == {*planted, 200, None}
    for k, (a, b) in planted.items():
        assert max(min(s.end, b) - max(s.start, a) for s in found[k].spans) >= 0.9 * (b - a)
        assert found[k].n_repeated <= 1.3 * (b - a) + 10 and k != 4 or k == 4
    assert [(s.start, s.end) for s in found[200].spans] == [(0, 70), (160, 230)]


def test_copies_cover_whole_texts(spark):
    base = _prose(300)
    near = [*base]
    near[150] = "edit"
    rows = [(k, " ".join(base), "", 0) for k in range(40)] + [(50 + k, " ".join([*near, str(k)]), "", 0) for k in range(40)]
    got = pd_.near_duplicate_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 80 and all(r.n_repeated >= 299 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "few words", "", 0)], [(1, None, "", 0), (2, " ".join(_prose(200)), "", 0)]])
def test_nothing_repeats(spark, rows):
    assert pd_.near_duplicate_passages(spark.createDataFrame(rows, DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_the_nodes_of_the_tree(seed):
    r = np.random.default_rng(seed)
    h = r.integers(1, 2**63, 400).astype(np.uint64)
    h[[100, 101, 250]] = 0
    if seed == 4:
        h[300:340] = 5
    got = {(int(a), int(b)): int(c) for a, c, b in zip(*pd_.compact_windows(h, 20), strict=True)}
    want = {}
    for c in range(400):
        if h[c]:
            a = b = c
            while a and h[a - 1] >= h[c]:
                a -= 1
            while b + 1 < 400 and h[b + 1] >= h[c]:
                b += 1
            if b - a + 1 >= 20:
                want.setdefault((a, b), c)
    assert got == want


def _passages(h):
    return [Counter(h[k : k + pd_.MIN_SHINGLES].tolist()) for k in range(len(h) - pd_.MIN_SHINGLES + 1)]


def _jaccard(a, b):
    both = (a & b).total()
    return both / (a.total() + b.total() - both)


def _common(h, i, other):
    """Words of the passage at i from the first to the last shingle that other has too."""
    at = [k for k in range(i, i + pd_.MIN_SHINGLES) if other[int(h[k])]]
    return range(at[0], at[-1] + 5)


def _brute(texts):
    """The words of each text that lie in a passage of 50 words with a similar one elsewhere (every passage with every other),
    between the first and last shingle that both have; and all words of those passages."""
    found, whole = [set() for _ in texts], [set() for _ in texts]
    shingles, m = [pd_.shingles(t) for t in texts], pd_.MIN_SHINGLES
    for t, h in enumerate(shingles):
        for u, g in enumerate(shingles[: t + 1]):
            if min(len(h), len(g)) < m or len(np.intersect1d(h, g)) < 41:
                continue
            same = np.pad(np.cumsum(np.cumsum(h[:, None] == g[None, :], 0), 1), ((1, 0), (1, 0)))
            both = same[m:, m:] - same[:-m, m:] - same[m:, :-m] + same[:-m, :-m]  # shingles in common (none repeats within a passage here)
            for i, j in np.argwhere(both >= 0.8 * (2 * m - both)).tolist():
                if u != t or abs(i - j) >= m:
                    for x, k, other, y, z in ((t, i, u, j, h), (u, j, t, i, g)):
                        found[x].update(_common(z, k, Counter(shingles[other][y : y + m].tolist())))
                        whole[x].update(range(k, k + 50))
    return found, whole


def _edited(words, r, rate):
    out = []
    for w in words:
        if r.random() < rate:
            out += r.choice([["edit" + str(r.randint(0, 9999))], [], [w, "more" + str(r.randint(0, 9999))]])
        else:
            out.append(w)
    return out


def test_repeated_words_equal_brute_force(spark):
    """Recall of at least 0.9 is asked for; nothing may be found that isn't repeated."""
    r = random.Random(31)
    passages = [_prose(n) for n in (50, 52, 60, 75, 100, 180, 300)]
    line = _prose(30)
    texts = []
    for _ in range(130):
        words = _prose(r.choice([0, 5, 60, 200]))
        for _ in range(r.randint(0, 2)):
            words += _edited(r.choice(passages), r, r.choice([0, 0, 0.01, 0.02, 0.05])) + _prose(r.choice([0, 3, 40]))
        texts.append(" ".join(words + (line + _prose(80) if r.random() < 0.5 else [])))
    want, most = _brute(texts)
    got = pd_.near_duplicate_passages(spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts)], DOCS).repartition(7)).collect()
    found = {x.doc_id: {w for s in x.spans for w in range(s.start, s.end)} for x in got}
    assert all(found[k] <= most[k] for k in found)
    hit, total = sum(len(found.get(k, set()) & w) for k, w in enumerate(want)), sum(map(len, want))
    print(f"recall {hit / total:.4f} of {total} words; texts {len(found)} of {sum(map(bool, want))}")
    assert total > 5000 and hit >= 0.97 * total


def test_every_text_of_a_large_group_is_found_by_the_crowd(spark):
    """Many texts share a line (no passage), some of them a passage around it, in families; against all with all."""
    r = random.Random(5)
    line, families = _prose(35), [_prose(25) for _ in range(25)]
    texts = []
    for k in range(300):
        texts.append(" ".join(_prose(60) + _edited(line + families[k // 2 % 25], r, 0.01 if k % 3 else 0) + _prose(60)) if k < 100 else " ".join(_prose(70) + line + _prose(70)))
    texts += [" ".join(_edited(_prose_of(7, 120), r, 0.03)) for _ in range(150)]
    x, tid, c = [], [], []
    common = pd_.shingles(" ".join(line))[15], pd_.shingles(" ".join(_prose_of(7, 120)))[60]
    for k, t in enumerate(texts):
        h = np.pad((pd_.shingles(t) >> np.uint64(40)).astype(np.uint32) | np.uint32(1), pd_.AROUND)
        for at in np.flatnonzero(np.isin(pd_.shingles(t), common)):
            x.append(h[at : at + pd_.WIDTH])
            tid.append(k)
            c.append(at)
    one, other = (pd_.Comparison(np.array(x), np.array(tid), np.array(c)) for _ in range(2))
    one.small(np.array([0]), np.array([len(x)]))
    other.crowd(np.arange(len(x)))
    assert one.covered.any() and ((one.covered > 0) == (other.covered > 0)).all()
    assert (one.covered == other.covered).all()


def _prose_of(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(["ka", "lo", "mi", "ta", "re", "sun"], k=r.randint(2, 5))) for _ in range(n)]


def _covered(a, b):
    """Places of a's words in passages similar to one of b, by all surroundings of shared shingles."""
    x, y = pd_.shingles(" ".join(a)), pd_.shingles(" ".join(b))
    p, q = (np.pad((h >> np.uint64(40)).astype(np.uint32) | np.uint32(1), pd_.AROUND) for h in (x, y))
    pairs = [(i, j) for i in range(len(x)) for j in np.flatnonzero(y == x[i]).tolist()]
    rows = np.array([[p[i : i + pd_.WIDTH], q[j : j + pd_.WIDTH]] for i, j in pairs])
    able, _, _, seen, _ = pd_.similar_passages(rows[:, 0], rows[:, 1])
    return {w for n, h in zip(able, seen, strict=True) for k in np.flatnonzero(h).tolist() for w in range(pairs[n][0] - pd_.AROUND + k, pairs[n][0] - pd_.AROUND + k + 5)}


@pytest.mark.parametrize("every", [28, 30, 35])
def test_an_exact_run_among_edits_is_found(every):
    a = _prose(680)
    b = [x if k % every or 300 <= k < 399 else f"edit{k}" for k, x in enumerate(a)]
    assert set(range(350, 449)) <= _covered(_prose(50) + a + _prose(50), _prose(80) + b + _prose(20))


@pytest.mark.parametrize("seed", range(8))
def test_similar_passages_equal_brute_force(seed):
    r = random.Random(seed)
    a = _prose_of(seed, 110)
    b = _edited(a, r, 0.02)
    h = pd_.shingles(" ".join(a))
    own, others = _passages(h), _passages(pd_.shingles(" ".join(b)))
    alike = [(i, q) for i, p in enumerate(own) for q in others if _jaccard(p, q) >= 0.8]
    assert {w for i, q in alike for w in _common(h, i, q)} <= _covered(a, b) <= {w for i, _ in alike for w in range(i, i + 50)}


@pytest.mark.parametrize(("n", "at"), [(55, 10), (55, 5), (60, 12), (65, 15), (50, 3), (50, 46), (51, 4)])
def test_a_changed_word_near_the_end_of_a_short_passage(n, at):
    a = _prose(n)
    found = _covered(_prose(100) + a + _prose(100), _prose(60) + a[:at] + ["edit"] + a[at + 1 :] + _prose(90))
    first, last = (at + 1 if at < 5 else 0), (at if at > n - 6 else n)
    assert found == set(range(100 + first, 100 + last))


@pytest.mark.parametrize(("n", "gap"), [(60, 0), (60, 5), (200, 40), (500, 100)])
def test_copies_side_by_side_in_one_text(spark, n, gap):
    p = _prose(n)
    row = (1, " ".join(_prose(30) + p + _prose(gap) + p + _prose(40)), "", 0)
    spans = pd_.near_duplicate_passages(spark.createDataFrame([row], DOCS)).collect()[0].spans
    ends = [(30, 30 + 2 * n)] if gap == 0 else [(30, 30 + n), (30 + n + gap, 30 + 2 * n + gap)]
    assert [(s.start, s.end) for s in spans] == ends


def test_long_texts_take_time_in_proportion():
    """The interval join is a sweep, whatever the text's length."""
    r = np.random.default_rng(1)
    took = []
    for n in (50_000, 400_000):
        c = np.sort(r.integers(0, 23 * n // 4, n))
        began = time.perf_counter()
        pd_.agreeing(c, r.integers(0, 4, n), -r.integers(20, 45, n), r.integers(20, 45, n))
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1
