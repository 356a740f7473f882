import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import graph, simhash

DOCS = "doc_id bigint, text string, fp string, fingerprint int"


def _brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def _roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _brute(rows):
    fps = [_brute_fp(t) for _, t in rows]
    roots = _roots(range(len(rows)), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[roots[k]] = min(i, first.get(roots[k], i))
    return sorted(((i, f"{fps[k]:016x}", first.get(roots[k])) for k, (i, _) in enumerate(rows)), key=repr)


def _rows(seed):
    r, rows = random.Random(seed), []
    for base in range(12):
        words = [r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 40)) for _ in range(r.choice([1, 2, 3, 30, 300]))]
        for _ in range(r.choice([1, 2, 8])):
            own = list(words)
            if r.random() < 0.7:
                own[r.randrange(len(own))] = "Edit"
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    return rows + [(None, None), (0, ""), (0, " \n"), (5, "Same Words Here"), (5, "same words\there"), (None, "same words here"), (9, "é x É"), (7, "w " * 70000), (None, "only null ids zzz")]


@pytest.mark.parametrize("rows", [_rows(1), _rows(2), []])
def test_groups_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*x, "extra", 1) for x in rows], DOCS)
    got = sorted((tuple(r) for r in simhash.near_groups(docs).collect()), key=repr)
    assert got == _brute(rows)


def test_codes_are_perfect():
    assert simhash._golay_homes().min() == 0 and (np.bincount(simhash._golay_homes()) == 2048).all()
    assert simhash._hamming_homes().min() == 0 and (np.bincount(simhash._hamming_homes()) == 8).all()


def test_all_links_within_three_bits_are_kept(spark):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for x in list(fps)[:60]:
        for _ in range(6):
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {1 << a | 1 << b for a in range(12) for b in range(a)}  # a dense crowd
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(3))
    found = [(a, b) for a, b in links.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)
    want = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert _roots(signed, found) == _roots(signed, want)
    assert len(found) < 20 * len(fps)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(50)], [(random.Random(1).randrange(80), random.Random(k).randrange(80)) for k in range(70)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges for x in e}
    assert {n: got.get(n, n) for n in nodes} == _roots(nodes, edges)
