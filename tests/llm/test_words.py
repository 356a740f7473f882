import itertools
import random

import numpy as np

from millrace.llm.words import bytes_hashes, word_hashes


def test_different_words_have_different_hashes():
    words = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product(["ka", "lo", "mi", "ta", "re", "sun", "ñ", "日"], repeat=n)]
    words += ["x" * k for k in range(2, 2000)] + [str(k) for k in range(100_000)]
    h, sizes = word_hashes([words, [], words[::-1], [""[:0] or "one"]])
    assert sizes.tolist() == [len(words), 0, len(words), 1]
    assert (h[: len(words)] == h[len(words) : 2 * len(words)][::-1]).all()
    assert len(np.unique(h[: len(words)])) == len(set(words))
    assert len(np.unique(h[: len(words)] >> np.uint64(40))) > 0.98 * len(set(words))


def test_parts_are_counted_alike_in_any_company():
    r = random.Random(3)
    parts = [" ".join("w" * r.randint(1, 9) for _ in range(r.choice([0, 1, 5, 3000]))).encode() + r.choice([b"", b" ", b"\n"]) for _ in range(300)]
    parts += [b"long " * 500_000, b"", b" \t\n", b"x" * 3_000_000]
    h, sizes = bytes_hashes(parts)
    assert sizes.tolist() == [len(p.split()) for p in parts] and len(h) == sizes.sum()
    ends = np.cumsum(sizes)
    for k in r.sample(range(len(parts)), 40):
        assert (bytes_hashes([parts[k]])[0] == h[ends[k] - sizes[k] : ends[k]]).all()


def test_hashes_are_the_sums_of_their_bytes_across_pieces():
    import numpy as np

    from millrace.llm import words as w

    parts = [b"a bc ", b"", b"x" * 1024, b"y" * 1025 + b"\tz", b"q " * w._STEP, b"k" * 3 * w._STEP + b" e"]
    h, sizes = bytes_hashes(parts)
    assert sizes.tolist() == [2, 0, 1, 2, w._STEP, 2]
    found = [x for part in parts for x in part.split()]
    for word in {found[k]: k for k in range(len(found))}.values():
        raw = np.frombuffer(found[word], np.uint8)
        want = (w._BYTE[raw] * w._POWERS[np.arange(len(raw)) & 1023]).sum(dtype=np.uint64, keepdims=True)
        want = (want ^ (want >> np.uint64(30))) * w._MIX
        assert h[word] == want ^ (want >> np.uint64(27))
