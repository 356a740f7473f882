"""Dictionary segmentation: words of a text without spaces, by the best path through the graph of dictionary words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most words that go to the workers with the plan.
MAX_WORDS = 1_000_000
_RUNS = re.compile(r"[^\W_]+")


class Dictionary:
    """Words with counts. A word's weight is the integer part of a million times ln(count / all counts), so that sums are
    exact; a character that is no word weighs as a word of count 1."""

    def __init__(self, counts: Mapping[str, int]):
        if len(counts) > MAX_WORDS:
            raise ValueError(f"more than {MAX_WORDS} words")
        total = max(1, sum(counts.values()))
        self.unknown = math.floor(1e6 * math.log(1 / total))
        self.weight = {w: math.floor(1e6 * math.log(n / total)) for w, n in counts.items() if w and n > 0}
        self.longest = max(map(len, self.weight), default=1)

    def words(self, run: str) -> list[list[int]]:
        """The ends of the dictionary words from each place, a single character always being one."""
        return [[b for b in range(a + 1, min(len(run), a + self.longest) + 1) if b == a + 1 or run[a:b] in self.weight] for a in range(len(run))]

    def best(self, run: str) -> list[str]:
        """The path of the greatest weight; of equal ones that with the longer word first."""
        ends, score, to = self.words(run), [0] * (len(run) + 1), [0] * len(run)
        for a in reversed(range(len(run))):
            score[a], to[a] = max((self.weight.get(run[a:b], self.unknown) + score[b], b) for b in ends[a])
        out, a = [], 0
        while a < len(run):
            out.append(run[a : to[a]])
            a = to[a]
        return out

    def full(self, run: str) -> list[str]:
        """All dictionary words of more than one character, by place and length; a character that lies in none is one itself."""
        out, covered = [], 0
        for a, ends in enumerate(self.words(run)):
            longer = [b for b in ends if b > a + 1]
            out += [run[a:b] for b in longer] or ([run[a]] if a >= covered else [])
            covered = max([covered, *longer])
        return out

    def search(self, run: str) -> list[str]:
        """The best path, each word after the dictionary words of two and of three characters inside it."""
        out = []
        for w in self.best(run):
            for n in (2, 3):
                if len(w) > n:
                    out += [w[k : k + n] for k in range(len(w) - n + 1) if w[k : k + n] in self.weight]
            out.append(w)
        return out


def segmented(text: Column, dictionary: Dictionary, mode: str = "accurate") -> Column:
    """The words of a text, null as the empty one, in lower case: runs of letters and digits are segmented, all else parts
    them. mode: accurate, full or search."""
    cut = {"accurate": dictionary.best, "full": dictionary.full, "search": dictionary.search}[mode]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[w for part in _RUNS.findall(t.lower()) for w in cut(part)] for t in texts])

    return run(F.coalesce(text, F.lit("")))
