"""Tokens, keyword filters and highlighting as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
MAX_WORD = 15


def tokens(c: Column) -> Column:
    """Lower-cased words in order. A dictionary segmenter would take this function's place."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def analyzed(c: Column, stop: Sequence[str] = (), *, longest: int = MAX_WORD, truncate_at_long_token: bool = False) -> Column:
    """Index terms: tokens without long words and stop words. truncate_at_long_token drops all after the first long word."""
    found = tokens(c)
    if truncate_at_long_token:
        long_at = F.array_position(F.transform(found, lambda w: F.length(w) > longest), True)
        found = F.when(long_at > 0, F.slice(found, F.lit(1), (long_at - 1).cast("int"))).otherwise(found)
    return F.filter(found, lambda w: (F.length(w) <= longest) & ~w.isin(*[x.lower() for x in stop]) if stop else F.length(w) <= longest)


def query_terms(text: str) -> list[str]:
    """Distinct terms of a query, on the driver; one character stays as it is. No stop or length filter."""
    if len(text) <= 1:
        return [text] if text else []
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W_]+", text)))


def counted_words(c: Column, longest: int = 15) -> Column:
    """Distinct words of 2 to longest - 1 characters."""
    return F.filter(F.array_distinct(tokens(c)), lambda w: (F.length(w) > 1) & (F.length(w) < longest))


def contains_keyword(c: Column, words: Sequence[str], mode: str = "greedy") -> Column:
    """Whether a text holds one of words; false for null.

    greedy: at each character that begins a word, the longest run of characters that occur inside words must be a
    word itself (with ab and xc, "abc" holds none). substring: any occurrence counts."""
    words = [w for w in words if w]
    if not words:
        return F.lit(False)
    text = F.coalesce(c, F.lit(""))
    if mode == "substring":
        return text.rlike("|".join(map(re.escape, words)))
    each = lambda chars: "".join(f"\\x{{{ord(x):x}}}" for x in sorted(set(chars)))
    heads, inner = each(w[0] for w in words), each(x for w in words for x in w[1:])
    # a run longer than the longest word is none, so it needn't be read to its end: one pass over the text
    run = f"[{heads}][{inner}]{{0,{max(map(len, words))}}}" if inner else f"[{heads}]"
    return F.arrays_overlap(F.regexp_extract_all(text, F.lit(f"(?=({run}))"), F.lit(1)), F.array(*map(F.lit, words)))


def positioned(c: Column, words: Column) -> Column:
    """(start, end, word) of all occurrences of words in a text, overlapping ones too, sorted by start, then end, each once.
    A word costs one pass: the text is cut before each of its occurrences, and the lengths of the pieces are added up."""
    low = F.lower(c)

    def places(w: Column) -> Column:
        quoted = F.concat(F.lit("(?=\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
        starts = F.aggregate(
            F.split(low, quoted),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
            lambda acc, piece: F.struct((acc["at"] + F.length(piece)).alias("at"), F.when((acc["at"] > 0) | F.startswith(low, w), F.array_append(acc["found"], acc["at"])).otherwise(acc["found"]).alias("found")),
        )["found"]
        return F.transform(starts, lambda a: F.struct(a.alias("start"), (a + F.length(w)).alias("end"), w.alias("word")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), places))))


def maximal(found: Column) -> Column:
    """Tokens (start, end, word) that no other token covers."""
    return F.filter(found, lambda t: ~F.exists(found, lambda u: (u != t) & (u["start"] <= t["start"]) & (u["end"] >= t["end"])))


PRE, POST = "<span class='highlight'>", "</span>"


def highlight(c: Column, words: Column) -> Column:
    """Text with its maximal keyword tokens marked; a token that overlaps the one before it keeps only what follows that."""
    parts = F.aggregate(
        maximal(positioned(c, words)),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, t: F.struct(
            F.greatest(acc["at"], t["end"]).alias("at"),
            F.concat(acc["out"], F.substring(c, acc["at"] + 1, F.greatest(F.lit(0), t["start"] - acc["at"])), F.lit(PRE), F.substring(c, F.greatest(acc["at"], t["start"]) + 1, F.greatest(F.lit(0), t["end"] - F.greatest(acc["at"], t["start"]))), F.lit(POST)).alias("out"),
        ),
    )
    return F.concat(parts["out"], F.substring(c, parts["at"] + 1, F.length(c)))
