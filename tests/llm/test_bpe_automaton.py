import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe_automaton

def each(encoder, texts):
    """The ids of each text."""
    ids, counts = encoder.texts(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "Hello, WORLD's  end\n\n x", "señor ÑANDÚ été", "日本語 text", "<|endoftext|> in<|startoftext|>side<|endof", "word " * 20000, "x" * 5000, "é!" * 3000, "same", "same", "Σίσυφος İstanbul ẞ", "a\x1cb\x85c　d e", "\x00\x01 \x7f", "é ą́"]


@pytest.fixture(scope="module")
def automaton():
    return bpe_automaton.Automaton(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder(automaton):
    return bpe_automaton.Encoder(automaton)


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(list("aabbceehlnost'<|>. \n\t,!12éÀσΣ\x1c\x85　́")), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_are_the_librarys(encoder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert each(encoder, [text, text + " " + text]) == [want, want + want]


def test_words_of_every_length_and_runs(encoder, library):
    random.seed(2)
    texts = ["".join(random.choice("abeinrst") for _ in range(n)) for n in range(1, 200)] + [c * n for c in "aehot!" for n in range(1, 90)]
    for text, ids in zip(texts, each(encoder, texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_the_automaton_reads_only_what_the_merges_give(automaton, library):
    """Pairs of tokens: an arc after the first is there just if the library splits both together like that."""
    random.seed(3)
    labels = {k: x for k, x in enumerate(automaton.labels) if x.isascii() and x.isalpha()}
    for _ in range(3000):
        a, b = random.choice(list(labels)), random.choice(list(labels))
        at = automaton.state_of[a]
        inner = [automaton.labels.index("q</w>")]  # so that b isn't the word's end
        want = library.model.tokenize(labels[a] + labels[b] + "q")
        got = [x.id for x in want][:-1] == [a, b] and [x.id for x in want][-1:] == inner
        if got:
            assert automaton.arcs[at, b >> 3] >> (b & 7) & 1
        if not automaton.arcs[at, b >> 3] >> (b & 7) & 1:
            assert [x.id for x in want][:2] != [a, b]


def test_a_small_vocabulary_against_merging_by_hand(tmp_path):
    vocab = ["a", "b", "a</w>", "b</w>", "aa", "ab", "aaaa", "aab", "ba</w>", "ab</w>", "aaab</w>"]
    merges = [["a", "a"], ["a", "b"], ["aa", "aa"], ["aa", "b"], ["b", "a</w>"], ["a", "b</w>"], ["aa", "ab</w>"]]
    told = {"model": {"type": "BPE", "vocab": {t: k for k, t in enumerate(vocab)}, "merges": merges, "end_of_word_suffix": "</w>"}, "added_tokens": [], "decoder": None, "normalizer": None, "pre_tokenizer": None}
    path = f"{tmp_path}/small.json"
    with open(path, "w") as file:
        json.dump(told, file)
    automaton = bpe_automaton.Automaton(path)

    def by_hand(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            k = 0
            while k + 1 < len(parts):
                if parts[k : k + 2] == [a, b]:
                    parts[k : k + 2] = [a + b]
                k += 1
        return parts

    words = [format(k, "b")[1:].replace("0", "a").replace("1", "b") for k in range(2, 2048)]
    ids, counts = automaton.words(words)
    at = 0
    for word, n in zip(words, counts, strict=True):
        assert [vocab[k] for k in ids[at : at + n]] == by_hand(word)
        at += n
    merges.reverse()
    with open(path, "w") as file:
        json.dump(told, file)
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(path)


def test_operator_passes_columns_through_and_decodes(spark, library):
    rows = [(None if k == 3 else k, t, "mine", k) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, n_tokens bigint")
    both = bpe_automaton.decoded(bpe_automaton.encoded(docs, PATH), PATH)
    assert both.columns == ["doc_id", "label", "n_tokens", "ids", "decoded"]
    got = {r.n_tokens: r for r in both.collect()}
    for _, text, label, k in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == library.decode(ids, skip_special_tokens=False) and got[k].label == label
    digests = {repr(r.doc_id): tuple(r)[1:] for r in bpe_automaton.op12_rows(docs.repartition(3), PATH).collect()}
    for k, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert digests[repr(k)] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert bpe_automaton.op12_rows(docs.limit(0), PATH).count() == 0


def test_forgetting_changes_nothing(automaton, library, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "_KEPT", 3)
    encoder = bpe_automaton.Encoder(automaton)
    for _ in range(3):
        for text in TEXTS[1:6]:
            assert each(encoder, [text, "one two three four"])[0] == library.encode(text, add_special_tokens=False).ids
