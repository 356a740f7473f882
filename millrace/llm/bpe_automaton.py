"""BPE as a deterministic automaton over tokens.

Compiling. The automaton begins with one state and an arc for each base symbol, and so reads every sequence of symbols. Each
merge (a, b) -> c then is a gadget applied to it: a state with an arc a to a state that has an arc b gets an arc c to where
b led, and the arcs a are led to a copy of their state that lacks b (and lacks c as well if a = b, for a run is merged from
its left). After the last merge the automaton reads exactly the token sequences that the merges give. All arcs of one token
lead to one state, so it is held as state_of (by token) and a bit a state and token: arcs. A state is copied only while
other tokens share it: there are at most as many states as tokens that begin a merge, and the table has at most
(merges + 1) x tokens bits, whatever the corpus (46 MB for 49,000 merges).

Encoding. A trie of the tokens' labels and the arcs are the transition tables. A prefix of a word has one token sequence
that the automaton reads, so its last token is all that need be kept of it: from each place in a word the trie is walked
forward, and a token that it meets extends the prefix before it if the state after that prefix's last token has its arc.
Many words go through the tables at once. Normalising and pre-splitting follow the tokenizer file: plain ASCII by its
pattern, all else by the tokenizers library. Text is cut at white space first, which no step joins again, so a worker
encodes each distinct stretch once; it forgets them all beyond a bounded number.

Decoding emits the labels of the arcs, with a space between, as the library does for a file without a decoder.

Defined results: null and empty texts have no ids; special strings inside texts become their ids; texts are whole however
long; repeated rows are encoded each; other columns pass through untouched (ids and decoded may not be among them); an
empty table gives no rows. Files that these rules don't cover (dropout, unknown tokens, prefixes, merges out of order,
special strings with white space) are refused.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_rows, text_or_empty, written

#: The split pattern of the word-level file, and the same for lower-case ASCII without white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")
_LIBRARY_SPLIT, _OTHER_SPACE = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[\x1c-\x1f]")
#: Longer words go through the tables one at a time.
_LONG = 64
_KEPT = 600_000


class Automaton:
    """The tables. state_of: the state after a token; arcs: a bit a state and token; keys and nodes: the trie's transitions
    (node x 256 + symbol, sorted); inner and last: the token that ends at a node inside a word and at its end; symbol: the
    number of a character."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        specials = {x["content"]: x["id"] for x in told["added_tokens"]}
        merged = {a + b for a, b in merges}
        base = [t for t in vocab if t not in merged and t not in specials]
        known = set(base)
        for a, b in merges:
            if a not in known or b not in known or a + b in known or a.endswith(suffix) and suffix:
                raise ValueError("merges out of order")
            known.add(a + b)
        odd = model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or told["decoder"]
        if odd or any(len(t.removesuffix(suffix) if suffix else t) != 1 for t in base):
            raise ValueError("not a plain byte-level BPE file")
        if any(x.get("normalized") or x["single_word"] or x["lstrip"] or x["rstrip"] or x["content"].split() != [x["content"]] for x in told["added_tokens"]):
            raise ValueError("special strings that aren't plain")
        self.path, self.specials = path, specials
        self.labels = [""] * (1 + max([*vocab.values(), *specials.values()]))
        for label, k in [*vocab.items(), *specials.items()]:
            self.labels[k] = label
        pre = told.get("pre_tokenizer") or {}
        split = (pre.get("pretokenizers") or [{}])[0]
        steps = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (split.get("pattern") or {}).get("Regex") == WORD_PATTERN and split.get("invert") is True and steps == ["NFC", "Replace", "Lowercase"]
        self._gadgets([vocab[t] for t in base], [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self._trie(vocab, suffix)

    def _gadgets(self, base: list[int], merges: list[tuple[int, int, int]]) -> None:
        states = 4096  # doubled when full
        arcs = np.zeros((states, len(self.labels) // 8 + 1), np.uint8)
        np.bitwise_or.at(arcs[0], np.array(base) >> 3, (1 << (np.array(base) & 7)).astype(np.uint8))
        state_of, sharing, made = [0] * len(self.labels), [0] * states, 1
        sharing[0] = 1 + len(base)  # the first state is where words begin, so it stays
        for a, b, c in merges:
            after_a = state_of[a]
            if not arcs[after_a, b >> 3] >> (b & 7) & 1:
                continue  # b never follows a any more
            arcs[:made, c >> 3] |= ((arcs[:made, a >> 3] >> (a & 7)) & 1) << (c & 7)
            state_of[c] = state_of[b]
            sharing[state_of[c]] += 1
            if sharing[after_a] > 1:
                if made == len(arcs):
                    arcs, sharing = np.concatenate([arcs, np.zeros_like(arcs)]), sharing + [0] * made
                arcs[made] = arcs[after_a]
                sharing[after_a] -= 1
                after_a, made = made, made + 1
                state_of[a], sharing[after_a] = after_a, 1
            for gone in {b, c} if a == b else {b}:
                arcs[after_a, gone >> 3] &= ~np.uint8(1 << (gone & 7))
        self.state_of, self.arcs = np.array(state_of, np.int32), arcs[:made].copy()

    def _trie(self, vocab: dict[str, int], suffix: str) -> None:
        chars = sorted({x for t in vocab for x in (t.removesuffix(suffix) if suffix else t)})
        if len(chars) > 255:
            chars = sorted({t for t in vocab if len(t) == 1})
        self.symbol = np.full(0x400, 255, np.int64)  # 255: no arc
        number = {c: k for k, c in enumerate(chars[:255])}
        for c, k in number.items():
            self.symbol[ord(c)] = k
        # the byte-level alphabet has 256 characters; the one beyond 255 numbers gets 255, and padding gets -1
        if len(chars) > 255:
            number[chars[255]] = 255
        node_of, inner, last = {"": 0}, [-1], [-1]
        keys = []
        for label, k in vocab.items():
            text = label.removesuffix(suffix) if suffix else label
            for end in range(1, len(text) + 1):
                if text[:end] not in node_of:
                    node_of[text[:end]] = len(inner)
                    keys.append((node_of[text[: end - 1]] * 256 + number[text[end - 1]], len(inner)))
                    inner.append(-1)
                    last.append(-1)
            at = node_of[text]
            if suffix and label.endswith(suffix):
                last[at] = k
            else:
                inner[at] = k
                last[at] = last[at] if suffix else k
        keys.sort()
        self.keys, self.nodes = (np.array(x, np.int64) for x in zip(*keys, strict=True))
        self.inner, self.last = np.array(inner, np.int64), np.array(last, np.int64)

    def _can(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state after a token (-1: where words begin) has the arc."""
        state = np.where(before < 0, 0, self.state_of[before])
        return (self.arcs[state, token >> 3] >> (token & 7)) & 1 == 1

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids in each) of pre-split words in the byte-level alphabet."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[points]
        starts = np.cumsum(sizes) - sizes
        counts, found = np.zeros(len(words), np.int64), []
        order = np.argsort(sizes, kind="stable")
        short = order[sizes[order] <= _LONG]
        for k in range(0, len(short), 8192):
            rows = short[k : k + 8192]
            place, ids, n = self._together(symbols, starts[rows], sizes[rows])
            counts[rows] = n
            found.append((rows[place], ids))
        for row in order[len(short) :]:
            ids = self._alone(symbols[starts[row] : starts[row] + sizes[row]])
            counts[row] = len(ids)
            found.append((np.full(len(ids), row), ids))
        if not found:
            return np.zeros(0, np.int64), counts
        row, ids = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        return ids[np.argsort(row, kind="stable")], counts

    def _together(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id) of words of up to _LONG symbols in order, and the number of ids of each."""
        most = int(sizes.max(initial=0))
        ending = np.full((len(sizes), most + 1), -1, np.int64)  # the last token of each prefix
        begun = np.zeros((len(sizes), most + 1), np.int64)  # and where it begins
        for s in range(most):
            rows = np.flatnonzero(sizes > s)
            node, at = np.zeros(len(rows), np.int64), s
            while len(rows):
                key = node * 256 + symbols[starts[rows] + at]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = self.keys[k] == key
                rows, node = rows[on], self.nodes[k[on]]
                at += 1
                ends = sizes[rows] == at
                token = np.where(ends, self.last[node], self.inner[node])
                has = np.flatnonzero(token >= 0)
                has = has[self._can(ending[rows[has], s] if s else np.full(len(has), -1), token[has])]
                ending[rows[has], at], begun[rows[has], at] = token[has], s
                rows, node = rows[~ends], node[~ends]
        rows, at = np.arange(len(sizes)), sizes.copy()
        emitted = []
        rows, at = rows[at > 0], at[at > 0]
        while len(rows):
            emitted.append((rows, ending[rows, at]))
            at = begun[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        if not emitted:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        row = np.concatenate([x for x, _ in emitted[::-1]])
        ids = np.concatenate([x for _, x in emitted[::-1]])
        order = np.argsort(row, kind="stable")
        return row[order], ids[order], np.bincount(row, minlength=len(sizes))

    def _alone(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one long word by the same tables."""
        if not hasattr(self, "_next"):
            self._next = dict(zip(self.keys.tolist(), self.nodes.tolist(), strict=True))
            self._tokens = (self.inner.tolist(), self.last.tolist())
        size, read = len(symbols), symbols.tolist()
        ending, begun = [-1] * (size + 1), [0] * (size + 1)
        for s in range(size):
            node, at = 0, s
            row = self.arcs[self.state_of[ending[s]] if s else 0]
            while at < size and (node := self._next.get(node * 256 + read[at])) is not None:
                at += 1
                token = self._tokens[at == size][node]
                if token >= 0 and row[token >> 3] >> (token & 7) & 1:
                    ending[at], begun[at] = token, s
        out, at = [], size
        while at:
            out.append(ending[at])
            at = begun[at]
        return np.array(out[::-1], np.int64)


def _numbered(known: dict[str, int], asked: list[str]) -> tuple[np.ndarray, list[str]]:
    """(the strings' numbers, those that weren't known). New strings get the next numbers."""
    numbers = np.fromiter(map(known.get, asked, itertools.repeat(-1)), np.int64, len(asked))
    missing = np.flatnonzero(numbers < 0)
    strings = [asked[k] for k in missing.tolist()]
    new = list(dict.fromkeys(strings))
    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
    numbers[missing] = np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))
    return numbers, new


class Encoder:
    """Whole texts to ids. Keeps the ids of the stretches and words it has met, up to a bounded number of each."""

    def __init__(self, automaton: Automaton):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.automaton, self.library = automaton, Tokenizer.from_file(automaton.path)
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(automaton.specials, key=len, reverse=True)) + ")") if automaton.specials else None
        self._forget()

    def _forget(self) -> None:
        # strings to their numbers; a line's end stands between stretches and has no ids
        self.stretch: dict[str, int] = {}
        self.word = {"\n": 0}
        self.flat, self.word_flat = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.sizes, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.word_sizes, self.word_starts = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids in each)."""
        if len(self.stretch) > _KEPT or len(self.word) > _KEPT:
            self._forget()
        asked = [[x for x in _LIBRARY_SPLIT.split(text) if x] if _OTHER_SPACE.search(text) else text.split() for text in texts]
        numbers, new = _numbered(self.stretch, list(itertools.chain.from_iterable(asked)))
        if new:
            self.starts, self.sizes = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.starts, self.sizes))
            self._learn(new, np.arange(len(self.starts) - len(new), len(self.starts)))
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, asked)])]
        return _gathered(self.flat, self.starts[numbers], sizes), np.diff(ends)

    def _learn(self, new: list[str], at: np.ndarray) -> None:
        """Adds the ids of new stretches, whose numbers are at."""
        cut = self.cut if self.cut and self.cut.search("\n".join(new)) else None
        plain, other = [], []
        for k, x in enumerate(new):
            if cut and cut.search(x):
                self._add(np.array([at[k]]), *self._apart(x))
            elif self.automaton.by_word and x.isascii() and x.isprintable():
                plain.append(k)
            else:
                other.append(k)
        if plain:
            # all as one text, a line a stretch
            words = PLAIN_PATTERN.findall("\n".join([new[k] for k in plain]).lower())
            numbers = self._numbers(words)
            ends = numbers == self.word["\n"]
            self._add(at[plain], numbers[~ends], np.diff(np.flatnonzero(np.concatenate([[True], ends, [True]]))) - 1)
        for k in range(0, len(other), 1000):
            some = other[k : k + 1000]
            words, counts = self._split([new[x] for x in some])
            self._add(at[some], self._numbers(words), counts)

    def _apart(self, stretch: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of words, their count) of a stretch with special strings, whose numbers are below 0."""
        found = []
        for part in filter(None, self.cut.split(stretch)):
            special = self.automaton.specials.get(part)
            found.append(np.array([-1 - special]) if special is not None else self._numbers(self._split([part])[0]))
        return np.concatenate(found), np.array([sum(map(len, found))])

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; new ones are encoded."""
        numbers, new = _numbered(self.word, words)
        if new:
            ids, counts = self.automaton.words(new)
            begin = len(self.word_flat) + np.cumsum(counts) - counts
            self.word_flat, self.word_sizes, self.word_starts = np.concatenate([self.word_flat, ids.astype(np.int32)]), np.concatenate([self.word_sizes, counts]), np.concatenate([self.word_starts, begin])
        return numbers

    def _add(self, at: np.ndarray, numbers: np.ndarray, per: np.ndarray) -> None:
        """Stretches' ids by their words' numbers, so many of them a stretch."""
        special = numbers < 0
        sizes = np.ones(len(numbers), np.int64)
        sizes[~special] = self.word_sizes[numbers[~special]]
        ends = np.cumsum(sizes)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        ids[(ends - 1)[special]] = -1 - numbers[special]
        ids[np.repeat(~special, sizes)] = _gathered(self.word_flat, self.word_starts[numbers[~special]], self.word_sizes[numbers[~special]])
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        self.starts[at], self.sizes[at] = len(self.flat) + cuts[:-1], np.diff(cuts)
        self.flat = np.concatenate([self.flat, ids])

    def _split(self, stretches: list[str]) -> tuple[list[str], np.ndarray]:
        """(pre-split words of all stretches, how many each has) by the library, which gets them as one text; one by one if it
        sees other stretches."""
        whole = self.library.normalizer.normalize_str(" ".join(stretches)) if self.library.normalizer else " ".join(stretches)
        seen = whole.split(" ")
        if len(seen) != len(stretches) and len(stretches) > 1:
            each = [self._split([x]) for x in stretches]
            return [w for words, _ in each for w in words], np.concatenate([n for _, n in each])
        found = self.library.pre_tokenizer.pre_tokenize_str(whole) if self.library.pre_tokenizer else [(whole, (0, len(whole)))]
        words = [w for w, _ in found]
        if len(stretches) == 1:
            return words, np.array([len(words)])
        ends = np.cumsum(np.fromiter(map(len, seen), np.int64, len(seen)) + 1)
        places = np.searchsorted(ends, np.fromiter((at for _, (at, _) in found), np.int64, len(found)), side="right")
        return words, np.bincount(places, minlength=len(stretches))


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


_ENCODERS: dict[str, Encoder] = {}
_COMPILED: dict[tuple, Automaton] = {}


def compiled(path: str) -> Automaton:
    """The file's automaton, kept while the file doesn't change."""
    told = os.stat(path)
    key = (path, told.st_size, told.st_mtime_ns)
    if key not in _COMPILED:
        _COMPILED[key] = Automaton(path)
    return _COMPILED[key]


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids in place of the text. The automaton is compiled once and broadcast: its size hangs on the file only.
    Run it under batch_rows() where texts are long, for a worker holds an Arrow batch of them."""
    tables = docs.sparkSession.sparkContext.broadcast(compiled(path))
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(tables.value))
        for batch in batches:
            column = batch.column("__text")
            for at, n in _stretches_of(column):
                ids, counts = encoder.texts(column.slice(at, n).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, n) for c in kept), lists], [*kept, "ids"])

    schema = docs.select(*kept, F.lit(None).cast("array<int>").alias("ids")).schema
    return docs.select(*kept, text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def _stretches_of(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of texts of some MB together, at least one."""
    sizes = np.array([x or 0 for x in pc.binary_length(column).to_pylist()], np.int64)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield at, min(n, len(sizes) - at)
        at += n


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """coded with decoded, the labels of its ids with a space between."""
    names = coded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(_labels(path), pa.string())
        for batch in batches:
            ids = batch.column("ids")
            ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), labels.take(ids.flatten())), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "decoded"])

    return coded.mapInArrow(run, coded.withColumn("decoded", F.lit(None).cast("string")).schema)


_LABELS: dict[str, list[str]] = {}


def _labels(path: str) -> list[str]:
    if path not in _LABELS:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        every = told["model"]["vocab"] | {x["content"]: x["id"] for x in told["added_tokens"]}
        _LABELS[path] = [""] * (1 + max(every.values()))
        for text, k in every.items():
            _LABELS[path][k] = text
    return _LABELS[path]


def op12_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of docs (doc_id, text)."""
    both = decoded(encoded(docs.select("doc_id", "text"), path), path)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    digests = both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    with batch_rows(docs.sparkSession, 200):
        return written(digests, "bpe-digests")
