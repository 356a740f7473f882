import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import token_counts, token_files
from millrace.llm.common import scratch

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Hello, world's  end\n\n x", "señor ñandú été", "日本語 text", "<|endoftext|> inside", "<s> and </s>", "word " * 20000, "same", "same", "'' ''s don't I'LL 12 3a\t\tb\r\n", " \x1c\x85 odd", "\x00\x01"]


def _docs(spark, texts):
    rows = [(None if k == 3 else k, t, "en", "s", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, digest string, n_tokens bigint")


def _sp(texts):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [len(p.encode(t or "")) for t in texts]


def test_counts_match_the_library_and_fill_the_cache(spark):
    docs, cache = _docs(spark, TEXTS), scratch(spark, "cache")
    for _ in range(2):
        got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.cached_token_counts(spark, docs, cache, PIECES).collect()}
        want = {(None if k == 3 else k, len((t or "").encode()), n, n > 4096) for k, (t, n) in enumerate(zip(TEXTS, _sp(TEXTS), strict=True))}
        assert got == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})
    more = _docs(spark, [*TEXTS, "new one"])
    token_counts.cached_token_counts(spark, more, cache, PIECES).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1


def test_counts_of_an_empty_table(spark):
    assert token_counts.cached_token_counts(spark, _docs(spark, []), scratch(spark, "cache"), PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_pages_round_trip(ids):
    x = np.array(ids, np.uint32)
    page = token_files.pack(x)
    assert np.array_equal(token_files.unpack(page), x)
    for place in range(0, len(ids), 97):
        b = place // token_files.BLOCK
        assert np.array_equal(token_files.block_of(page, place), x[b * 128 : (b + 1) * 128])


@pytest.fixture(scope="module")
def encoder():
    return token_files.UnitEncoder(BYTES)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(list("ab'sdtrevml 12\n\t\r.,!|ñÉ×÷µª")), st.characters(max_codepoint=0x3000, exclude_categories=["Cs"])), max_size=60))
def test_units_give_the_librarys_ids(encoder, text):
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in encoder.encode([text, text])] == [want, want]


def test_files_hold_every_document_in_order(spark):
    from tokenizers import Tokenizer

    tokenizer, docs, out = Tokenizer.from_file(BYTES), _docs(spark, TEXTS), scratch(spark, "files")
    token_files.write_token_files(spark, docs.repartition(5), out, BYTES)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_file_digests(spark, out).collect()}
    start, want = 0, {}
    for k in [3, *(k for k in range(len(TEXTS)) if k != 3)]:
        ids = [*tokenizer.encode(TEXTS[k] or "", add_special_tokens=False).ids, 0]
        want[None if k == 3 else k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_files_of_an_empty_table(spark):
    out = scratch(spark, "files")
    token_files.write_token_files(spark, _docs(spark, []), out, BYTES)
    assert token_files.token_file_digests(spark, out).count() == 0


def test_units_are_looked_up_once_a_call_and_stay_known():
    """300,000 units and more stay known, so the library isn't asked for them again; a unit of many texts is looked up once."""
    import pyarrow as pa

    encoder, asked, looked = token_files.UnitEncoder(BYTES), [0], [0]
    whole = encoder._whole

    def counted(texts):
        asked[0] += sum(map(len, texts))
        return whole(texts)

    class Places(type(encoder.place)):
        def __getitem__(self, unit):
            looked[0] += 1
            return super().__getitem__(unit)

    encoder._whole, new, encoder.place = counted, encoder.place.new, Places(encoder.place)
    encoder.place.new = new
    texts = ["x " + " ".join(f"{a}{b}" for b in range(k, k + 1000)) for a in "abcd" for k in range(0, 80_000, 1000)]
    for _ in range(2):
        asked[0] = 0
        got = [encoder.encode(pa.array(texts[k : k + 40] * 2)) for k in range(0, len(texts), 40)]
    assert asked[0] == 2 * len(texts) and looked[0] == 2 * 320_000
    assert got[3][7].tolist() == encoder.tokenizer.encode(texts[127], add_special_tokens=False).ids
