import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import codecs, network, scalars, text

VALUES = st.recursive(st.integers() | st.binary(max_size=9), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.binary(max_size=5), x, max_size=4), max_leaves=12)


@given(VALUES)
def test_bencode_round_trip(value):
    assert codecs.bdecode(codecs.bencode(value)) == value


@pytest.mark.parametrize("data, value", [(b"i0e", 0), (b"i-3e", -3), (b"4:spam", b"spam"), (b"le", []), (b"de", {}), (b"d3:cow3:moo4:spaml1:a1:bee", {b"cow": b"moo", b"spam": [b"a", b"b"]})])
def test_bencode_examples(data, value):
    assert codecs.bdecode(data) == value and codecs.bencode(value) == data


@pytest.mark.parametrize("data", [b"", b"i3", b"5:abc", b"l", b"d1:ae", b"di1ei2ee", b"i1ei2e", b"x"])
def test_bad_bencode_is_refused(data):
    with pytest.raises(codecs.BencodeError):
        codecs.bdecode(data)


def test_deep_nesting():
    assert codecs.bencode(codecs.bdecode(b"l" * 50_000 + b"e" * 50_000)[0:0]) == b"le"


def test_infohash_forms():
    raw = hashlib.sha1(b"x").digest()
    import base64

    b32 = base64.b32encode(raw).decode()
    for form in (raw.hex(), raw.hex().upper(), b32, b32.lower(), f"magnet:?xt=urn:btih:{b32}&dn=n", f"magnet:?xt=urn:btih:{raw.hex()}"):
        assert codecs.parse_infohash(form) == raw
    with pytest.raises(ValueError):
        codecs.parse_infohash("12")


@given(st.binary(max_size=30))
def test_url_round_trip(data):
    assert codecs.url_decoded(codecs.url_encoded(data)) == data


@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 65535)), max_size=5))
def test_record_round_trip(peers):
    assert codecs.record_from(codecs.record_of(b"h" * 20, peers)) == (b"h" * 20, peers)


def test_wire_messages():
    hand = b"\x13BitTorrent protocol" + bytes(8) + b"i" * 20 + b"p" * 20
    assert codecs.wire_message(hand)["infohash"] == (b"i" * 20).hex().upper()
    assert codecs.wire_message(b"\x14\0" + codecs.bencode({"m": {"ut_metadata": 3}, "metadata_size": 99})) == {"kind": "extended_handshake", "metadata_size": 99, "ut_metadata": 3}
    data = codecs.wire_message(b"\x14\3" + codecs.bencode({"msg_type": 1, "piece": 0, "total_size": 2}) + b"ee")
    assert data == {"kind": "data", "piece": 0, "total_size": 2, "body": "6565"}


def test_codec_columns(spark):
    info = {"name": "n", "piece length": 1, "files": [{"path": ["a", "b"], "length": 3}, {"path": ["_____padding_file_0"], "length": 9}]}
    rows = [(codecs.bencode({"info": info}), "x"), (b"bad", None), (None, "2" * 40)]
    got = spark.createDataFrame(rows, "data binary, h string").select(codecs.bencoded_json(F.col("data")), codecs.metainfo(F.col("data")), codecs.infohash_bytes(F.col("h"))).collect()
    import json

    assert json.loads(got[0][1]) == {"infohash": hashlib.sha1(codecs.bencode(info)).hexdigest().upper(), "name": "n", "files": [{"path": ["a", "b"], "size": 3}]}
    assert got[1] == (None, None, None) and got[2][2] == b"\x22" * 20
    assert json.loads(got[0][0])["info"]["name"] == "n"


def test_pieces(spark):
    body = bytes(range(256)) * 100
    key = hashlib.sha1(body).digest()
    pieces = [(key, 0, body[:16384], len(body)), (key, 1, body[16384:], len(body)), (key, 1, body[16384:], len(body)), (b"z" * 20, 0, b"wrong", 5), (b"y" * 20, 1, b"half", 20000)]
    got = codecs.reassembled(spark.createDataFrame(pieces, "infohash binary, piece int, data binary, total int")).collect()
    assert [(bytes(r.infohash), bytes(r.body)) for r in got] == [(key, body)]


def test_reserved_edges(spark):
    rows = []
    for c in network.RESERVED:
        a, b = network.range_of(c)
        rows += [x for x in (a - 1, a, b, b + 1) if 0 <= x < 2**32]
    inside = lambda x: any(a <= x <= b for a, b in map(network.range_of, network.RESERVED))
    got = spark.createDataFrame([(x,) for x in rows], "ip bigint").select("ip", network.is_public(F.col("ip")).alias("p")).collect()
    assert all(r.p != inside(r.ip) for r in got)
    quads = spark.createDataFrame([("255.115.56.163",), ("8.8.8.8",), ("1.2.3",), ("300.1.1.1",), (None,)], "q string")
    assert [r[0] for r in quads.select(network.is_public(network.ip_number(F.col("q")))).collect()] == [False, True, None, None, None]


def test_compact_nodes(spark):
    record = b"n" * 20 + bytes([1, 2, 3, 4]) + (6881).to_bytes(2, "big")
    got = spark.createDataFrame([(record + record + b"cut",), (b"",), (None,)], "b binary").select(network.compact_nodes(F.col("b")).alias("n")).collect()
    assert [(bytes(x.node_id), x.ip, x.port) for x in got[0].n] == [(b"n" * 20, 0x01020304, 6881)] and got[1].n == []


def test_sizes_and_pages(spark):
    sizes = [0, 1023, 1024, 1048575, 1048576, 1073741823, 1073741824]
    got = spark.createDataFrame([(x,) for x in sizes], "b bigint").select(scalars.human_size(F.col("b"))).collect()
    assert [r[0] for r in got] == ["0B", "1023B", "1.00KB", "1024.00KB", "1.00MB", "1024.00MB", "1.00GB"]
    got = spark.createDataFrame([(x,) for x in (0, 1, 15, 16)], "n bigint").select(scalars.pages(F.col("n"), 15)).collect()
    assert [r[0] for r in got] == [1, 1, 1, 2]


@pytest.mark.parametrize("mode, want", [("greedy", {"ab": True, "zzxc": True, "abc": False, "": False, None: False}), ("substring", {"ab": True, "zzxc": True, "abc": True, None: False})])
def test_keyword_filter(spark, mode, want):
    got = spark.createDataFrame([(x,) for x in want], "c string").select("c", text.contains_keyword(F.col("c"), ["ab", "xc"], mode).alias("hit")).collect()
    assert {r.c: r.hit for r in got} == want


@given(st.lists(st.text("abx\u00e9\U0001f600", min_size=1, max_size=3), min_size=1, max_size=4), st.text("abxy\u00e9\U0001f600\n", max_size=12))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_greedy_keywords_equal_brute_force(spark, words, value):
    heads, inner = {w[0] for w in words}, {x for w in words for x in w[1:]}

    def hit(i):
        j = i + 1
        while j < len(value) and value[j] in inner:
            j += 1
        return value[i] in heads and value[i:j] in words

    got = spark.range(1).select(text.contains_keyword(F.lit(value), words)).first()[0]
    assert got == any(map(hit, range(len(value))))


def test_greedy_keywords_of_a_long_text(spark):
    long = F.repeat(F.lit("ab"), 1_000_000)
    assert tuple(spark.range(1).select(text.contains_keyword(long, ["ab", "xb"]), text.contains_keyword(F.concat(long, F.lit(" ab")), ["ab", "ba"])).first()) == (True, True)


def test_tokens_and_highlight(spark):
    row = spark.createDataFrame([("One abcdefghijklmnopq Two the",)], "c string").select(
        text.analyzed(F.col("c"), ["THE"]).alias("a"), text.analyzed(F.col("c"), truncate_at_long_token=True).alias("b"), text.highlight(F.lit("abcd xbc"), F.array(F.lit("ab"), F.lit("bc"), F.lit("abc"))).alias("h"),
    ).first()
    assert row.a == ["one", "two"] and row.b == ["one"]
    m = lambda x: f"<span class='highlight'>{x}</span>"
    assert row.h == f"{m('abc')}d x{m('bc')}"
    assert text.query_terms("A the  b") == ["a", "the", "b"] and text.query_terms("x") == ["x"] and text.query_terms("  ") == []
