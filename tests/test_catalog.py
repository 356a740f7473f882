import hashlib
import os

import duckdb
import pandas as pd
import pytest

from millrace import catalog, catalog_index, catalog_more, catalog_state  # noqa: F401

SF = "/root/testdata/sf0.001"


def _rows(frame: pd.DataFrame) -> list:
    def plain(x):
        if isinstance(x, list | tuple) or type(x).__name__ == "ndarray":
            return tuple(plain(y) for y in x)
        return None if x is None or x is pd.NaT or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


WIDER = "/root/testdata/sf0.01"


def test_nearest_of_all_suppliers(spark):
    sha = lambda x: hashlib.sha1(str(x).encode()).digest()
    nodes = [(int.from_bytes(sha(c)), c) for (c,) in duckdb.sql(f"SELECT c_custkey FROM '{WIDER}/customer.parquet'").fetchall()]
    want = set()
    for (k,) in duckdb.sql(f"SELECT s_suppkey FROM '{WIDER}/supplier.parquet'").fetchall():
        x = int.from_bytes(sha(k))
        want |= {(k, c, rank) for rank, (_, c) in enumerate(sorted((x ^ y, c) for y, c in nodes)[:8], 1)}
    got = [tuple(r) for r in catalog.QUERIES["xor_nearest_8"](spark, WIDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({k for k, *_ in want}) > 20


def test_pieces_of_all_parts(spark, tmp_path):
    names = [f"part {k * k}" for k in range(1, 251)]
    spark.createDataFrame(list(enumerate(names, 1)), "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = {(hashlib.sha1(n.encode() * 2000).hexdigest().upper(), len(n) * 2000) for n in names}
    got = [tuple(r) for r in catalog.QUERIES["piece_reassembly"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) == 250 and set(got) == want


def test_quota_at_the_edges_of_an_interval(spark, tmp_path):
    """Events within half a second of an hour's end, exact halves, times before the epoch, without an id or a time."""
    duckdb.sql(
        "COPY (SELECT CASE WHEN i % 8 > 0 THEN i END AS event_id, make_timestamp((h::BIGINT * 3600 + s) * 1000000 + us) AS ts, 'view' AS event_type "
        "FROM (SELECT row_number() OVER (ORDER BY h, s, us, k) AS i, * FROM (VALUES (-2), (-1), (0), (1), (473353)) a(h), (VALUES (-1), (0), (1)) b(s), (VALUES (0), (499999), (500000), (500001)) c(us), range(2) d(k)) "
        f"UNION ALL SELECT nullif(i, 3), NULL, 'view' FROM range(9) t(i)) TO '{tmp_path}/events.parquet'"
    )
    want = duckdb.sql(catalog.SQL["rate_limit_windows"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).df()
    got = catalog.QUERIES["rate_limit_windows"](spark, str(tmp_path)).toPandas()
    assert _rows(got) == _rows(want) and set(want["allowed"]) == {True, False}
