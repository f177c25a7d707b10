"""Registered queries against their SQL on the smallest data set. ``CATALOG_TESTS=all`` runs every one."""

import os

import duckdb
import pytest

from signalloom.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"
SOME = ["a1_flows", "j1_pair_transactions", "a9_latency_statistics", "a20_a24_calls", "a28_a29_rtp_streams", "j9_d16_handover_failures", "w1_d18_signalling_congestion", "f13_f14_values", "j10_correlations", "a17_assign_subscribers", "w6_sample_messages"]
NAMES = list(CATALOG) if os.environ.get("CATALOG_TESTS") == "all" else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in ("lineitem", "orders", "events", "supplier"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def _plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def _sorted(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    item = CATALOG[name]
    frame = item.query(spark, FOLDER)
    columns = sorted(frame.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in frame.collect()]
    if item.sql is None:
        assert got
        return
    result = duck.execute(item.sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert _sorted(got) == _sorted(want)
