"""Derived tables read every row of their sources."""

import os

import pytest
from pyspark.sql import functions as F

from signalloom.catalog import people
from signalloom.catalog.base import Inputs
from signalloom.sources.sample_tables import sample_table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name, key", [("radio_events", "row_no"), ("signals", "event_no")])
def test_planes_hold_all_events(spark, name, key):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    rows = sample_table(spark, FOLDER, name)
    assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in events.select("event_id").collect())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_transactions_hold_all_lines(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    rows = sample_table(spark, FOLDER, "transactions").groupBy("retransmission", F.isnotnull("cause").alias("response")).count().collect()
    found = {(r.retransmission, r.response): r["count"] for r in rows}
    assert sum(found.values()) == lines
    assert set(found) == {(False, False), (False, True), (True, False)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_map_names_all_suppliers(spark):
    exact, _ = people._map(Inputs(spark, FOLDER))
    names = spark.read.parquet(f"{FOLDER}/supplier.parquet").select("s_name").collect()
    assert sorted(r.name for r in exact.collect()) == sorted(r.s_name for r in names)
    assert exact.select("ip").distinct().count() == len(names)
