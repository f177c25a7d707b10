"""Steps that read their input once, however many results they need from it."""

import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalloom.catalog import CATALOG
from signalloom.operators import transactions as ops
from signalloom.plans import ranks
from signalloom.session import stored
from signalloom.sources.delimited import POSITION, read_delimited
from signalloom.streaming import alarms
from signalloom.streaming.replay import replayed
from test_catalog import FOLDER


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_delimited_text_is_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes('id;né;n"x\n1;"two\nlines";ü\n\n2;b;\n'.encode("latin-1"))
    (tmp_path / "in/b.csv").write_text('"id","a\nb"\n3,"x\ny"\n')
    rows = read_delimited(spark, str(tmp_path / "in"))
    plan = _plan(rows)
    assert "FileScan text" not in plan and plan.count("Window") == 0
    got = sorted((r["trace_id"], r["id"], r["né"], r['n"x'], r["a\nb"]) for r in rows.collect())
    assert got == [("a", "1", "two\nlines", "ü", None), ("a", "2", "b", None, None), ("b", "3", None, None, "x\ny")]
    assert set(POSITION) < set(rows.columns)


def test_summary_of_anomalies_pairs_once(spark):
    rows = [
        ("c", 1, 0, "PFCP", "m", None, None, "1", "s", "a", "b", False),
        ("c", 2, 1_200_000, "PFCP", "m", "1", None, "1", "s", "b", "a", False),  # a warning, as is the 95th percentile
        ("c", 3, 0, "GTPv2-C", "m", None, None, "1", "s", "a", "b", True),
        ("c", 4, 0, "GTPv2-C", "m", None, None, "2", "s", "a", "b", True),  # two timeouts, and a storm
        ("d", 5, 0, "PFCP", "m", None, None, "1", "s", "a", "b", None),
        ("d", 6, 10, "PFCP", "m", "1", None, "1", "s", "b", "a", None),
        ("d", 7, 0, "SIP", "m", None, None, None, None, "a", "b", None),
    ]
    schema = "capture_id string, frame_number long, ts_us long, protocol string, message_type string, cause string, cause_label string, seq string, sess_id string, src string, dst string, retransmission boolean"
    paired = ops.pair_transactions(spark.createDataFrame(rows, schema))
    summary = ops.temporal_summary(paired)
    assert "Window" not in _plan(summary.select("timeout_count"))
    names = ["total_anomalies", "critical_count", "warning_count", "timeout_count", "retransmission_count", "protocols_analyzed"]
    got = {r["capture_id"]: tuple(r[n] for n in names) for r in summary.collect()}
    assert got == {"c": (5, 2, 3, 2, 2, ["PFCP"]), "d": (0, 0, 0, 0, 0, ["PFCP"])}
    severities = sorted((r["capture_id"], r["severity"]) for r in ops.temporal_anomalies(paired).collect())
    assert severities == [("c", "critical")] * 2 + [("c", "warning")] * 3


def test_pairing_carries_only_what_is_read(spark):
    rows = spark.range(4).selectExpr("'c' capture_id", "id frame_number", "id ts_us", "'PFCP' protocol", "'m' message_type", "IF(id % 2 = 1, '1', NULL) cause", "concat('label', id) cause_label", "'1' seq", "'s' sess_id", "'a' src", "'b' dst")
    plan = ops.pair_transactions(rows.repartition(2)).select("latency_us")._jdf.queryExecution().optimizedPlan().toString()
    assert "ts_us" in plan and "label" not in plan


class _Entries(list):
    appendValue = list.append  # noqa: N815
    appendList = list.extend  # noqa: N815


class _Handle:
    def __init__(self):
        self.state, self.timers = _Entries(), []

    def getListState(self, name, schema):  # noqa: N802
        return self.state

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_rows_that_come_at_once_are_one_entry_of_the_state():
    alarm, handle = alarms._Unanswered(), _Handle()
    alarm.init(handle)
    rows = pd.DataFrame({"frame_number": range(1000), "ts_us": range(1000), "answer": [False] * 1000, "due_us": range(5000, 6000)})
    list(alarm.handleInputRows(("c",), iter([rows, rows.assign(answer=True)]), None))
    assert len(handle.state) == 2 and handle.timers == [5]


def test_a_request_is_told_once_among_frames_out_of_time_order(spark, tmp_path):
    second = 1_000_000
    schema = "capture_id string, frame_number long, ts_us long, protocol string, message_type string, cause string, cause_label string, seq string, sess_id string, src string, dst string"
    times = [[(1, 110, "1"), (2, 100, "1")], [(3, 117.5, "2")], [(4, 130, "3")]]
    for i, part in enumerate(times):
        rows = [("c", f, int(s * second), "PFCP", "Req", None, None, q, None, "a", "b") for f, s, q in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = replayed(alarms.unanswered_alarms(stream)).collect()
    assert sorted((r["frame_number"], r["due_us"] // second) for r in got) == [(1, 115), (2, 105)]


def test_ranks_are_found_in_spans_of_a_long_key(spark, monkeypatch):
    hour = 3_600_000_000
    times = f"IF(id % 3 = 0, id div 3 % 40, id) * {hour} + id % 7 - 100 * {hour}"
    rows = spark.range(3000).selectExpr("IF(id % 10 = 0, 'b', 'a') k", f"{times} ts", "id * 1000 seq")
    plans = []
    monkeypatch.setattr(ranks, "stored", lambda df: (plans.append(_plan(df)), stored(df))[1])
    pick = lambda total: (F.lit(5).cast("bigint"), F.lit(37).cast("bigint"), total - 1)
    got = {(r["k"], r["rank"], r["seq"], r["total"]) for r in ranks.rows_at_ranks(rows, ["k"], "ts", "seq", pick, 5000).collect()}
    order = {k: sorted((r["ts"], r["seq"]) for r in rows.collect() if r["k"] == k) for k in "ab"}
    assert got == {(k, i, all_[i][1], len(all_)) for k, all_ in order.items() for i in range(5, len(all_), 37)}
    # seconds and instants are counted within their span and second, never over the whole key
    assert len(plans) == 3 and not any(re.search(r"Window.*\[k#\d+\], \[(_sec|ts)#", plan) for plan in plans)
    assert re.search(r"Window.*\[k#\d+, _span#\d+L?\], \[_sec#", plans[1])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_ladder_is_searched_once(spark):
    plan = _plan(CATALOG["l1_message_sequence"].query(spark, FOLDER))
    assert "lineitem" not in plan and "Exchange" not in plan
