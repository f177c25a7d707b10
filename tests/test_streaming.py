import random

from signalloom.operators.packets import io_statistics
from signalloom.operators import ran
from signalloom.streaming import alarms, traffic
from signalloom.streaming.replay import replayed

SCHEMA = "capture_id string, ts_us long, length int, src_ip string, dst_ip string, src_port int, dst_port int, transport string"


def _run(spark, tmp_path, rows, build, name):
    source = str(tmp_path / "in")
    batch = spark.createDataFrame(rows, SCHEMA)
    batch.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    query = build(stream).writeStream.outputMode("append").format("memory").queryName(name)
    query = query.option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return batch, spark.table(name).collect()


def test_counters_equal_batch(spark, tmp_path):
    rows = [("c", 1_000_000 * s + k, 10, "a", "b", 1, 2, "UDP") for s in range(3) for k in range(s + 1)]
    rows.append(("c", 60_000_000, 1, "a", "b", 1, 2, "UDP"))
    batch, got = _run(spark, tmp_path, rows, traffic.traffic_counters, "counters")
    want = {tuple(r) for r in io_statistics(batch).collect() if r["interval_us"] < 10_000_000}
    assert {tuple(r) for r in got} == want


def test_flows_close_after_gap(spark, tmp_path):
    rows = [("c", 0, 10, "a", "b", 1, 2, "UDP"), ("c", 5_000_000, 20, "b", "a", 2, 1, "UDP"), ("c", 900_000_000, 1, "x", "y", 1, 2, "UDP")]
    _, got = _run(spark, tmp_path, rows, lambda s: traffic.closed_flows(s, "30 seconds"), "closed")
    assert [(r["packet_count"], r["total_bytes"], r["end_us"]) for r in got] == [(2, 30, 5_000_000)]


def _replay(spark, tmp_path, files, schema, build, each=None):
    """Rows of a stream over files that arrive in order, one file a batch."""
    from pyspark.sql import functions as F

    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).withColumn("n", F.lit(i)).drop("n").write.parquet(str(tmp_path / f"in/{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    return replayed(build(stream)).collect()


def test_congestion_equals_the_batch_rule_in_any_order(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for ue, step in (("busy", 400_000), ("calm", 900_000), ("late", 600_000)):
        at = 0
        for i in range(120):
            at += rng.randrange(step) if (i // 20) % 2 or ue != "late" else 2_000_000
            rows.append(("c", ue, at, i))
    rows.sort(key=lambda r: (r[2], r[1]))
    files = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for part in files:
        rng.shuffle(part)
    schema = "capture_id string, ue_key string, ts_us long, frame_number long"
    got = _replay(spark, tmp_path, files + [[("c", "end", 10**9, 0)]], schema, alarms.anchored_congestion)
    columns = "*, 'S1AP' AS protocol, '4G' AS generation, CAST(NULL AS STRING) AS procedure_label, CAST(NULL AS STRING) AS cause_label"
    want = ran.signalling_congestion(spark.createDataFrame(rows, schema).selectExpr(*columns.split(", ")))
    assert {(r["ue_key"], r["start_us"]) for r in got} == {(r["ue_key"], r["start_us"]) for r in want.collect()} != set()


def test_unanswered_requests_by_protocol(spark, tmp_path):
    second = 1_000_000
    rows = [  # frame, second, message, seq, from, to, protocol
        (1, 0, "Req", "1", "a", "b", "PFCP"), (2, 1, "Resp", "1", "b", "a", "PFCP"),  # answered
        (3, 0, "Req", "2", "a", "b", "PFCP"), (4, 6, "Resp", "2", "b", "a", "PFCP"),  # too late
        (5, 0, "Req", "3", "a", "b", "GTPv2-C"), (6, 4, "Resp", "3", "b", "a", "GTPv2-C"),  # too late for GTP
        (7, 2, "Req", "4", "a", "b", "GTPv2-C"), (8, 3, "Req", "4", "a", "b", "GTPv2-C"), (9, 4, "Resp", "4", "b", "a", "GTPv2-C"),  # repeated
        (10, 90, "Req", "5", "a", "b", "PFCP"),  # not due before the end
    ]
    cells = [("c", f, (s + 100) * second, p, m, None, None, q, None, x, y) for f, s, m, q, x, y, p in rows]
    schema = "capture_id string, frame_number long, ts_us long, protocol string, message_type string, cause string, cause_label string, seq string, sess_id string, src string, dst string"
    files = [sorted(cells[:9], key=lambda r: (r[2], -r[1])), cells[9:], [("c", 11, 195 * second, "PFCP", "Req", None, None, "6", None, "a", "b")]]
    got = _replay(spark, tmp_path, files, schema, alarms.unanswered_alarms)
    assert sorted((r["frame_number"], r["due_us"] // second) for r in got) == [(3, 105), (5, 103), (7, 105)]
    assert all(r["protocol"] in ("PFCP", "GTPv2-C") and r["capture_id"] == "c" for r in got)
