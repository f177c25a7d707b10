from pyspark.sql import functions as F

from signalloom.functions import causes, quality, radio, sdp
from signalloom.operators.radio import map_columns, normalize_rows
from signalloom.sources.dictionary import parse_value_strings


def test_cause_labels(spark):
    rows = [("PFCP", "1"), ("GTPv2", "64"), ("SIP", "404"), ("PFCP", "9999"), ("Diameter", "5001"), ("X", "7"), ("PFCP", "z")]
    df = spark.createDataFrame(rows, "p string, c string")
    got = [r[0] for r in df.select(causes.cause_label(F.col("p"), F.col("c"))).collect()]
    assert got[:3] == ["Request Accepted", "Context Not Found", "Not Found"]
    assert "Unknown" in got[3]
    assert got[4:] == ["DIAMETER_AVP_UNSUPPORTED", "7", "z"]


def test_mapped_causes_with_dictionary(spark):
    lines = [("V\tpfcp.cause\t1\tAccepted (dict)",), ("V\tpfcp.cause\t0x40\tHex",), ("V\tother\t1\tx",), ("R\tpfcp.cause",), ("V\tpfcp.cause\tq\tbad",)]
    words = parse_value_strings(spark.createDataFrame(lines, "value string"))
    assert {(r["value"], r["label"]) for r in words.collect()} == {(1, "Accepted (dict)"), (64, "Hex")}
    df = spark.createDataFrame([("PFCP", "1"), ("PFCP", "2"), ("PFCP", "77"), ("PFCP", "x"), ("Diameter", "5001")], "protocol string, code string")
    out = {r["code"]: r["m"] for r in causes.map_causes(df, {"code": "m"}, dictionary=words).collect()}
    assert (out["1"]["label"], out["1"]["source"]) == ("Accepted (dict)", "wireshark")
    assert (out["2"]["label"], out["2"]["source"]) == ("Request Rejected", "static_3gpp")
    assert (out["77"]["label"], out["77"]["is_mapped"]) == ("UNMAPPED(77)", False)
    assert out["x"]["label"] == "INVALID(x)"
    assert out["5001"]["label"] == "DIAMETER_ERROR_USER_UNKNOWN"
    hinted = df.withColumn("hint", F.lit("pfcp.cause"))
    out = {r["code"]: r["m"] for r in causes.map_causes(hinted, {"code": "m"}, dictionary=words, hints={"code": "hint"}).collect()}
    assert out["1"]["source"] == "wireshark" and out["2"]["source"] == "static_3gpp"


def test_reason_headers(spark):
    texts = ['SIP;cause=503;text="query ADB failed"', "X.int;reasoncode=0x0000070E;add-info=01.02", "X.int;reasoncode=0x99", "Q.850;cause=16", "", None, 'SIP;text=""']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(causes.parse_reason(F.col("t")).alias("p")).select("p.*", causes.reason_display(F.col("p")).alias("d")).collect()
    assert (got[0]["vendor"], got[0]["cause"], got[0]["d"]) == ("Huawei", "503", "Huawei HSS: Subscriber lookup failed")
    assert (got[1]["vendor"], got[1]["d"]) == ("Nokia", "Timeout/interworking")
    assert got[2]["d"] == "Nokia X.int code 0x99"
    assert (got[3]["protocol"], got[3]["d"]) == ("Q.850", "Q.850 cause=16")
    assert got[4]["protocol"] is None and got[5]["d"] == "Unknown reason"
    assert got[6]["text"] == ""


def test_sdp_lines(spark):
    body = "v=0\r\nm=audio 4000 RTP/AVP 8\r\nc=IN IP4 1.2.3.4\na=sendonly\nm=video 5000 UDP/TLS/RTP/SAVP 96 97\na=rtpmap:96 H264/90000\na=rtpmap:96 VP8/90000"
    row = spark.createDataFrame([(body,)], "b string").select(sdp.parse_sdp(F.col("b"), F.lit("offer")).alias("m")).first()["m"]
    assert [(m["type"], m["ip"], m["port"], m["codec"], m["direction"]) for m in row] == [
        ("audio", None, 4000, "PT-8", "sendrecv"),
        ("video", "1.2.3.4", 5000, "VP8", "sendonly"),
    ]
    assert row[1]["payload_types"] == ["96", "97"] and row[1]["rtcp_port"] == 5001


def test_preconditions(spark):
    body = "a=curr:qos local send\na=des:qos mandatory local sendrecv\na=des:qos optional remote send\na=conf:qos remote sendrecv"
    p = sdp.parse_preconditions(F.col("b"))
    row = spark.createDataFrame([(body,), ("a=des:qos mandatory e2e recv",), (None,)], "b string")
    got = row.select(sdp.has_preconditions(p), sdp.mandatory_met(p)).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (False, None)]


def test_mos(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (100.0, 0.0)], "j double, l double")
    got = [r[0] for r in df.select(quality.estimate_mos(F.col("j"), F.col("l"))).collect()]
    assert round(got[0], 2) == 4.41 and got[1] < 1.5 and got[2] < got[0]


def test_timestamps(spark):
    cases = {
        "1704067207.5": 1704067207500000,
        "1704067207500": 1704067207500000,
        "2024-01-01T00:00:07.5Z": 1704067207500000,
        "2024-01-01T05:30:07+05:30": 1704067207000000,
        "2023-12-31T19:30:07-04:30": 1704067207000000,
        "2024-01-01 03:00:07": 1704067207000000,
        "2024-1-1T3:00:07": 1704067207000000,
        "01/01/2024 03:00:07.25": 1704067207250000,
        "05/01/2024 03:00:00": 1704412800000000,
        "01/25/2024 03:00:00": 1706140800000000,
        "2024/01/01 03:00:07": 1704067207000000,
        "01-01-2024 03:00:07": 1704067207000000,
        "20240101030007": 1704067207000000,
        "20240101 030007": 1704067207000000,
        "event at 2024/01/01 03:00:07.125 ok": 1704067207125000,
        "31/31/2024 03:00:07": None,
        "never": None,
        "": None,
        "12345": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["us"] for r in df.select("t", radio.parse_timestamp(F.col("t")).alias("us")).collect()}
    assert got == cases


def test_numbers_and_zones(spark):
    df = spark.createDataFrame([("-95.5 dBm",), ("x",), (None,), (".5",)], "v string")
    assert [r[0] for r in df.select(radio.first_number(F.col("v"))).collect()] == [-95.5, None, None, 0.5]
    assert radio.zone_offset("Nowhere") == 10800 and radio.zone_offset("IST") == 19800
    df = spark.createDataFrame([("1 +03:00",), ("1 -05:00",), ("10:00 CET",), ("10:00",)], "v string")
    assert [r[0] for r in df.select(radio.zone_hint(F.col("v"))).collect()] == ["Asia/Qatar", "UTC-5", "CET", None]


def test_column_mapping():
    assert map_columns(["Event Time", "RSRP (dBm)", "ci", "my event time x", "zz"]) == {
        "Event Time": "timestamp",
        "RSRP (dBm)": "rsrp",
        "ci": "cell_id",
        "my event time x": "timestamp",
    }
    assert map_columns(["specimen"], strict=True) == {"specimen": "cell_id"}
    assert map_columns(["specimen"]) == {}


def test_normalize_keeps_unmapped_columns(spark):
    df = spark.createDataFrame(
        [("t", 1, "2024-01-01 03:00:07", "RLF", "x9"), ("t", 2, "bad", "RLF", "y")],
        "trace_id string, row_no long, Time string, Event string, Extra string",
    )
    (row,) = normalize_rows(df).collect()
    assert (row["event_type"], row["raw"], row["ts_us"]) == ("RLF", {"extra": "x9"}, 1704067207000000)
    assert row["event_label"] == "2024-01-01 03:00:07"
