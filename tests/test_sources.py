import json
import struct

import pytest
from pyspark.sql import functions as F

from signalloom.operators import packets as packet_ops
from signalloom.operators import transactions as tx_ops
from signalloom.operators.radio import normalize_rows, reconfiguration_latency, rule_hits
from signalloom.schemas import all_fields, column_name
from signalloom.sources import dictionary, fields, radio_files, sinks
from signalloom.sources.capture import CaptureSource


def _ipv4(src, dst, number, body):
    head = struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0, *src, *dst)
    return b"\x00" * 12 + b"\x08\x00" + head + body


def _tcp(sport, dport, flags, payload=b""):
    return struct.pack(">HHIIHHHH", sport, dport, 0, 0, 0x5000 | flags, 0, 0, 0) + payload


def _udp(sport, dport, payload):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def _frames():
    a, b, c, d = (192, 168, 1, 1), (192, 168, 1, 2), (10, 0, 0, 1), (10, 0, 0, 2)
    sip = b"SIP/2.0 486 Busy Here\r\nVia: x\r\n\r\n"
    rtp = b"\x80\x60" + b"\x00" * 10
    gtp = struct.pack(">BBHI", 0x30, 255, 0, 77)
    return [
        _ipv4(a, b, 6, _tcp(1234, 80, 0x02)),
        _ipv4(b, a, 6, _tcp(80, 1234, 0x12)),
        _ipv4(a, b, 6, _tcp(1234, 80, 0x10)),
        _ipv4(c, d, 17, _udp(5000, 6000, b"Hello World")),
        _ipv4(c, d, 17, _udp(5060, 5060, sip)),
        _ipv4(d, c, 17, _udp(20000, 30000, rtp)),
        _ipv4(d, c, 17, _udp(2152, 2152, gtp)),
        b"\x00" * 12 + b"\x08\x06" + b"\x00" * 28,
    ]


def _pcap(frames):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack("<IIII", 1000 + i, 500, len(f), len(f)) + f
    return out


def _pcapng(frames):
    out = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    out += struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
    for i, f in enumerate(frames):
        pad = f + b"\x00" * (-len(f) % 4)
        stamp = (1000 + i) * 1_000_000 + 500
        size = 32 + len(pad)
        out += struct.pack("<IIIIIII", 6, size, 0, stamp >> 32, stamp & 0xFFFFFFFF, len(f), len(f))
        out += pad + struct.pack("<I", size)
    return out


def test_capture_files(spark, tmp_path):
    (tmp_path / "one.pcap").write_bytes(_pcap(_frames()))
    (tmp_path / "two.pcapng").write_bytes(_pcapng(_frames()))
    (tmp_path / "notes.txt").write_text("x")
    spark.dataSource.register(CaptureSource)
    packets = spark.read.format("capture").load(str(tmp_path))
    assert packets.count() == 16
    rows = {r["frame_number"]: r for r in packets.filter("capture_id = 'one'").collect()}
    assert rows[1]["tcp_flags"] == "SA" and rows[1]["ts_us"] == 1_001_000_500
    assert rows[6]["gtp_type"] == 255 and rows[6]["gtp_teid"] == 77
    assert rows[7]["src_ip"] is None
    plain = [tuple(r[1:]) for r in packets.filter("capture_id = 'one'").orderBy("frame_number").collect()]
    other = [tuple(r[1:]) for r in packets.filter("capture_id = 'two'").orderBy("frame_number").collect()]
    assert plain == other
    classified = packet_ops.with_sip_failures(packet_ops.classify_packets(packets))
    flows = packet_ops.flows(classified).filter("capture_id = 'one'").collect()
    assert {(f["protocol"], f["packet_count"]) for f in flows} == {
        ("HTTP", 3), ("UDP", 1), ("SIP", 1), ("RTP", 1), ("GTP-U", 1)
    }
    http = next(f for f in flows if f["protocol"] == "HTTP")
    assert (http["src_ip"], http["src_port"], http["tcp_flags"]) == ("192.168.1.1", 1234, ["A", "S", "SA"])
    summary = packet_ops.failure_summary(packet_ops.flow_failures(classified)).filter("capture_id = 'one'")
    assert [r["error"] for r in summary.collect()] == ["SIP 486 Busy Here"]


def test_field_export(spark, tmp_path):
    head = ["frame.number", "frame.time_epoch", "sip.Call-ID", "sip.Method", "sip.Reason"]
    text = ",".join(head) + '\n"1","10.5","c1","INVITE",""\n"2","11.5","c1","BYE","Q.850;cause=16;text=""a, b"""\n,,,,\n'
    (tmp_path / "cap7.csv").write_text(text)
    rows = fields.read_fields(spark, str(tmp_path))
    assert rows.count() == 2
    built = tx_ops.build_transactions(rows).orderBy("frame_number").collect()
    assert [r["capture_id"] for r in built] == ["cap7", "cap7"]
    assert built[1]["ts_us"] == 11_500_000 and built[1]["cause"] == 'Q.850;cause=16;text="a, b"'
    assert fields.rows_of_pack(rows, ["sip_Reason"]).count() == 1
    assert len(all_fields()) == len(set(all_fields())) and column_name("sip.Call-ID") == "sip_Call_ID"


def test_radio_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time; Event ;RSRP (dBm)\n2024-01-01 03:00:07;RLF;-95.5 dBm\n2024-01-01 03:00:08;Paging;\n")
    rows = radio_files.read_radio_csv(spark, str(tmp_path / "a.csv"))
    events = normalize_rows(rows).orderBy("row_no").collect()
    assert [e["event_type"] for e in events] == ["RLF", "PAGING"]
    assert events[0]["rsrp"] == -95.5 and events[0]["trace_id"] == "a"


def test_radio_json(spark, tmp_path):
    nested = {"meta": {"v": 1}, "other": [{"x": 1}], "events": [{"time": 1704067207, "event": "RLF"}, {"time": 1704067208, "event": "CSFB"}]}
    (tmp_path / "n.json").write_text(json.dumps(nested))
    (tmp_path / "flat.json").write_text(json.dumps(nested["events"]))
    for name in ("n", "flat"):
        rows = radio_files.read_radio_json(spark, str(tmp_path / f"{name}.json"))
        got = normalize_rows(rows).orderBy("row_no").collect()
        assert [(e["event_type"], e["ts_us"]) for e in got] == [("RLF", 1704067207000000), ("CSFB", 1704067208000000)]


def test_radio_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<log><h>1</h><ev id="1"><time>2024-01-01 03:00:07</time><event>RLF</event><cell><pci>7</pci></cell></ev><ev id="2"><time>2024-01-01 03:00:09</time><event>Paging</event></ev></log>')
    rows = radio_files.read_radio_xml(spark, str(tmp_path / "x.xml"))
    assert {"id", "time", "event", "cell.pci"} <= set(rows.columns)
    got = normalize_rows(rows).orderBy("row_no").collect()
    assert [(e["event_type"], e["raw"]) for e in got] == [
        ("RLF", {"id": "1", "cell.pci": "7"}),
        ("PAGING", {"id": "2"}),
    ]


PAGE = (
    "<html><table><tr><td>x</td></tr></table><table><tr><th>Time</th><th>Event</th><th>Zone X</th></tr>"
    "<tr><td>1704067207</td><td>RLF</td><td>7</td></tr><tr><td>ragged</td></tr>"
    "<tr><td>1704067208</td><td><b>HO</b> fail</td><td>8</td></tr></table></html>"
)


def test_radio_html(spark, tmp_path):
    (tmp_path / "p.html").write_text(PAGE)
    got = normalize_rows(radio_files.read_radio_html(spark, str(tmp_path / "p.html"))).orderBy("row_no").collect()
    assert [e["event_type"] for e in got] == ["RLF", "HOfail"]
    assert [e["raw"] for e in got] == [{"zone x": "7"}, {"zone x": "8"}]
    script = '<script>var d = [{"time": "1704067207", "event": "CSFB"}];</script>' + PAGE
    assert radio_files.page_rows(script) == [{"time": "1704067207", "event": "CSFB"}]


DIAGRAM = """<html>
title: x
Note: {"type":"datetime","message":"2024-01-01 03:00:07.000"}
eNB->UE: {"type":"event","message":"RRC_RRC_CONNECTION_RECONFIGURATION","url":""}
Note: {"type":"datetime","message":"2024-01-01 03:00:09.500"}
"UE"->'eNB': {"type":"event","message":"RRC_RRC_CONNECTION_RECONFIGURATION_COMPLETE","url":"javascript:updateEventMessage('%3Crrc_reconfig_result%3E1%3C%2Frrc_reconfig_result%3E%3CCause%3E%3CradioNetwork%3Eradio-link-failure%3C%2FradioNetwork%3E%3C%2FCause%3E')"}
eNB: {"type":"event","message":"INTERNAL_PROC_RRC_CONN_RECONF_NO_MOB","url":"updateEventMessage('%3Crrc_reconfig_result%3E1%3C%2Frrc_reconfig_result%3E+%3Cmsg%3Ex%3C%2Fmsg%3E%3CRSRP%3E-99.5%3C%2FRSRP%3E')"}
not json }
</html>
"""


def test_diagram_text(spark, tmp_path):
    (tmp_path / "d.html").write_text(DIAGRAM)
    rows = radio_files.read_radio(spark, str(tmp_path / "d.html"))
    got = rows.orderBy("row_no").collect()
    assert [(r["from_node"], r["to_node"]) for r in got] == [("eNB", "UE"), ("UE", "eNB"), (None, None)]
    assert got[1]["Time"] == "2024-01-01 03:00:09.500" and got[1]["release_cause"] == "radio-link-failure"
    assert got[2]["raw"] == {"rrc_reconfig_result": "1", "rsrp": "-99.5"}
    events = normalize_rows(rows)
    assert [e["rsrp"] for e in events.orderBy("row_no").collect()] == [None, None, -99.5]
    (latency,) = reconfiguration_latency(events).collect()
    assert latency["latency_ms"] == 2500.0
    hits = {r["rule"]: r["n"] for r in rule_hits(events).collect()}
    assert hits == {"RECONFIG": 1, "RELEASE": 1}


def test_each_csv_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "mon").mkdir()
    (tmp_path / "tue").mkdir()
    (tmp_path / "mon" / "a.csv").write_text("Time;Event;Note\n1704067207;RLF;a,b\n\n1704067208;Paging;\n")
    late = "".join(f"{1704067300 + i},CSFB,x\n" for i in range(600))
    (tmp_path / "tue" / "a.csv").write_bytes(b"\xef\xbb\xbftime,EVENT,Zone\n" + late.encode() + "1704070000,RLF,\"M\u00fcnchen, Ost\"\n".encode("latin-1"))
    rows = radio_files.read_radio_csv(radio_files.Below(spark, "csv"), str(tmp_path))
    assert {"Note", "Zone"} <= set(rows.columns)
    got = normalize_rows(rows)
    assert {r["trace_id"]: r["count"] for r in got.groupBy("trace_id").count().collect()} == {"mon/a": 2, "tue/a": 601}
    assert [r["raw"] for r in got.filter("trace_id = 'mon/a'").orderBy("row_no").collect()] == [{"note": "a,b"}, {}]
    last = got.filter("trace_id = 'tue/a'").orderBy("row_no").collect()[-1]
    assert last["event_type"] == "RLF" and last["raw"] == {"zone": "M\u00fcnchen, Ost"}


def test_longest_json_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"alarms": [{"time": 1, "event": "x"}], "samples": [{"time": 1704067207 + i, "event": "RLF"} for i in range(5)]}))
    (tmp_path / "b.json").write_text(json.dumps({"meta": {"deep": {"points": [{"time": 1704067207, "event": "CSFB"}, {"time": 1704067209, "event": "CSFB"}]}}, "events": [{"time": 1704067207, "event": "RLF"}]}, indent=1))
    (tmp_path / "c.json").write_text("{broken")
    rows = radio_files.read_radio_json(spark, str(tmp_path))
    got = {(r["trace_id"], r["event_type"]): r["count"] for r in normalize_rows(rows).groupBy("trace_id", "event_type").count().collect()}
    assert got == {("a", "RLF"): 5, ("b", "CSFB"): 2}


def test_row_element():
    assert radio_files.row_element("<log>" + "<ev><kpi/><kpi/></ev>" * 3 + "</log>") == "ev"
    assert radio_files.row_element("<log><a><ev/><ev/></a><b><x/><x/></b></log>") == "ev"
    assert radio_files.row_element("<log><a/></log>") is None and radio_files.row_element("<log") is None


def test_xml_files_of_other_elements(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<log>" + "".join(f"<ev><time>{1704067207 + i}</time>\n<event>RLF</event><kpi>1</kpi><kpi>2</kpi></ev>" for i in range(3)) + "</log>")
    (tmp_path / "b.xml").write_text("<log><row time='1704067207' event='CSFB'/><row time='1704067208' event='CSFB'/></log>")
    got = normalize_rows(radio_files.read_radio_xml(spark, str(tmp_path)))
    assert {(r["trace_id"], r["event_type"]): r["count"] for r in got.groupBy("trace_id", "event_type").count().collect()} == {("a", "RLF"): 3, ("b", "CSFB"): 2}


def test_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p.html").write_text(PAGE)
    (tmp_path / "d.html").write_text(DIAGRAM)
    (tmp_path / "a.csv").write_text("Time,Event\n1704067207,RLF\n")
    (tmp_path / "sub" / "a.json").write_text('[{"time": 1704067207, "event": "CSFB"}]')
    (tmp_path / "notes.txt").write_text("no trace")
    rows = radio_files.read_radio(spark, str(tmp_path))
    got = {r["trace_id"]: r["count"] for r in normalize_rows(rows).groupBy("trace_id").count().collect()}
    assert got == {"sub/p.html": 2, "d.html": 3, "a.csv": 1, "sub/a.json": 1}


def test_clock_carries_over_blocks(spark):
    lines = [("t", 0, 0, 'N: {"type":"datetime","message":"T1"}'), ("t", 0, 1, 'A->B: {"type":"event","message":"m1"}'),
             ("t", 100, 0, 'A->B: {"type":"event","message":"m2"}'), ("t", 200, 0, 'A->B: {"type":"event","message":"m3"}'),
             ("t", 200, 1, 'N: {"type":"datetime","message":"T2"}'), ("t", 200, 2, 'A->B: {"type":"event","message":"m4"}')]
    df = spark.createDataFrame(lines, "trace_id string, _block long, _at long, value string")
    got = {r["Message"]: r["Time"] for r in radio_files.diagram_events(df).collect()}
    assert got == {"m1": "T1", "m2": "T1", "m3": "T1", "m4": "T2"}


def test_ingest_and_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,Event\n1704067207,RLF\n")
    events, summary = radio_files.ingest_radio(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert events.count() == 1 and summary.first()["total_events"] == 1
    (tmp_path / "b.csv").write_text("Cell,Event\n1,RLF\n")
    with pytest.raises(ValueError, match="timestamp"):
        radio_files.ingest_radio(spark, str(tmp_path / "b.csv"), str(tmp_path / "out2"))
    with pytest.raises(ValueError, match="unsupported"):
        radio_files.read_radio(spark, str(tmp_path / "b.doc"))


def test_config_files(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"mappings": {"10.0.0.1": "AMF"}, "subnets": {"10.0.0.0/8": "RAN", "10.1.0.0/16": "X"}}))
    exact, nets = dictionary.read_network_map(spark, str(tmp_path / "map.json"))
    assert exact.collect()[0]["name"] == "AMF"
    assert [(r["cidr"], r["ord"]) for r in nets.orderBy("ord").collect()] == [("10.0.0.0/8", 0), ("10.1.0.0/16", 1)]
    (tmp_path / "v.json").write_text(json.dumps({"_c": "x", "X.int": {"codes": {"0x0A": "Ten"}}}))
    assert [tuple(r) for r in dictionary.read_vendor_codes(spark, str(tmp_path / "v.json")).collect()] == [("X.int", "0x0a", "Ten")]


def test_sinks_round_trip(spark, tmp_path):
    out = str(tmp_path / "case")
    flows = spark.createDataFrame([("c", "SIP", 5, 9, 1)], "capture_id string, protocol string, start_us long, packet_count long, first_frame long")
    sinks.write_capture(out, flows.select("capture_id"), flows)
    findings = spark.createDataFrame([("c", "RLF", 7, "critical")], "capture_id string, type string, start_us long, severity string")
    findings.write.parquet(f"{out}/ran_findings")
    events = sinks.load_signal_events(spark, out, "flows", "ran_findings").orderBy("ts_us").collect()
    assert [(e["type"], e["ts_us"], e["severity"]) for e in events] == [("SIP", 5, None), ("RLF", 7, "critical")]
