import random

from pyspark.sql import functions as F

from signalloom.operators import correlate, handover, nodes, ran, rtp, sip

RAN = "capture_id string, frame_number long, ts_us long, protocol string, procedure_code int"


def _finding(spark, call, code, at):
    calls = spark.createDataFrame([call], "capture_id string, call_id string, start_us long, end_us long, state string, reason_header string")
    events = spark.createDataFrame([("c", 1, at, "S1AP", code)], RAN)
    evidence = handover.ran_evidence(events)
    assert evidence.count() == 1
    joined = handover.hints_with_ran(handover.sip_hints(calls), evidence)
    return handover.handover_findings(joined).first()


def test_srvcc(spark):
    call = ("c", "call_1", 990_000_000, 1_000_000_000, "TERMINATED", 'SIP;cause=503;text="Handover triggered"')
    found = _finding(spark, call, 0, 1_000_100_000)
    assert found["classification"] == "PROVEN_PS_TO_CS_HANDOVER"
    assert (found["confidence_level"], found["confidence_pct"]) == ("HIGH", 90)
    assert found["evidence"][-1] == "S1AP Procedure 0"


def test_csfb(spark):
    call = ("c", "call_2", 1_990_000_000, 2_000_000_000, "FAILED", 'SIP;cause=380;text="CS Fallback required"')
    found = _finding(spark, call, 25, 2_000_100_000)
    assert "CSFB" in found["classification"] and found["is_setup_failure"]


def test_call_edges(spark):
    s = 1_000_000
    rows = []

    def call(name, *messages):
        for i, (kind, code, at) in enumerate(messages):
            rows.append(("c", len(rows) + i, int(at * s), name, kind, code, None))

    call("early", ("INVITE", None, 0), ("Response", 180, 1), ("Response", 200, 2), ("BYE", None, 4.9))
    call("normal", ("INVITE", None, 0), ("Response", 200, 2), ("BYE", None, 5.0))
    call("refused", ("INVITE", None, 0), ("Response", 486, 1))
    call("challenge", ("INVITE", None, 0), ("Response", 401, 1), ("INVITE", None, 2), ("Response", 200, 3))
    call("refresh", ("INVITE", None, 0), ("Response", 200, 1), ("INVITE", None, 7), ("BYE", None, 20), ("INVITE", None, 30))
    call("lost", ("INVITE", None, 0), ("Response", 100, 1))
    call("cancelled", ("INVITE", None, 0), ("CANCEL", None, 1), ("Response", 487, 2))
    call("reg", ("REGISTER", None, 0), ("Response", 401, 1), ("Response", 200, 2))
    df = spark.createDataFrame(rows, "capture_id string, frame_number long, ts_us long, call_id string, msg_type string, status_code int, reason string")
    got = {r["call_id"]: r for r in sip.calls(df).collect()}
    assert (got["early"]["end_reason"], got["early"]["classification"]) == ("DROP_IMMEDIATE_BYE", "EARLY_DROP")
    assert (got["normal"]["end_reason"], got["normal"]["state"]) == ("NORMAL_CLEARING", "TERMINATED")
    assert got["refused"]["classification"] == "REJECTED_4XX"
    assert got["challenge"]["end_reason"] == "SIP_ERROR_401"
    assert got["refresh"]["timing"]["refresh_us"] == 7 * s
    assert got["lost"]["end_reason"] == "INVITE_SETUP_TIMEOUT"
    assert got["cancelled"]["classification"] == "CANCELLED_BY_CALLER"
    (reg,) = sip.registrations(df).collect()
    assert (reg["state"], reg["method"]) == ("SUCCESS", "REGISTER")
    from signalloom.config import CallRules

    lenient = {r["call_id"]: r for r in sip.calls(df, rules=CallRules(ignore_challenges=True)).collect()}
    assert lenient["challenge"]["state"] == "ESTABLISHED"


def test_rtp_wrap_and_duplicates(spark):
    seqs = [65534, 65535, 0, 0, 1, 3]
    rows = [("c", i, i * 20_000, "call", "0x1", q, (q + 2 if q < 100 else q - 65534) * 160) for i, q in enumerate(seqs)]
    schema = "capture_id string, frame_number long, ts_us long, call_id string, ssrc string, seq int, rtp_ts long"
    df = spark.createDataFrame(rows, schema)
    for span in (2, 1 << 22):
        (got,) = rtp.rtp_streams(df, span=span).collect()
        assert (got["packet_count"], got["duplicates"], got["out_of_order"]) == (6, 1, 0)
        assert abs(got["packet_loss_pct"] - 100 / 6) < 1e-9


def test_congestion_threshold(spark):
    rows = [("c", "u", i, i * 555_555, "4G", "S1AP", "Paging", None) for i in range(9)]
    schema = "capture_id string, ue_key string, frame_number long, ts_us long, generation string, protocol string, procedure_label string, cause_label string"
    assert ran.signalling_congestion(spark.createDataFrame(rows, schema)).count() == 0
    rows.append(("c", "u", 9, 5_000_000, "4G", "S1AP", "Paging", "Overload"))
    (found,) = ran.signalling_congestion(spark.createDataFrame(rows, schema)).collect()
    assert (found["confidence"], found["evidence"], found["end_us"]) == ("HIGH", ["Frames 0 to 9"], 5_000_000)


def test_handover_failure_window(spark):
    schema = "capture_id string, ue_key string, frame_number long, ts_us long, generation string, protocol string, procedure_label string, cause_label string"
    rows = [
        ("c", "u", 1, 0, "4G", "S1AP", "HandoverPreparation", None),
        ("c", "u", 2, 0, "4G", "S1AP", "HandoverCancel", None),
        ("c", "u", 3, 3_000_000, "4G", "S1AP", "UEContextRelease", "who knows"),
        ("c", "u", 4, 3_000_000, "4G", "S1AP", "HandoverFailure", None),
        ("c", "u", 5, 9_000_000, "4G", "S1AP", "HandoverPreparation", None),
        ("c", "u", 6, 12_000_001, "4G", "S1AP", "HandoverCancel", None),
    ]
    (found,) = ran.handover_failures(spark.createDataFrame(rows, schema)).collect()
    assert (found["start_us"], found["end_us"], found["confidence_pct"]) == (0, 3_000_000, 70)


def _score(signal, radio):
    base = 0
    for i, weight in enumerate((95, 85, 85, 80, 70)):
        if signal[3 + i] is not None and signal[3 + i] == radio[3 + i]:
            base = max(base, weight)
    if signal[2] is None:
        return base
    gap = abs(signal[2] - radio[2])
    if base == 0:
        return 60 if gap <= 5_000_000 else 45 if gap <= 10_000_000 else 30 if gap <= 20_000_000 else 0
    return min(base + 10, 99) if gap <= 5_000_000 else min(base + 5, 95) if gap <= 10_000_000 else base


def test_correlation_equals_all_pairs(spark):
    rng = random.Random(9)

    def rows(n):
        return [
            ("t", i, rng.choice([None, rng.randint(0, 400) * 1_000_000]) if n == 70 else rng.randint(0, 400) * 1_000_000,
             *[rng.choice([None, None, None, "1", "2"]) for _ in range(5)])
            for i in range(n)
        ]

    left, right = rows(70), rows(60)
    ids = "imsi string, guti string, tmsi string, ue_ip string, cell_id string"
    signals = spark.createDataFrame(left, f"trace_id string, event_no long, ts_us long, {ids}").withColumn("type", F.lit("SIP"))
    radio = spark.createDataFrame(right, f"trace_id string, row_no long, ts_us long, {ids}").withColumn("event_type", F.lit("RLF"))
    want = {}
    for r in right:
        best = max(((_score(s, r), -s[1]) for s in left), default=(0, 0))
        if best[0] >= 30:
            want[r[1]] = (best[0], -best[1])
    got = {r["row_no"]: (r["confidence_pct"], r["event_no"]) for r in correlate.find_correlations(signals, radio).collect()}
    assert got == want


def test_subnet_names(spark):
    ips = spark.createDataFrame([("10.0.0.9",), ("10.1.2.3",), ("8.8.8.8",), ("9.9.9.9",), ("fe80::1",), ("300.1.1.1",)], "ip string")
    exact = spark.createDataFrame([("8.8.8.8", "DNS_Google")], "ip string, name string")
    nets = spark.createDataFrame([("10.0.0.0/8", "Wide", 0), ("10.0.0.0/24", "Narrow", 1)], "cidr string, name string, ord int")
    got = {r["ip"]: r["name"] for r in nodes.resolve_addresses(ips, exact, nets).collect()}
    assert got == {"10.0.0.9": "Wide_9", "10.1.2.3": "Wide_3", "8.8.8.8": "DNS_Google", "9.9.9.9": "9.9.9.9", "fe80::1": "fe80::1", "300.1.1.1": "300.1.1.1"}


def test_rtp_over_several_wraps(spark):
    rows = spark.range(140_000).filter("id % 10 <> 3").selectExpr(
        "'c' AS capture_id", "'k' AS call_id", "'s' AS ssrc", "id AS frame_number", "id * 20000 AS ts_us",
        "cast((id + 60000) % 65536 as int) AS seq", "id * 160 AS rtp_ts")
    for strict in (False, True):
        (got,) = rtp.rtp_streams(rows, span=5000, strict=strict).collect()
        assert (got["packet_count"], got["duplicates"], got["out_of_order"]) == (126_000, 0, 0)
        assert abs(got["packet_loss_pct"] - 14_000 / 140_000 * 100) < 0.01 and got["jitter_ms"] == 0


def test_late_packet_before_a_wrap(spark):
    seqs = [65534, 0, 65535, 1, 1]
    rows = [("c", "k", "s", i, i * 20000, q, i * 160) for i, q in enumerate(seqs)]
    df = spark.createDataFrame(rows, "capture_id string, call_id string, ssrc string, frame_number long, ts_us long, seq int, rtp_ts long")
    for span in (2, 100):
        (got,) = rtp.rtp_streams(df, span=span).collect()
        assert (got["packet_count"], got["duplicates"], got["out_of_order"], got["packet_loss_pct"]) == (5, 1, 1, 0.0)


def test_one_way_audio_needs_one_direction(spark):
    from signalloom.operators import media as m
    from signalloom.operators import packets as p

    def packets(rows):
        cells = [("c", i, i * 1000, 100, s, d, sp, dp, "UDP", "RTP", "VoLTE/VoNR") for i, (s, sp, d, dp) in enumerate(rows)]
        return spark.createDataFrame(cells, "capture_id string, frame_number long, ts_us long, length int, src_ip string, dst_ip string, src_port int, dst_port int, transport string, protocol string, technology string")

    ends = {"one": (4000, 5000), "two": (4100, 5100), "split": (4200, 5200)}
    there = lambda k: ("10.0.0.1", ends[k][0], "10.9.9.9", ends[k][1])
    rows = [there("one")] * 20 + [there("two")] * 20 + [there("two")[2:] + there("two")[:2]] * 20
    rows += [there("split")] * 20 + [("10.9.9.9", 7000, "10.0.0.1", 4200)] * 20
    lines = [("c", k, "audio", "AMR", ph, ip, port) for k, (a, b) in ends.items() for ph, ip, port in (("offer", "10.0.0.1", a), ("answer", "10.9.9.9", b))]
    media = spark.createDataFrame(lines, "capture_id string, call_id string, type string, codec string, phase string, ip string, port int")
    calls = spark.createDataFrame([("c", k, "ESTABLISHED", 0, 10**6) for k in ends], "capture_id string, call_id string, state string, start_us long, end_us long")
    streams = m.media_streams(media, m.media_traffic(packets(rows)), calls).cache()
    whole = m.media_streams(media, m.flow_traffic(p.flows(packets(rows))), calls)
    names = sorted(set(streams.columns) - {"duration_sec", "first_frame"})
    assert sorted(map(tuple, streams.select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))
    got = {(r["call_id"], r["direction"]): r["packets"] for r in streams.groupBy("call_id", "direction").agg({"packets": "sum"}).withColumnRenamed("sum(packets)", "packets").collect()}
    assert got == {("one", "UE->Network"): 20, ("two", "UE->Network"): 20, ("two", "Network->UE"): 20, ("split", "UE->Network"): 20, ("split", "Network->UE"): 20}
    assert [r["call_id"] for r in m.one_way_audio(streams, calls).collect()] == ["one"]


def _reused_port(spark, n):
    """n calls of 10 s, a minute apart, on one endpoint: 20 packets towards it in the first five seconds of each."""
    lines = [("c", f"k{i}", "audio", "AMR", "offer", "10.0.0.1", 4000) for i in range(n)]
    media_ = spark.createDataFrame(lines, "capture_id string, call_id string, type string, codec string, phase string, ip string, port int")
    calls = [("c", f"k{i}", "TERMINATED", i * 60_000_000, i * 60_000_000 + 10_000_000) for i in range(n)]
    calls = spark.createDataFrame(calls, "capture_id string, call_id string, state string, start_us long, end_us long")
    packets = [("c", i * 20 + k, i * 60_000_000 + k * 250_000, 100, "10.9.9.9", "10.0.0.1", 5000, 4000, "s", i * 20 + k, k * 160) for i in range(n) for k in range(20)]
    names = "capture_id string, frame_number long, ts_us long, length int, src_ip string, dst_ip string, src_port int, dst_port int, ssrc string, seq int, rtp_ts long"
    return media_, calls, spark.createDataFrame(packets, names)


def test_media_of_a_reused_port(spark):
    from signalloom.operators import media as m

    for n in (5, 40):
        lines, calls, packets = _reused_port(spark, n)
        got = m.media_streams(lines, m.media_traffic(packets), calls).collect()
        assert sorted((r["call_id"], r["packets"], r["bytes"], r["duration_sec"]) for r in got) == sorted((f"k{i}", 20, 2000, 4.75) for i in range(n))
        streams = rtp.streams_of_calls(packets, lines, calls).collect()
        assert sorted((r["call_id"], r["packet_count"], r["packet_loss_pct"]) for r in streams) == sorted((f"k{i}", 20, 0.0) for i in range(n))
    # all calls judged by their own media alone
    quiet = m.silent_calls(m.media_streams(lines, m.media_traffic(packets), calls), calls)
    assert quiet.count() == 0


def test_open_calls_hold_their_media(spark):
    from signalloom.config import MediaRules
    from signalloom.operators import media as m

    lines, calls, packets = _reused_port(spark, 2)
    calls = calls.withColumn("state", F.lit("ESTABLISHED"))
    got = m.media_streams(lines, m.media_traffic(packets), calls, MediaRules(open_us=60_000_000))
    assert {(r["call_id"], r["packets"]) for r in got.collect()} == {("k0", 40), ("k1", 20)}
    nulls = packets.withColumn("ts_us", F.lit(None).cast("long"))
    assert m.media_streams(lines, m.media_traffic(nulls), calls).count() == 0
    assert m.media_streams(lines.limit(0), m.media_traffic(packets), calls).count() == 0


def test_seconds_of_one_direction_share_a_row(spark):
    from signalloom.operators import media as m

    _, _, packets = _reused_port(spark, 3)
    (row, *rest) = sorted(m.media_traffic(packets).collect(), key=lambda r: r["from_us"])
    assert len(rest) <= 3 and sum(row[f"packets_{k}"] for k in range(m.BLOCK)) == 20
    assert (row["begin_1"], row["until_1"], row["first_frame_1"], row["bytes_1"], row["packets_5"]) == (1_000_000, 1_750_000, 4, 400, 0)


def test_media_streams_equal_a_plain_count(spark):
    from collections import defaultdict

    from signalloom.config import MediaRules
    from signalloom.operators import media as m

    rng = random.Random(11)
    rules = MediaRules(slack_us=300_000, open_us=4_000_000)
    a, b, c = ("10.0.0.1", 4000), ("10.0.0.2", 5000), ("10.9.9.9", 6000)
    lines = [("c", f"k{i}", "audio", "AMR", ph, *rng.choice([a, b])) for i in range(12) for ph in ("offer", "answer")] * 2
    calls = []
    for i in range(12):
        begin = rng.randint(-9_000_000, 40_000_000)
        calls.append(("c", f"k{i}", rng.choice(["ESTABLISHED", "TERMINATED", "FAILED"]), begin, begin + rng.randint(0, 20_000_000)))
    packets = []
    for i in range(900):
        src, dst = rng.sample([a, b, c], 2)
        packets.append(("c", rng.randint(0, 10**6), rng.randint(-12_000_000, 60_000_000), rng.choice([None, 100, 60]), src[0], dst[0], src[1], dst[1]))
    packets += packets[:50] + [("c", 1, None, 1, a[0], b[0], a[1], b[1]), ("c", 1, 5, 1, None, b[0], a[1], b[1])]

    parts = defaultdict(list)
    for _, frame, ts, length, *ends in packets:
        if ts is not None and None not in ends:
            parts[(*ends, ts // rules.slot_us)].append((ts, frame, length or 0))
    want = defaultdict(set)
    for _, call, _, _, phase, ip, port in lines:
        (state, begin, end) = next(x[2:] for x in calls if x[1] == call)
        live, gone = begin - rules.slack_us, end + rules.slack_us + (rules.open_us if state == "ESTABLISHED" else 0)
        for (src, dst, sport, dport, slot), rows in parts.items():
            for towards, at in ((True, (dst, dport)), (False, (src, sport))):
                if at == (ip, port) and min(rows)[0] <= gone and max(rows)[0] >= live:
                    way = "Network->UE" if towards == (phase == "offer") else "UE->Network"
                    want[call, src, sport, dst, dport, way].add((src, dst, sport, dport, slot))
    want = {
        (*key, sum(len(parts[p]) for p in hit), sum(x[2] for p in hit for x in parts[p]),
         (max(max(parts[p])[0] for p in hit) - min(min(parts[p])[0] for p in hit)) / 1e6, min(x[1] for p in hit for x in parts[p]))
        for key, hit in want.items()
    }
    # ports may be long on one side
    df = spark.createDataFrame(packets, "capture_id string, frame_number long, ts_us long, length int, src_ip string, dst_ip string, src_port long, dst_port long")
    media_ = spark.createDataFrame(lines, "capture_id string, call_id string, type string, codec string, phase string, ip string, port int")
    table = spark.createDataFrame(calls, "capture_id string, call_id string, state string, start_us long, end_us long")
    got = m.media_streams(media_, m.media_traffic(df, rules), table, rules).select(
        "call_id", "src_ip", "src_port", "dst_ip", "dst_port", "direction", "packets", "bytes", "duration_sec", "first_frame"
    )
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want


def test_traffic_of_no_call_is_not_dealt(spark):
    from signalloom.operators import media as m

    lines, calls, packets = _reused_port(spark, 2)
    out = m.media_streams(lines, m.media_traffic(packets), calls)
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    # ends are held against the endpoints of calls before they are dealt to meet their times
    assert ["LeftSemi" in j for j in joins] == [False, True]
