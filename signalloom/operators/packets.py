"""Packet classification, flows and their rollups.

``packets`` carries capture_id, frame_number (unique per capture), ts_us, length, src_ip, dst_ip,
src_port, dst_port, transport and optionally tcp_flags, gtp_type, gtp_teid, diameter_app_id,
dns_qr, http, sip_status, sip_reason, payload (first bytes of the UDP payload), protocol and
technology.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom import dims

FLOW_KEY = ["capture_id", "ip_a", "port_a", "ip_b", "port_b", "transport"]

# Ports of the protocols, their name in the stack and the technology they imply.
PORT_RULES = [
    ("PFCP", [8805], "5G/NR"),
    ("Diameter", [3868], "4G/LTE"),
    ("NGAP", [38412], "5G/NR"),
    ("S1-AP", [36412], "4G/LTE"),
    ("X2-AP", [36422], "4G/LTE"),
    ("XnAP", [38422], "5G/NR"),
    ("M3UA", [2905, 2906], "2G/3G/SS7"),
    ("SUA", [14001], "2G/3G/SS7"),
    ("SIP", [5060, 5061], "VoLTE/VoNR"),
    ("RTP", [], "VoLTE/VoNR"),
    ("MGCP", [2427, 2727], "VoIP"),
    ("Megaco/H.248", [2944, 2945], "VoIP"),
    ("DNS", [53], None),
    ("RADIUS", [1812, 1813, 3799], "AAA"),
    ("DHCP", [67, 68], None),
]

# Ports and protocol names per technology, first match wins.
TECHNOLOGY_RULES = [
    ("2G/GSM", [2905, 2906, 14001], ["M3UA", "SUA", "MAP", "ISUP"]),
    ("3G/UMTS", [2123, 3386], ["GTP-C", "GTP-C'", "RANAP"]),
    ("4G/LTE", [3868, 36412, 36422, 36443], ["S1-AP", "X2-AP", "Diameter"]),
    (
        "5G/NR",
        [8805, 38412, 38422, 38462, 38472, 38482],
        ["PFCP", "NGAP", "XnAP", "HTTP/2-SBI"],
    ),
    ("VoLTE/VoNR", [5060, 5061, 2427, 2727, 2944, 2945], ["SIP", "RTP", "MGCP", "Megaco"]),
]

# Session family, technology, description, ports, flag column and protocol name.
SESSION_FAMILIES = [
    (
        "5G PFCP Session",
        "5G/NR",
        "Packet Forwarding Control Protocol (N4 interface)",
        [8805],
        None,
        "PFCP",
    ),
    ("5G NGAP Session", "5G/NR", "NG Application Protocol (N2 interface)", [38412], None, "NGAP"),
    ("4G S1-AP Session", "4G/LTE", "S1 Application Protocol (eNB-MME)", [36412], None, "S1-AP"),
    (
        "4G X2-AP Session",
        "4G/LTE",
        "X2 Application Protocol (Inter-eNB handover)",
        [36422],
        None,
        "X2-AP",
    ),
    (
        "Diameter Session",
        "4G/LTE",
        "Diameter signaling (Gx/Gy/S6a/Rx interfaces)",
        [3868],
        "is_diameter",
        "Diameter",
    ),
    (
        "GTP-U Tunnel",
        "3G/4G/5G",
        "GPRS Tunneling Protocol - User Plane",
        [],
        "is_gtp",
        "GTP-U",
    ),
    (
        "GTP-C Session",
        "3G/4G",
        "GPRS Tunneling Protocol - Control Plane",
        [2123],
        None,
        "GTP-C",
    ),
    (
        "M3UA/SS7 Session",
        "2G/3G",
        "MTP3 User Adaptation (SS7 over IP)",
        [2905, 2906],
        None,
        "M3UA",
    ),
    (
        "SIP/VoIP Session",
        "VoLTE/VoNR",
        "Session Initiation Protocol (Voice/Video calls)",
        [5060, 5061],
        None,
        "SIP",
    ),
    (
        "RTP Media Stream",
        "VoLTE/VoNR",
        "Real-time Transport Protocol (Voice/Video media)",
        [],
        None,
        "RTP",
    ),
    (
        "RADIUS Session",
        "AAA",
        "Authentication, Authorization, Accounting",
        [1812, 1813],
        None,
        "RADIUS",
    ),
    ("DNS Session", "Infrastructure", "Domain Name System queries", [53], None, "DNS"),
]


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column, or a typed NULL where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def rtp_payload_type(payload: Column, src_port: Column, dst_port: Column) -> Column:
    """RTP payload type of a UDP payload that looks like RTP, else NULL."""

    def byte(i: int) -> Column:
        return F.conv(F.hex(F.substring(payload, i, 1)), 16, 10).cast("int")

    media_port = src_port.between(16384, 32767) | dst_port.between(16384, 32767)
    version = F.shiftright(byte(1), 6)
    looks = media_port & (F.octet_length(payload) >= 12) & (version == 2)
    return F.when(looks, byte(2).bitwiseAND(0x7F))


def sip_failure(payload_text: Column) -> Column:
    """Struct (code, reason) of a SIP status line from 400 up, else NULL."""
    line = r"SIP/2\.0 (\d{3}) (.+?)\r\n"
    code = F.nullif(F.regexp_extract(payload_text, line, 1), F.lit("")).cast("int")
    reason = F.regexp_extract(payload_text, line, 2)
    return F.when(code >= 400, F.struct(code.alias("code"), reason.alias("reason")))


def with_sip_failures(packets: DataFrame) -> DataFrame:
    """Add sip_status and sip_reason of failing SIP responses, read from the payload."""
    found = packets.withColumn("_f", sip_failure(F.col("payload").cast("string")))
    return found.withColumns(
        {"sip_status": F.col("_f.code"), "sip_reason": F.col("_f.reason")}
    ).drop("_f")


def technology_of(port: str, protocol: str) -> Column:
    """Technology of a port or protocol name (both column names)."""
    cases = " ".join(
        f"WHEN {port} IN ({dims.sql_list(ports)}) OR {protocol} IN ({dims.sql_list(names)})"
        f" THEN '{tech}'"
        for tech, ports, names in TECHNOLOGY_RULES
    )
    return F.expr(f"CASE {cases} ELSE 'Unknown' END")


def classify_packets(packets: DataFrame) -> DataFrame:
    """Add ``protocol`` (stack joined with ``/``) and ``technology`` from ports and layers.

    Each port and layer names at most one protocol, with its place in the stack; the technology is
    that of the last name that has one. Ports are NULL for packets without a transport.
    """
    place = {name: i + 3 for i, (name, _, _) in enumerate(PORT_RULES)}
    implied = {name: tech for name, _, tech in PORT_RULES}

    def entry(i: int, name: str, tech: str | None) -> str:
        tech_text = f"'{tech}'" if tech else "CAST(NULL AS STRING)"
        return f"named_struct('i', {i}, 'name', '{name}', 'tech', {tech_text})"

    ports = {2152: entry(1, "GTP-U", "3G/4G/5G"), 2123: entry(2, "GTP-C", "3G/4G")}
    for name, listed, tech in PORT_RULES:
        ports.update({port: entry(place[name], name, tech) for port in listed})
    table = "map(" + ", ".join(f"{port}, {e}" for port, e in ports.items()) + ")"
    parts = [f"try_element_at({table}, src_port)", f"try_element_at({table}, dst_port)"]
    if "gtp_type" in packets.columns:
        user, control = entry(0, "GTP-U", "3G/4G/5G"), entry(0, "GTP-C", "3G/4G")
        parts.append(f"CASE WHEN gtp_type = 255 THEN {user} WHEN gtp_type <> 255 THEN {control} END")
    out = packets
    layers = {"diameter_app_id": "Diameter", "dns_qr": "DNS"}
    if "payload" in packets.columns:
        media = rtp_payload_type(F.col("payload"), F.col("src_port"), F.col("dst_port"))
        out = out.withColumn("_rtp", F.when(F.col("transport") == "UDP", media))
        layers["_rtp"] = "RTP"
    for column, name in layers.items():
        if column in out.columns:
            named = entry(place[name], name, implied[name])
            parts.append(f"IF({column} IS NOT NULL, {named}, NULL)")
    if "http" in packets.columns:
        parts.append(f"IF(http, {entry(99, 'HTTP', None)}, NULL)")
    web = (
        "CASE WHEN src_port IN (80, 8080) OR dst_port IN (80, 8080) THEN 'HTTP'"
        " WHEN src_port IN (443, 8443) OR dst_port IN (443, 8443) THEN 'HTTPS'"
        " WHEN transport IN ('SCTP', 'TCP', 'UDP', 'ICMP') THEN transport ELSE 'Unknown' END"
    )
    return (
        out.withColumn("_stack", F.expr(f"array_sort(array_compact(array({', '.join(parts)})))"))
        .withColumn("_bare", F.expr(f"IF(size(_stack) = 0, {web}, NULL)"))
        .withColumns(
            {
                "protocol": F.expr("coalesce(_bare, array_join(array_distinct(_stack.name), '/'))"),
                "technology": F.expr(
                    "coalesce(try_element_at(array_compact(_stack.tech), -1), CASE _bare"
                    " WHEN 'HTTPS' THEN '5G/SBI' WHEN 'SCTP' THEN 'Signaling' ELSE 'Unknown' END)"
                ),
            }
        )
        .drop("_stack", "_bare", "_rtp")
    )


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Packets that carry both addresses, with the direction-normalised 5-tuple columns."""
    ported = packets.filter("src_ip is not null and dst_ip is not null").withColumns(
        {
            "src_port": F.expr("coalesce(src_port, 0)"),
            "dst_port": F.expr("coalesce(dst_port, 0)"),
            "transport": F.expr("coalesce(transport, 'Unknown')"),
        }
    )
    forward = "src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)"
    return ported.withColumn("forward", F.expr(forward)).selectExpr(
        "*",
        "IF(forward, src_ip, dst_ip) AS ip_a",
        "IF(forward, src_port, dst_port) AS port_a",
        "IF(forward, dst_ip, src_ip) AS ip_b",
        "IF(forward, dst_port, src_port) AS port_b",
    )


def primary_technology(technologies: str) -> Column:
    """First technology in display order that an array column holds, else its first entry."""
    ranked = ", ".join(
        f"IF(array_contains({technologies}, '{t}'), '{t}', NULL)"
        for t in dims.PRIMARY_TECHNOLOGIES
    )
    return F.expr(f"coalesce({ranked}, get({technologies}, 0), 'Unknown')")


def flows(packets: DataFrame) -> DataFrame:
    """One row per bidirectional 5-tuple; ``packets_out`` and ``bytes_out`` travel from src to dst, the rest back.

    Packets are first reduced per 5-tuple and name combination with fixed-width buffers only (hash
    aggregation with map-side combine, so a hot flow is one row per task before the shuffle); the
    name sets are collected from those few rows. Tunnel ids and application ids are unbounded per
    flow and live in :func:`flow_teids` / :func:`flow_applications`.
    """

    def given(name: str, kind: str) -> str:
        return name if name in packets.columns else f"CAST(NULL AS {kind})"

    names = {
        "protocol": F.expr(f"coalesce({given('protocol', 'string')}, 'Unknown')"),
        "technology": F.expr(given("technology", "string")),
        "tcp_flags": F.expr(given("tcp_flags", "string")),
    }
    cells = (
        with_flow_key(packets)
        .withColumns(names)
        .groupBy(*FLOW_KEY, *names)
        .agg(
            F.expr("count(1) AS n"),
            F.expr("count_if(forward) AS ahead"),
            F.expr("sum(cast(coalesce(length, 0) as bigint)) AS bytes"),
            F.expr("sum(IF(forward, cast(coalesce(length, 0) as bigint), 0L)) AS ahead_bytes"),
            F.expr("min(ts_us) AS start_us"),
            F.expr("max(ts_us) AS end_us"),
            F.expr("min(IF(forward, frame_number, NULL)) AS out_frame"),
            F.expr("min(IF(forward, NULL, frame_number)) AS back_frame"),
            F.expr(f"coalesce(max({given('gtp_teid', 'bigint')} != 0), false) AS is_gtp"),
            F.expr(f"coalesce(max({given('diameter_app_id', 'bigint')} != 0), false) AS is_dia"),
            F.expr(f"count_if({given('sip_status', 'int')} >= 400) AS failures"),
        )
    )
    grouped = cells.groupBy(*FLOW_KEY).agg(
        F.expr("sum(n) AS packet_count"),
        F.expr("sum(bytes) AS total_bytes"),
        F.expr("sum(ahead) AS _ahead"),
        F.expr("sum(ahead_bytes) AS _ahead_bytes"),
        F.expr("min(start_us) AS start_us"),
        F.expr("max(end_us) AS end_us"),
        F.expr("least(min(out_frame), min(back_frame)) AS first_frame"),
        F.expr("least(min(out_frame), min(back_frame)) <=> min(out_frame) AS _out"),
        F.expr("array_sort(collect_set(protocol)) AS protocols"),
        F.expr("array_sort(collect_set(technology)) AS technologies"),
        F.expr("array_sort(collect_set(tcp_flags)) AS tcp_flags"),
        F.expr("max(is_gtp) AS is_gtp"),
        F.expr("max(is_dia) AS is_diameter"),
        F.expr("sum(failures) AS failures"),
    )
    return grouped.selectExpr(
        *FLOW_KEY,
        "IF(_out, ip_a, ip_b) AS src_ip",
        "IF(_out, ip_b, ip_a) AS dst_ip",
        "IF(_out, port_a, port_b) AS src_port",
        "IF(_out, port_b, port_a) AS dst_port",
        "packet_count",
        "total_bytes",
        "IF(_out, _ahead, packet_count - _ahead) AS packets_out",
        "IF(_out, _ahead_bytes, total_bytes - _ahead_bytes) AS bytes_out",
        "start_us",
        "end_us",
        "first_frame",
        "(end_us - start_us) / 1e6D AS duration",
        "packet_count / IF(end_us > start_us, (end_us - start_us) / 1e6D, 1D) AS pps",
        "protocols",
        "array_join(protocols, '/') AS protocol",
        "technologies",
        "IF(size(technologies) > 0, array_join(technologies, '/'), 'Unknown') AS technology",
        "tcp_flags",
        "is_gtp",
        "is_diameter",
        "failures",
        "failures > 0 AS has_errors",
    ).withColumn("primary_tech", primary_technology("technologies"))


def flow_teids(packets: DataFrame) -> DataFrame:
    """Distinct GTP tunnel ids of each flow (TEID 0 is none)."""
    return with_flow_key(packets).filter("gtp_teid != 0").select(*FLOW_KEY, "gtp_teid").distinct()


def flow_applications(packets: DataFrame) -> DataFrame:
    """Distinct Diameter application ids of each flow (0 is none)."""
    keyed = with_flow_key(packets).filter("diameter_app_id != 0")
    return keyed.select(*FLOW_KEY, "diameter_app_id").distinct()


def flow_failures(packets: DataFrame) -> DataFrame:
    """Failures of each flow, counted by error text."""
    failed = with_flow_key(packets).filter("sip_status >= 400")
    text = F.concat_ws(
        " ", F.lit("SIP"), F.col("sip_status"), optional(packets, "sip_reason", "string")
    )
    return failed.groupBy(*FLOW_KEY, text.alias("error")).agg(F.count(F.lit(1)).alias("n"))


def failure_summary(failures: DataFrame) -> DataFrame:
    """Per capture and error text: occurrences and flows concerned."""
    return failures.groupBy("capture_id", "error").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("failed_flows")
    )


def failure_totals(flow_table: DataFrame) -> DataFrame:
    """Per capture: total errors and failed flows."""
    return flow_table.groupBy("capture_id").agg(
        F.sum("failures").alias("total_errors"), F.count_if("has_errors").alias("failed_flows")
    )


def protocol_stats(flow_table: DataFrame) -> DataFrame:
    """Packets per protocol name of the flows."""
    return flow_table.groupBy("capture_id", "protocol").agg(F.sum("packet_count").alias("packets"))


def technology_stats(flow_table: DataFrame) -> DataFrame:
    """Packets per primary technology of the flows."""
    return flow_table.groupBy("capture_id", "primary_tech").agg(
        F.sum("packet_count").alias("packets")
    )


def packets_per_technology(packets: DataFrame) -> DataFrame:
    """Packets per technology."""
    tech = F.coalesce("technology", F.lit("Unknown")).alias("technology")
    return packets.groupBy("capture_id", tech).agg(F.count(F.lit(1)).alias("packets"))


def _families(flow_table: DataFrame) -> DataFrame:
    def member(ports: list[int], flag: str | None, name: str) -> str:
        tests = [f"contains(protocol, '{name}')"]
        if ports:
            listed = dims.sql_list(ports)
            tests.append(f"src_port IN ({listed}) OR dst_port IN ({listed})")
        if flag:
            tests.append(flag)
        return " OR ".join(tests)

    names = ", ".join(
        f"IF({member(ports, flag, name)}, '{family}', NULL)"
        for family, _, _, ports, flag, name in SESSION_FAMILIES
    )
    return flow_table.withColumn("type", F.expr(f"explode(array_compact(array({names})))"))


def telecom_sessions(flow_table: DataFrame) -> DataFrame:
    """Flow, packet and byte totals per session family; a flow may belong to several."""
    totals = (
        _families(flow_table)
        .groupBy("capture_id", "type")
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.sum("packet_count").alias("total_packets"),
            F.sum("total_bytes").alias("total_bytes"),
        )
    )
    return totals.withColumns(
        {
            "technology": dims.lookup({f[0]: f[1] for f in SESSION_FAMILIES}, F.col("type")),
            "description": dims.lookup({f[0]: f[2] for f in SESSION_FAMILIES}, F.col("type")),
        }
    )


def tunnel_teids(teids: DataFrame) -> DataFrame:
    """Per capture: number of distinct tunnel ids and the ten lowest of them."""
    distinct = teids.select("capture_id", "gtp_teid").distinct()
    low = Window.partitionBy("capture_id").orderBy("gtp_teid")
    first = (
        distinct.withColumn("_r", F.row_number().over(low))
        .filter("_r <= 10")
        .groupBy("capture_id")
        .agg(F.array_sort(F.collect_list("gtp_teid")).alias("teids"))
    )
    counts = distinct.groupBy("capture_id").agg(F.count(F.lit(1)).alias("unique_teids"))
    return counts.join(first, "capture_id")


def session_export(sessions: DataFrame) -> DataFrame:
    """Sessions in the export shape: key, generation and KPI struct."""
    tech = F.col("technology")
    generation = F.lit("Unknown")
    for name in ("2G", "3G", "4G", "5G"):
        generation = F.when(tech.contains(name), name).otherwise(generation)
    slug = F.lower(F.replace(F.col("type"), F.lit(" "), F.lit("_")))
    out = sessions.withColumn("generation", generation)
    return out.select(
        "capture_id",
        F.concat_ws(":", F.lower("generation"), slug, F.col("flow_count")).alias("session_key"),
        "generation",
        "type",
        "description",
        F.struct(
            F.col("total_packets").alias("packet_count"),
            F.col("total_bytes").alias("byte_count"),
            F.col("flow_count"),
        ).alias("kpis"),
    )


def endpoint_pairs(flow_table: DataFrame, top: int = 5, samples: int = 3) -> DataFrame:
    """The ``top`` unordered address pairs per capture that share more than one flow."""
    keyed = flow_table.withColumns(
        {"ip_lo": F.least("src_ip", "dst_ip"), "ip_hi": F.greatest("src_ip", "dst_ip")}
    )
    pair = ["capture_id", "ip_lo", "ip_hi"]
    control = F.arrays_overlap(
        F.split("protocol", "/"), F.array(*[F.lit(p) for p in ("GTP-C", "SIP", "Diameter", "PFCP")])
    )
    grouped = (
        keyed.groupBy(*pair)
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.array_sort(F.collect_set("protocol")).alias("protocols"),
            F.array_sort(F.collect_set("primary_tech")).alias("technologies"),
            (F.max(F.col("protocol").contains("GTP-U")) & F.max(control)).alias("is_multi_plane"),
            F.sum("packet_count").alias("total_packets"),
        )
        .filter("flow_count > 1")
    )
    best = Window.partitionBy("capture_id").orderBy(F.desc("total_packets"), "ip_lo", "ip_hi")
    kept = grouped.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    busiest = Window.partitionBy(*pair).orderBy(F.desc("packet_count"), "first_frame")
    sample = (
        keyed.withColumn("_r", F.row_number().over(busiest))
        .filter(F.col("_r") <= samples)
        .groupBy(*pair)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("_r", "src_ip", "src_port", "dst_ip", "dst_port", "packet_count")
                )
            ).alias("sample_flows")
        )
    )
    return kept.join(sample, pair)


def capture_summary(packets: DataFrame, flow_table: DataFrame) -> DataFrame:
    """Per capture: flows, packets, bytes, protocol names and time span."""
    spans = packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
    )
    totals = flow_table.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("total_bytes").alias("total_bytes"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
    )
    out = spans.join(totals, "capture_id", "left")
    return out.withColumn("duration", (F.col("end_us") - F.col("start_us")) / 1e6)


def io_statistics(packets: DataFrame, seconds: int = 1) -> DataFrame:
    """Frames and bytes per interval."""
    width = seconds * 1_000_000
    slot = F.expr(f"(ts_us div {width}L) * {width}L").alias("interval_us")
    return packets.groupBy("capture_id", slot).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("length").cast("bigint").alias("bytes")
    )


def sctp_statistics(fields: DataFrame) -> DataFrame:
    """Chunks, aborts (chunk type 6) and retransmissions per SCTP association."""
    rows = fields.filter("sctp_verification_tag is not null")
    return rows.groupBy("capture_id", "sctp_verification_tag").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("sctp_chunk_type") == "6").alias("aborts"),
        F.count_if(F.col("sctp_retransmission") == "1").alias("retransmissions"),
    )


def by_packet_count(flow_table: DataFrame) -> DataFrame:
    """Flows, busiest first."""
    return flow_table.orderBy(F.desc("packet_count"), "capture_id", "first_frame")


def flow_page(flow_table: DataFrame, capture_id: str, offset: int, limit: int) -> DataFrame:
    """One page of the flows of a capture, busiest first, with the total on every row."""
    mine = flow_table.filter(F.col("capture_id") == capture_id)
    total = mine.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total"))
    page = mine.orderBy(F.desc("packet_count"), "first_frame").offset(offset).limit(limit)
    return page.join(total, "capture_id")


def search_flows(flow_table: DataFrame, term: str) -> DataFrame:
    """Flows whose addresses, protocol or technology contain ``term`` in any case."""
    needle = term.lower()
    hit = F.lit(False)
    for name in ("src_ip", "dst_ip", "protocol", "primary_tech"):
        hit = hit | F.lower(F.col(name)).contains(needle)
    return flow_table.filter(hit)


def top_protocols(flow_table: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` protocols with most packets per capture."""
    best = Window.partitionBy("capture_id").orderBy(F.desc("packets"), "protocol")
    ranked = protocol_stats(flow_table).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= n)


def top_flows(flow_table: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` busiest flows per capture, with their rank."""
    best = Window.partitionBy("capture_id").orderBy(F.desc("packet_count"), "first_frame")
    return flow_table.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
