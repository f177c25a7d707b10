from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.catalog.base import Inputs, joined, r, register
from signalloom.operators import packets as ops


def _classified(t: Inputs) -> DataFrame:
    return ops.classify_packets(t.packets)


def _flows(t: Inputs) -> DataFrame:
    return ops.flows(_classified(t))


# Protocol stack and technology of the derived packets, whose ports come from part % 12.
_CLASSIFIED = """
fx_classified AS (
  SELECT *, CASE WHEN port = 5060 THEN 'SIP' WHEN port = 2123 THEN 'GTP-C' WHEN port = 2152 THEN 'GTP-U'
      WHEN port = 8805 THEN 'PFCP' WHEN port = 3868 THEN 'Diameter' WHEN port = 38412 THEN 'NGAP'
      WHEN port = 53 THEN 'DNS' WHEN port = 36412 THEN 'S1-AP' WHEN port = 1812 THEN 'RADIUS'
      WHEN port = 2905 THEN 'M3UA' WHEN port = 443 THEN 'HTTPS' ELSE transport END AS protocol,
    CASE WHEN port = 5060 THEN 'VoLTE/VoNR' WHEN port = 2123 THEN '3G/4G' WHEN port = 2152 THEN '3G/4G/5G'
      WHEN port IN (8805, 38412) THEN '5G/NR' WHEN port IN (3868, 36412) THEN '4G/LTE'
      WHEN port = 1812 THEN 'AAA' WHEN port = 2905 THEN '2G/3G/SS7' WHEN port = 443 THEN '5G/SBI'
      ELSE 'Unknown' END AS technology
  FROM (SELECT *, CASE WHEN src_port BETWEEN 40000 AND 40002 THEN dst_port ELSE src_port END AS port
        FROM fx_packets)
)"""

_FLOWS = (
    _CLASSIFIED
    + """,
fx_keyed AS (
  SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS fwd FROM fx_classified
),
fx_flows AS (
  SELECT capture_id,
    CASE WHEN fwd THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN fwd THEN src_port ELSE dst_port END AS port_a,
    CASE WHEN fwd THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN fwd THEN dst_port ELSE src_port END AS port_b,
    transport,
    arg_min(src_ip, frame_number) AS src_ip, arg_min(dst_ip, frame_number) AS dst_ip,
    arg_min(src_port, frame_number) AS src_port, arg_min(dst_port, frame_number) AS dst_port,
    count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS total_bytes, arg_min(fwd, frame_number) AS out_fwd,
    count(*) FILTER (fwd) AS ahead, CAST(coalesce(sum(length) FILTER (fwd), 0) AS BIGINT) AS ahead_bytes,
    min(ts_us) AS start_us, max(ts_us) AS end_us, min(frame_number) AS first_frame,
    string_agg(DISTINCT protocol, '/' ORDER BY protocol) AS protocol,
    string_agg(DISTINCT technology, '/' ORDER BY technology) AS technology,
    list(DISTINCT technology) AS technologies,
    coalesce(string_agg(DISTINCT tcp_flags, '|' ORDER BY tcp_flags), '') AS tcp_flags,
    coalesce(bool_or(gtp_teid <> 0), false) AS is_gtp,
    coalesce(bool_or(diameter_app_id <> 0), false) AS is_diameter,
    count(*) FILTER (sip_status >= 400) AS failures
  FROM fx_keyed GROUP BY 1, 2, 3, 4, 5, 6
),
fx_flow AS (
  SELECT *, coalesce(
      CASE WHEN list_contains(technologies, '5G/NR') THEN '5G/NR' WHEN list_contains(technologies, '5G/SBI') THEN '5G/SBI'
        WHEN list_contains(technologies, '4G/LTE') THEN '4G/LTE' WHEN list_contains(technologies, 'VoLTE/VoNR') THEN 'VoLTE/VoNR'
        WHEN list_contains(technologies, '2G/3G/SS7') THEN '2G/3G/SS7' END, list_sort(technologies)[1]) AS primary_tech,
    CASE WHEN end_us > start_us THEN packet_count / ((end_us - start_us) / 1e6) ELSE packet_count END AS pps,
    failures > 0 AS has_errors, CASE WHEN out_fwd THEN ahead ELSE packet_count - ahead END AS packets_out,
    CASE WHEN out_fwd THEN ahead_bytes ELSE total_bytes - ahead_bytes END AS bytes_out
  FROM fx_flows
)"""
)


@register(
    "p1_protocol_stack",
    f"""WITH {_CLASSIFIED}
    SELECT capture_id, frame_number, protocol, technology FROM fx_classified""",
)
def _(t: Inputs) -> DataFrame:
    return _classified(t).select("capture_id", "frame_number", "protocol", "technology")


@register(
    "p2_technology_by_port",
    """SELECT port, transport, CASE WHEN port IN (2905, 2906, 14001) THEN '2G/GSM'
      WHEN port IN (2123, 3386) THEN '3G/UMTS' WHEN port IN (3868, 36412, 36422, 36443) THEN '4G/LTE'
      WHEN port IN (8805, 38412, 38422, 38462, 38472, 38482) THEN '5G/NR'
      WHEN port IN (5060, 5061, 2427, 2727, 2944, 2945) THEN 'VoLTE/VoNR' ELSE 'Unknown' END AS technology,
      count(*) AS packets
    FROM (SELECT dst_port AS port, transport FROM fx_packets) GROUP BY 1, 2, 3""",
)
def _(t: Inputs) -> DataFrame:
    tech = ops.technology_of("dst_port", "transport").alias("technology")
    return t.packets.groupBy(F.col("dst_port").alias("port"), "transport", tech).agg(
        F.count(F.lit(1)).alias("packets")
    )


@register(
    "p5_addressed_packets",
    """SELECT capture_id, count(*) AS packets FROM fx_packets
    WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return ops.with_flow_key(t.packets).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets")
    )


_FLOW_COLUMNS = [
    *ops.FLOW_KEY,
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "packet_count",
    "total_bytes",
    "start_us",
    "end_us",
    "first_frame",
    "protocol",
    "technology",
    "primary_tech",
    "is_gtp",
    "is_diameter",
    "failures",
    "has_errors",
]


@register(
    "a1_flows",
    f"""WITH {_FLOWS}
    SELECT {", ".join(_FLOW_COLUMNS)}, tcp_flags, round(pps, 6) AS pps,
      round((end_us - start_us) / 1e6, 6) AS duration FROM fx_flow""",
)
def _(t: Inputs) -> DataFrame:
    return _flows(t).select(*_FLOW_COLUMNS, joined("tcp_flags"), r("pps"), r("duration"))


_KEYS = """CASE WHEN fwd THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN fwd THEN src_port ELSE dst_port END AS port_a,
    CASE WHEN fwd THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN fwd THEN dst_port ELSE src_port END AS port_b"""


@register(
    "a1_flow_teids",
    f"""WITH {_FLOWS}
    SELECT DISTINCT capture_id, {_KEYS}, transport, gtp_teid FROM fx_keyed WHERE gtp_teid <> 0""",
)
def _(t: Inputs) -> DataFrame:
    return ops.flow_teids(t.packets)


@register(
    "a1_flow_applications",
    f"""WITH {_FLOWS}
    SELECT DISTINCT capture_id, {_KEYS}, transport, diameter_app_id FROM fx_keyed
    WHERE diameter_app_id <> 0""",
)
def _(t: Inputs) -> DataFrame:
    return ops.flow_applications(t.packets)


@register(
    "a2_protocol_stats",
    f"""WITH {_FLOWS}
    SELECT capture_id, protocol, CAST(sum(packet_count) AS BIGINT) AS packets FROM fx_flow GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return ops.protocol_stats(_flows(t))


@register(
    "a3_technology_stats",
    f"""WITH {_FLOWS}
    SELECT capture_id, primary_tech, CAST(sum(packet_count) AS BIGINT) AS packets FROM fx_flow GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return ops.technology_stats(_flows(t))


@register(
    "a4_failure_summary",
    f"""WITH {_FLOWS}
    SELECT capture_id, concat('SIP ', sip_status, ' ', sip_reason) AS error, count(*) AS occurrences,
      count(DISTINCT (fwd, src_ip, dst_ip, src_port, dst_port)) FILTER (fwd)
        + count(DISTINCT (src_ip, dst_ip, src_port, dst_port)) FILTER (NOT fwd AND NOT EXISTS (
            SELECT 1 FROM fx_keyed k WHERE k.fwd AND k.capture_id = x.capture_id AND k.sip_status = x.sip_status
              AND k.src_ip = x.dst_ip AND k.dst_ip = x.src_ip AND k.src_port = x.dst_port
              AND k.dst_port = x.src_port)) AS failed_flows
    FROM fx_keyed x WHERE sip_status >= 400 GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return ops.failure_summary(ops.flow_failures(t.packets))


@register(
    "a4_failure_totals",
    f"""WITH {_FLOWS}
    SELECT capture_id, CAST(sum(failures) AS BIGINT) AS total_errors,
      count(*) FILTER (has_errors) AS failed_flows FROM fx_flow GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return ops.failure_totals(_flows(t))


_FAMILIES = """
fx_family AS (
  SELECT f.*, x.type FROM fx_flow f, (VALUES ('5G PFCP Session', 8805, 8805, 'PFCP'), ('5G NGAP Session', 38412, 38412, 'NGAP'),
    ('4G S1-AP Session', 36412, 36412, 'S1-AP'), ('4G X2-AP Session', 36422, 36422, 'X2-AP'),
    ('Diameter Session', 3868, 3868, 'Diameter'), ('GTP-U Tunnel', -1, -1, 'GTP-U'), ('GTP-C Session', 2123, 2123, 'GTP-C'),
    ('M3UA/SS7 Session', 2905, 2906, 'M3UA'), ('SIP/VoIP Session', 5060, 5061, 'SIP'), ('RTP Media Stream', -1, -1, 'RTP'),
    ('RADIUS Session', 1812, 1813, 'RADIUS'), ('DNS Session', 53, 53, 'DNS')) x(type, p1, p2, name)
  WHERE src_port IN (p1, p2) OR dst_port IN (p1, p2) OR contains(protocol, name)
    OR (name = 'GTP-U' AND is_gtp) OR (name = 'Diameter' AND is_diameter)
)"""


@register(
    "a5_telecom_sessions",
    f"""WITH {_FLOWS}, {_FAMILIES}
    SELECT capture_id, type, count(*) AS flow_count, CAST(sum(packet_count) AS BIGINT) AS total_packets,
      CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM fx_family GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return ops.telecom_sessions(_flows(t)).drop("technology", "description")


@register(
    "a5_tunnel_teids",
    """SELECT capture_id, count(*) AS unique_teids,
      array_to_string(list_sort(list(gtp_teid))[1:10], '|') AS teids
    FROM (SELECT DISTINCT capture_id, gtp_teid FROM fx_packets WHERE gtp_teid <> 0) GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.tunnel_teids(ops.flow_teids(t.packets))
    return out.select("capture_id", "unique_teids", joined("teids"))


@register(
    "p27_session_export",
    f"""WITH {_FLOWS}, {_FAMILIES}
    SELECT capture_id, concat(lower(generation), ':', replace(lower(type), ' ', '_'), ':', n) AS session_key,
      generation, type, packets AS packet_count, bytes AS byte_count, n AS flow_count
    FROM (SELECT capture_id, type, count(*) AS n, CAST(sum(packet_count) AS BIGINT) AS packets,
        CAST(sum(total_bytes) AS BIGINT) AS bytes,
        CASE WHEN type IN ('5G PFCP Session', '5G NGAP Session', 'GTP-U Tunnel') THEN '5G'
          WHEN type IN ('4G S1-AP Session', '4G X2-AP Session', 'Diameter Session', 'GTP-C Session') THEN '4G'
          WHEN type = 'M3UA/SS7 Session' THEN '3G' ELSE 'Unknown' END AS generation
      FROM fx_family GROUP BY 1, 2)""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.session_export(ops.telecom_sessions(_flows(t)))
    return out.select("capture_id", "session_key", "generation", "type", "kpis.*")


_PAIRS = """
fx_pairs AS (
  SELECT capture_id, least(src_ip, dst_ip) AS ip_lo, greatest(src_ip, dst_ip) AS ip_hi, count(*) AS flow_count,
    string_agg(DISTINCT protocol, '|' ORDER BY protocol) AS protocols,
    string_agg(DISTINCT primary_tech, '|' ORDER BY primary_tech) AS technologies,
    bool_or(contains(protocol, 'GTP-U')) AND bool_or(protocol IN ('GTP-C', 'SIP', 'Diameter', 'PFCP')) AS is_multi_plane,
    CAST(sum(packet_count) AS BIGINT) AS total_packets
  FROM fx_flow GROUP BY 1, 2, 3 HAVING count(*) > 1
)"""


@register(
    "a6_endpoint_pairs",
    f"""WITH {_FLOWS}, {_PAIRS},
    samples AS (
      SELECT capture_id, ip_lo, ip_hi, string_agg(concat(src_ip, ':', src_port), '|' ORDER BY n) AS samples
      FROM (SELECT *, least(src_ip, dst_ip) AS ip_lo, greatest(src_ip, dst_ip) AS ip_hi, row_number() OVER (
          PARTITION BY capture_id, least(src_ip, dst_ip), greatest(src_ip, dst_ip)
          ORDER BY packet_count DESC, first_frame) AS n FROM fx_flow) WHERE n <= 3 GROUP BY 1, 2, 3)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id
        ORDER BY total_packets DESC, ip_lo, ip_hi) AS rank FROM fx_pairs)
    JOIN samples USING (capture_id, ip_lo, ip_hi) WHERE rank <= 5""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.endpoint_pairs(_flows(t))
    ends = F.transform(
        "sample_flows", lambda s: F.concat_ws(":", s["src_ip"], s["src_port"].cast("string"))
    )
    return out.select(
        "capture_id",
        "ip_lo",
        "ip_hi",
        "flow_count",
        "is_multi_plane",
        "total_packets",
        F.col("rank").cast("bigint").alias("rank"),
        joined("protocols"),
        joined("technologies"),
        F.array_join(ends, "|").alias("samples"),
    )


@register(
    "a39_capture_summary",
    f"""WITH {_FLOWS}
    SELECT capture_id, total_packets, start_us, end_us, total_flows, total_bytes, protocols,
      round((end_us - start_us) / 1e6, 6) AS duration
    FROM (SELECT capture_id, count(*) AS total_packets, min(ts_us) AS start_us, max(ts_us) AS end_us
          FROM fx_packets GROUP BY 1)
    JOIN (SELECT capture_id, count(*) AS total_flows, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
            string_agg(DISTINCT protocol, '|' ORDER BY protocol) AS protocols FROM fx_flow GROUP BY 1)
    USING (capture_id)""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.capture_summary(t.packets, _flows(t))
    return out.select("*", joined("protocols", "p"), r("duration", 6, "d")).drop(
        "protocols", "duration"
    ).withColumnsRenamed({"p": "protocols", "d": "duration"})


@register(
    "a43_io_statistics",
    """SELECT capture_id, ts_us // 1000000 * 1000000 AS interval_us, count(*) AS frames,
      CAST(sum(length) AS BIGINT) AS bytes FROM fx_packets GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return ops.io_statistics(t.packets)


@register(
    "a45_packets_per_technology",
    f"""WITH {_CLASSIFIED}
    SELECT capture_id, technology, count(*) AS packets FROM fx_classified GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return ops.packets_per_technology(_classified(t))


@register(
    "o1_flows_by_packet_count",
    f"""WITH {_FLOWS}
    SELECT capture_id, src_ip, dst_ip, src_port, dst_port, packet_count, first_frame FROM fx_flow
    ORDER BY packet_count DESC, capture_id, first_frame""",
)
def _(t: Inputs) -> DataFrame:
    return ops.by_packet_count(_flows(t)).select(
        "capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "packet_count", "first_frame"
    )


@register(
    "o3_top_protocols",
    f"""WITH {_FLOWS}
    SELECT * FROM (SELECT capture_id, protocol, packets, row_number() OVER (PARTITION BY capture_id
        ORDER BY packets DESC, protocol) AS rank
      FROM (SELECT capture_id, protocol, CAST(sum(packet_count) AS BIGINT) AS packets FROM fx_flow GROUP BY 1, 2))
    WHERE rank <= 8""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.top_protocols(_flows(t))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "o3_top_flows",
    f"""WITH {_FLOWS}
    SELECT * FROM (SELECT capture_id, src_ip, dst_ip, packet_count, total_bytes // 1024 AS kbytes,
      row_number() OVER (PARTITION BY capture_id ORDER BY packet_count DESC, first_frame) AS rank FROM fx_flow)
    WHERE rank <= 5""",
)
def _(t: Inputs) -> DataFrame:
    return ops.top_flows(_flows(t)).select(
        "capture_id",
        "src_ip",
        "dst_ip",
        "packet_count",
        F.expr("total_bytes div 1024").alias("kbytes"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@register(
    "o4_flow_page",
    f"""WITH {_FLOWS}
    SELECT capture_id, src_ip, dst_ip, src_port, dst_port, packet_count, (SELECT count(*) FROM fx_flow
      WHERE capture_id = 'cap1') AS total
    FROM fx_flow WHERE capture_id = 'cap1' ORDER BY packet_count DESC, first_frame LIMIT 100 OFFSET 100""",
)
def _(t: Inputs) -> DataFrame:
    return ops.flow_page(_flows(t), "cap1", 100, 100).select(
        "capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "packet_count", "total"
    )


@register(
    "p28_flow_search",
    f"""WITH {_FLOWS}
    SELECT capture_id, src_ip, dst_ip, protocol, primary_tech, packet_count FROM fx_flow
    WHERE lower(src_ip) LIKE '%gtp%' OR lower(dst_ip) LIKE '%gtp%' OR lower(protocol) LIKE '%gtp%'
      OR lower(primary_tech) LIKE '%gtp%'""",
)
def _(t: Inputs) -> DataFrame:
    return ops.search_flows(_flows(t), "GTP").select(
        "capture_id", "src_ip", "dst_ip", "protocol", "primary_tech", "packet_count"
    )
