from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.catalog.base import Inputs, joined, register
from signalloom.catalog.packets import _CLASSIFIED, _classified
from signalloom.operators import nodes
from signalloom.operators import subscribers as ops
from signalloom.session import stored
from signalloom.sources.sample_tables import SAMPLE_SPAN

_IDS = """
fx_norm AS (
  SELECT *, CASE WHEN length(regexp_replace(imsi, '[^0-9]', '', 'g')) IN (14, 15) THEN regexp_replace(imsi, '[^0-9]', '', 'g') END AS i1,
    nullif(regexp_extract(user_name, '[+]?[0-9]{10,15}'), '') AS u1, nullif(regexp_extract(sip_from, '[+]?[0-9]{10,15}'), '') AS f1,
    nullif(regexp_extract(sip_to, 'tel:([+0-9]+)', 1), '') AS t1 FROM fx_identified
),
fx_ids AS (
  SELECT capture_id, 'imsi' AS kind, i1 AS value FROM fx_norm WHERE i1 IS NOT NULL
  UNION SELECT capture_id, 'imsi', split_part(diameter_user, '@', 1) FROM fx_norm WHERE diameter_user IS NOT NULL
  UNION SELECT capture_id, 'msisdn', f1 FROM fx_norm WHERE protocol = 'SIP' AND f1 IS NOT NULL
  UNION SELECT capture_id, 'msisdn', t1 FROM fx_norm WHERE protocol = 'SIP' AND t1 IS NOT NULL
  UNION SELECT capture_id, 'imei', imei[1:15] FROM fx_norm WHERE imei IS NOT NULL
),
fx_known AS (SELECT DISTINCT capture_id, value FROM fx_ids WHERE kind <> 'imei'),
fx_sub AS (
  SELECT n.*, coalesce(a.value, b.value, c.value, d.value, 'UNIDENTIFIED') AS subscriber FROM fx_norm n
  LEFT JOIN fx_known a ON a.capture_id = n.capture_id AND a.value = n.i1
  LEFT JOIN fx_known b ON b.capture_id = n.capture_id AND b.value = n.u1
  LEFT JOIN fx_known c ON c.capture_id = n.capture_id AND c.value = n.f1
  LEFT JOIN fx_known d ON d.capture_id = n.capture_id AND d.value = n.t1
)"""


@register("a16_identities", f"WITH {_IDS} SELECT * FROM fx_ids")
def _(t: Inputs) -> DataFrame:
    return ops.identities(t.identified)


@register(
    "a17_assign_subscribers",
    f"WITH {_IDS} SELECT capture_id, frame_number, subscriber FROM fx_sub",
)
def _(t: Inputs) -> DataFrame:
    return ops.assign_subscribers(t.stored("identified")).select("capture_id", "frame_number", "subscriber")


@register(
    "a18_journeys",
    f"""WITH {_IDS}
    SELECT capture_id, subscriber, count(*) AS transaction_count, string_agg(DISTINCT protocol, '|' ORDER BY protocol) AS protocols,
      count(*) FILTER (status = 'failure') AS failures,
      coalesce(array_to_string(list(cause ORDER BY frame_number) FILTER (cause IS NOT NULL)[1:5], '|'), '') AS top_causes
    FROM fx_sub WHERE subscriber <> 'UNIDENTIFIED' GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    rows = t.stored("identified").withColumn("cause_label", F.lit(None).cast("string"))
    return ops.journeys(ops.assign_subscribers(rows)).select(
        "capture_id",
        "subscriber",
        "transaction_count",
        joined("protocols"),
        "failures",
        joined("top_causes"),
    )


@register(
    "a18_journey_summary",
    f"""WITH {_IDS}
    SELECT capture_id, count(DISTINCT subscriber) FILTER (subscriber <> 'UNIDENTIFIED') AS subscriber_count,
      count(*) FILTER (subscriber = 'UNIDENTIFIED') AS unidentified_count FROM fx_sub GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return ops.journey_summary(ops.assign_subscribers(t.stored("identified")))


@register(
    "j13_without_subscriber",
    f"WITH {_IDS} SELECT capture_id, frame_number, protocol FROM fx_sub WHERE subscriber = 'UNIDENTIFIED'",
)
def _(t: Inputs) -> DataFrame:
    out = ops.without_subscriber(ops.assign_subscribers(t.stored("identified")))
    return out.select("capture_id", "frame_number", "protocol")


# Node roles: dissected transactions vote by their message.
_VOTES = """
fx_nodetx AS (
  SELECT capture_id, CAST(frame_number AS BIGINT) AS frame_number, ip_src AS src, ip_dst AS dst,
    CASE WHEN pfcp_msg_type IS NOT NULL THEN 'PFCP' WHEN gtp_message IS NOT NULL THEN 'GTPv2-C' WHEN gtp_teid IS NOT NULL THEN 'GTP-U'
      WHEN ngap_procedureCode IS NOT NULL THEN 'NGAP' WHEN s1ap_procedureCode IS NOT NULL THEN 'S1AP'
      WHEN diameter_cmd_code IS NOT NULL THEN 'Diameter' WHEN sip_Call_ID IS NOT NULL THEN 'SIP' ELSE 'Unknown' END AS protocol,
    CASE WHEN pfcp_msg_type IS NOT NULL THEN CASE WHEN pfcp_msg_type IN ('52', '54', '50') THEN 'SMF'
        WHEN pfcp_msg_type IN ('51', '53', '55') THEN 'UPF' END
      WHEN gtp_message = '32' THEN 'MME' WHEN gtp_message = '33' THEN 'SGW' WHEN gtp_message IS NOT NULL OR gtp_teid IS NOT NULL THEN NULL
      WHEN ngap_procedureCode IN ('15', '46', '0') THEN 'gNB' WHEN ngap_procedureCode IN ('4', '14', '29', '41', '1') THEN 'AMF'
      WHEN s1ap_procedureCode IN ('12', '13', '17') THEN 'eNB' WHEN s1ap_procedureCode IN ('11', '9', '23') THEN 'MME'
      WHEN diameter_cmd_code IS NOT NULL THEN CASE diameter_cmd_code WHEN '316' THEN 'MME' WHEN '317' THEN 'HSS' WHEN '272' THEN 'PCEF' END
      WHEN sip_Method = 'INVITE' THEN 'Caller' END AS role,
    CASE WHEN pfcp_msg_type IS NOT NULL THEN concat('PFCP_PFCP-Msg-', pfcp_msg_type) WHEN gtp_message IS NOT NULL
      THEN concat('GTPv2-C_GTP-Msg-', gtp_message) WHEN gtp_teid IS NOT NULL THEN 'GTP-U_Unknown' END AS message
  FROM fx_fields WHERE coalesce(pfcp_msg_type, gtp_message, gtp_teid, ngap_procedureCode, s1ap_procedureCode, diameter_cmd_code,
    sip_Call_ID, sctp_retransmission) IS NOT NULL
),
fx_votes AS (SELECT capture_id, src AS ip, role, count(*) AS votes, min(frame_number) AS first_frame FROM fx_nodetx
  WHERE role IS NOT NULL GROUP BY 1, 2, 3),
fx_role AS (SELECT capture_id, ip, role FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, ip ORDER BY votes DESC, first_frame) AS rn
  FROM fx_votes) WHERE rn = 1),
fx_end AS (SELECT capture_id, src AS ip, dst AS peer, protocol, true AS sent FROM fx_nodetx
  UNION ALL SELECT capture_id, dst, src, protocol, false FROM fx_nodetx)"""


def _node_transactions(t: Inputs) -> DataFrame:
    from signalloom.operators.transactions import build_transactions

    return build_transactions(t.fields)


def _stored_nodes(t: Inputs) -> DataFrame:
    """What the node operators read of the transactions, written once for queries that read it several times."""
    return stored(_node_transactions(t).select("capture_id", "frame_number", "protocol", "message_type", "src", "dst", "diameter_app"))


@register("a36_role_votes", f"WITH {_VOTES} SELECT * FROM fx_votes")
def _(t: Inputs) -> DataFrame:
    return nodes.role_votes(_node_transactions(t))


@register("a37_node_roles", f"WITH {_VOTES} SELECT * FROM fx_role")
def _(t: Inputs) -> DataFrame:
    return nodes.classify_nodes(nodes.role_votes(_node_transactions(t)))


@register(
    "a36_node_evidence",
    f"""WITH {_VOTES}
    SELECT capture_id, ip, string_agg(DISTINCT protocol, '|' ORDER BY protocol) AS protocols,
      count(*) FILTER (sent) AS messages_sent, count(*) FILTER (NOT sent) AS messages_received, count(DISTINCT peer) AS peers
    FROM fx_end GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return nodes.node_evidence(_stored_nodes(t)).select(
        "capture_id", "ip", joined("protocols"), "messages_sent", "messages_received", "peers"
    )


@register("a36_node_peers", f"WITH {_VOTES} SELECT DISTINCT capture_id, ip, peer FROM fx_end")
def _(t: Inputs) -> DataFrame:
    return nodes.node_peers(_node_transactions(t))


@register(
    "u8_unresolved_nodes",
    f"""WITH {_VOTES}
    SELECT DISTINCT capture_id, ip FROM fx_end WHERE (capture_id, ip) NOT IN (SELECT (capture_id, ip) FROM fx_role)""",
)
def _(t: Inputs) -> DataFrame:
    tx = _stored_nodes(t)
    return nodes.unresolved_nodes(tx, nodes.classify_nodes(nodes.role_votes(tx)))


_HEURISTIC = """
fx_guess AS (
  SELECT capture_id, src_ip AS ip, coalesce(arg_max(over, frame_number) FILTER (over IS NOT NULL),
    arg_min(hint, frame_number) FILTER (hint IS NOT NULL)) AS role
  FROM (SELECT *, CASE gtp_type WHEN 32 THEN 'MME' WHEN 33 THEN 'SGW/PGW' END AS over,
      CASE WHEN sip_status >= 400 AND sip_status < 700 THEN 'SIP_Server' WHEN sip_method = 'INVITE' THEN 'SIP_Endpoint'
        WHEN gtp_type = 1 THEN 'GTP_Node' WHEN pfcp_type IS NOT NULL THEN 'PFCP_Entity' WHEN src_port = 53 THEN 'DNS_Server'
        WHEN dst_port = 53 THEN 'DNS_Client' END AS hint FROM fx_packets) GROUP BY 1, 2
  HAVING count(over) > 0 OR count(hint) > 0
)"""


@register("a38_heuristic_roles", f"WITH {_HEURISTIC} SELECT * FROM fx_guess")
def _(t: Inputs) -> DataFrame:
    return nodes.heuristic_roles(_classified(t))


# The network map of the derived packets: names of all suppliers, 65536 to a second octet from 10.1 on, and three nested
# subnets.
_MAP = """
fx_exact AS (SELECT concat('10.', CAST(1 + s_suppkey // 65536 AS STRING), '.', CAST(s_suppkey // 256 % 256 AS STRING), '.',
  CAST(s_suppkey % 256 AS STRING)) AS ip, s_name AS name FROM supplier),
fx_subnet AS (SELECT * FROM (VALUES ('10.0.0.0/30', 'Edge', 0), ('10.0.0.0/28', 'Core', 1), ('10.0.0.0/16', 'RAN', 2)) x(cidr, name, ord)),
fx_addr AS (SELECT DISTINCT src_ip AS ip FROM fx_packets UNION SELECT dst_ip FROM fx_packets),
fx_named AS (
  SELECT ip, coalesce(e.name, CASE WHEN a.ip LIKE '10.0.%' THEN concat(CASE WHEN last < 4 THEN 'Edge' WHEN last < 16 THEN 'Core'
    ELSE 'RAN' END, '_', last) END, ip) AS name
  FROM (SELECT ip, CAST(split_part(ip, '.', 4) AS INT) AS last FROM fx_addr) a LEFT JOIN fx_exact e USING (ip)
)"""


def _map(t: Inputs) -> tuple[DataFrame, DataFrame]:
    supplier = t.spark.read.parquet(f"{t.sf_dir}/supplier.parquet")
    exact = supplier.selectExpr(
        "concat('10.', 1 + s_suppkey div 65536, '.', s_suppkey div 256 % 256, '.', s_suppkey % 256) AS ip",
        "s_name AS name",
    )
    subnets = t.spark.sql(
        "SELECT * FROM VALUES ('10.0.0.0/30', 'Edge', 0), ('10.0.0.0/28', 'Core', 1),"
        " ('10.0.0.0/16', 'RAN', 2) AS x(cidr, name, ord)"
    )
    return exact, subnets


@register("j3_resolve_addresses", f"WITH {_MAP} SELECT * FROM fx_named")
def _(t: Inputs) -> DataFrame:
    ends = t.packets.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return nodes.resolve_addresses(ends, *_map(t))


_LADDER = (
    _CLASSIFIED
    + ","
    + _HEURISTIC
    + ","
    + _MAP
    + ","
    + _VOTES
    + """,
fx_ladder AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts_us, frame_number) - 1 AS rank,
    greatest(count(*) OVER (PARTITION BY capture_id) // 100, 1) AS step FROM fx_classified
),
fx_seq AS (
  SELECT l.*, coalesce(nullif(ns.name, l.src_ip), gs.role, l.src_ip) AS src_name,
    coalesce(nullif(nd.name, l.dst_ip), gd.role, l.dst_ip) AS dst_name,
    CASE WHEN pfcp_type IS NOT NULL THEN concat('PFCP ', pfcp_type) WHEN sip_method IS NOT NULL THEN concat('SIP ', sip_method)
      WHEN sip_status IS NOT NULL THEN concat('SIP ', sip_status) WHEN diameter_app_id IS NOT NULL THEN 'Diameter Unknown'
      WHEN gtp_type IS NOT NULL THEN concat('GTP ', gtp_type, CASE WHEN gtp_teid <> 0 THEN concat(' TEID:', gtp_teid) ELSE '' END)
      ELSE '' END AS info
  FROM fx_ladder l LEFT JOIN fx_named ns ON ns.ip = l.src_ip LEFT JOIN fx_named nd ON nd.ip = l.dst_ip
  LEFT JOIN fx_guess gs ON gs.capture_id = l.capture_id AND gs.ip = l.src_ip
  LEFT JOIN fx_guess gd ON gd.capture_id = l.capture_id AND gd.ip = l.dst_ip
  WHERE rank % step = 0 AND rank < step * 100
)"""
)


def _ladder(t: Inputs) -> DataFrame:
    roles = nodes.classify_nodes(nodes.role_votes(_node_transactions(t)))
    return stored(nodes.message_sequence(_classified(t), roles, *_map(t), span=SAMPLE_SPAN))


@register(
    "w6_sample_messages",
    f"WITH {_LADDER} SELECT capture_id, frame_number, rank FROM fx_seq",
)
def _(t: Inputs) -> DataFrame:
    out = nodes.sample_messages(t.packets, span=SAMPLE_SPAN)
    return out.select("capture_id", "frame_number", "rank")


@register(
    "l1_message_sequence",
    f"""WITH {_LADDER}
    SELECT capture_id, rank, ts_us, frame_number, src_ip, dst_ip, src_port, dst_port, protocol, transport, length, info, src_name, dst_name
    FROM fx_seq""",
)
def _(t: Inputs) -> DataFrame:
    return _ladder(t)


_ENDPOINTS = (
    _LADDER
    + """,
fx_endpoint AS (
  SELECT *, concat('Node_', split_part(ip, '.', 4)) AS alias FROM (
    SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY pos, side) AS idx FROM (
      SELECT capture_id, ip, min(pos) AS pos, arg_min(side, pos * 2 + side) AS side FROM (
        SELECT capture_id, src_ip AS ip, rank AS pos, 0 AS side FROM fx_seq
        UNION ALL SELECT capture_id, dst_ip, rank, 1 FROM fx_seq) GROUP BY 1, 2))
  WHERE idx <= 8
)"""
)


@register(
    "p29_p30_ladder_endpoints",
    f"WITH {_ENDPOINTS} SELECT capture_id, idx, ip, alias FROM fx_endpoint",
)
def _(t: Inputs) -> DataFrame:
    out = nodes.first_endpoints(_ladder(t))
    return out.withColumn("idx", F.col("idx").cast("bigint"))


@register(
    "p29_ladder_protocols",
    f"WITH {_LADDER} SELECT DISTINCT capture_id, split_part(protocol, '/', 1) AS protocol FROM fx_seq",
)
def _(t: Inputs) -> DataFrame:
    return nodes.ladder_protocols(_ladder(t))


@register(
    "p29_ladder_messages",
    f"""WITH {_ENDPOINTS}
    SELECT * FROM (SELECT capture_id, frame_number, protocol, row_number() OVER (PARTITION BY capture_id ORDER BY ts_us, frame_number) AS idx
      FROM fx_seq s WHERE contains(protocol, 'GTP')
        AND EXISTS (SELECT 1 FROM fx_endpoint e WHERE e.capture_id = s.capture_id AND e.ip = s.src_ip)
        AND EXISTS (SELECT 1 FROM fx_endpoint e WHERE e.capture_id = s.capture_id AND e.ip = s.dst_ip)) WHERE idx <= 50""",
)
def _(t: Inputs) -> DataFrame:
    out = nodes.ladder_messages(_ladder(t), "GTP")
    return out.select(
        "capture_id", "frame_number", "protocol", F.col("idx").cast("bigint").alias("idx")
    )
