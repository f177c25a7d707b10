from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.catalog.base import Inputs, joined, register
from signalloom.catalog.packets import _FAMILIES, _FLOWS, _flows
from signalloom.catalog.ran import _ALL, _events
from signalloom.functions.causes import confidence_level
from signalloom.operators import packets as packet_ops
from signalloom.operators import ran as ran_ops
from signalloom.operators import report as ops
from signalloom.session import cut_lineage

_OBSERVED = (
    _FLOWS
    + """,
fx_seenp AS (
  SELECT DISTINCT capture_id, CASE p WHEN 'S1-AP' THEN 'S1AP' WHEN 'GTP-C' THEN 'GTP' ELSE p END AS protocol
  FROM (SELECT capture_id, upper(unnest(string_split(protocol, '/'))) AS p FROM fx_flow)
)"""
)


@register(
    "p26_capture_points",
    f"""WITH {_OBSERVED}
    SELECT capture_id, string_agg(protocol, '|' ORDER BY protocol) AS observed, CASE WHEN list_contains(list(protocol), 'PFCP') THEN '5G_CORE_UPF'
      WHEN list_contains(list(protocol), 'NGAP') THEN '5G_RAN_CORE' ELSE 'UNKNOWN' END AS point FROM fx_seenp GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return ops.capture_points(_flows(t)).select("capture_id", joined("observed"), "point")


@register(
    "u7_absent_protocols",
    f"""WITH {_OBSERVED}
    SELECT capture_id, array_to_string(list_sort(list_filter(['SIP', 'RTP', 'DIAMETER', 'GTP', 'PFCP', 'S1AP', 'NGAP', 'SCTP', 'HTTP2'],
      lambda x: NOT list_contains(seen, x))), '|') AS absent FROM (SELECT capture_id, list(protocol) AS seen FROM fx_seenp GROUP BY 1)""",
)
def _(t: Inputs) -> DataFrame:
    return ops.absent_protocols(_flows(t)).select("capture_id", joined("absent"))


@register(
    "p31_expert_findings",
    f"""WITH {_ALL}
    SELECT capture_id, concat(upper(severity[1]), severity[2:]) AS severity, generation AS protocol, type, count(*) AS n FROM fx_ran
    GROUP BY 1, 2, 3, 4""",
)
def _(t: Inputs) -> DataFrame:
    found = ops.expert_findings(ran=ran_ops.ran_findings(cut_lineage(_events(t))))
    kind = F.split_part("summary", F.lit(":"), F.lit(1)).alias("type")
    return found.groupBy("capture_id", "severity", "protocol", kind).agg(F.expr("count(1) AS n"))


@register(
    "p32_confidence_levels",
    f"""WITH {_ALL}
    SELECT capture_id, confidence_pct, CASE WHEN confidence_pct >= 80 THEN 'HIGH' WHEN confidence_pct >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level,
      count(*) AS n FROM fx_ran GROUP BY 1, 2, 3""",
)
def _(t: Inputs) -> DataFrame:
    level = confidence_level(F.col("confidence_pct")).alias("level")
    found = ran_ops.ran_findings(cut_lineage(_events(t)))
    return found.groupBy("capture_id", "confidence_pct", level).agg(F.expr("count(1) AS n"))


@register(
    "p34_failures_by_protocol",
    """SELECT capture_id, concat('SIP ', sip_status, ' ', sip_reason) AS error, count(*) AS occurrences
    FROM fx_packets WHERE sip_status >= 400 GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    summary = packet_ops.failure_summary(packet_ops.flow_failures(t.packets))
    return ops.failures_of(summary, "sip_errors").drop("failed_flows")


def _report(t: Inputs) -> DataFrame:
    flows = cut_lineage(_flows(t))
    summary = packet_ops.capture_summary(t.packets, flows)
    return ops.trace_report(flows, packet_ops.telecom_sessions(flows), summary)


_TRACE_REPORT = f"""WITH {_FLOWS}, {_FAMILIES}
    SELECT capture_id, flows AS total_flows, packets AS total_packets, bytes AS total_bytes, top_flows, telecom_sessions
    FROM (SELECT capture_id, count(*) AS flows, CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(total_bytes) AS BIGINT) AS bytes
          FROM fx_flow GROUP BY 1)
    JOIN (SELECT capture_id, string_agg(concat(src_ip, ':', src_port), '|' ORDER BY n) AS top_flows FROM (
        SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY packet_count DESC, first_frame) AS n FROM fx_flow)
      WHERE n <= 20 GROUP BY 1) USING (capture_id)
    JOIN (SELECT capture_id, string_agg(type, '|' ORDER BY n) AS telecom_sessions FROM (
        SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY packets DESC, type) AS n FROM (
          SELECT capture_id, type, sum(packet_count) AS packets FROM fx_family GROUP BY 1, 2)) WHERE n <= 10 GROUP BY 1)
    USING (capture_id)"""


@register("a47_trace_report", _TRACE_REPORT)
def _(t: Inputs) -> DataFrame:
    return _report(t).select(
        "capture_id",
        "total_flows",
        "total_packets",
        "total_bytes",
        F.array_join("top_flows.src", "|").alias("top_flows"),
        F.array_join("telecom_sessions.type", "|").alias("telecom_sessions"),
    )


# The JSON texts, read back.
@register("a47_report_json", _TRACE_REPORT)
def _(t: Inputs) -> DataFrame:
    shape = (
        "total_flows bigint, total_packets bigint, total_bytes bigint, top_flows array<struct<src string>>,"
        " telecom_sessions array<struct<type string>>"
    )
    rows = ops.report_json(_report(t)).select("capture_id", F.from_json("context", shape).alias("c"))
    return rows.select(
        "capture_id",
        "c.total_flows",
        "c.total_packets",
        "c.total_bytes",
        F.array_join("c.top_flows.src", "|").alias("top_flows"),
        F.array_join("c.telecom_sessions.type", "|").alias("telecom_sessions"),
    )
