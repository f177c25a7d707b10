"""Report views over flows, sessions, calls and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom import dims

# Capture points in order of precedence (name, test, text, expected, not expected).
# Tests run over the upper-case protocol names of a capture.
CAPTURE_POINTS = [
    (
        "5G_CORE_UPF",
        ["PFCP"],
        [],
        "between session control and user plane of a 5G core",
        ["PFCP", "GTP-U"],
        ["RTP", "SIP", "NGAP"],
    ),
    (
        "5G_RAN_CORE",
        ["NGAP"],
        [],
        "between 5G radio and core",
        ["NGAP", "NAS-5GS", "GTP-U"],
        ["RTP", "SIP", "Diameter"],
    ),
    (
        "4G_RAN_CORE",
        ["S1AP"],
        [],
        "between 4G radio and core",
        ["S1AP", "NAS-EMM", "GTP-U"],
        ["RTP", "SIP"],
    ),
    (
        "IMS_CORE",
        ["SIP", "RTP"],
        [],
        "in the IMS, signalling and media",
        ["SIP", "RTP", "Diameter"],
        ["NGAP", "S1AP", "PFCP"],
    ),
    (
        "IMS_SIGNALING",
        ["SIP"],
        ["RTP"],
        "in the IMS, signalling without media",
        ["SIP", "Diameter"],
        ["RTP", "RTCP"],
    ),
    (
        "EPC_CORE",
        ["GTP"],
        [],
        "inside a 4G core",
        ["GTPv2-C", "GTP-U", "Diameter"],
        ["RTP", "SIP"],
    ),
    (
        "USER_PLANE",
        ["GTP-U"],
        [],
        "on the user plane",
        ["GTP-U", "IP"],
        ["GTPv2-C", "PFCP", "SIP"],
    ),
]
# Other spellings of a protocol name.
PROTOCOL_ALIASES = {"S1-AP": "S1AP", "X2-AP": "X2AP", "GTP-C": "GTP", "GTPV2-C": "GTP"}


def observed_protocols(flow_table: DataFrame) -> DataFrame:
    """Distinct protocol names per capture, upper case, one spelling each, stacks split."""
    name = F.explode(F.split(F.upper("protocol"), "/"))
    names = flow_table.select("capture_id", name.alias("_p")).distinct()
    return names.select(
        "capture_id",
        F.coalesce(dims.lookup(PROTOCOL_ALIASES, F.col("_p")), F.col("_p")).alias("protocol"),
    ).distinct()


def capture_points(flow_table: DataFrame) -> DataFrame:
    """Where each capture was taken, by its protocol mix."""
    sets = observed_protocols(flow_table).groupBy("capture_id").agg(
        F.array_sort(F.collect_set("protocol")).alias("observed")
    )

    def test(present: list[str], absent: list[str]) -> str:
        return " AND ".join(
            [f"array_contains(observed, '{p}')" for p in present]
            + [f"NOT array_contains(observed, '{p}')" for p in absent]
        )

    def point(name: str, text: str, expected: list[str], foreign: list[str]) -> str:
        lists = [
            f"array({dims.sql_list(v)})" if v else "cast(array() as array<string>)"
            for v in (expected, foreign)
        ]
        return (
            f"named_struct('point', '{name}', 'description', '{text}',"
            f" 'expected', {lists[0]}, 'not_expected', {lists[1]})"
        )

    cases = " ".join(
        f"WHEN {test(present, absent)} THEN {point(name, text, expected, foreign)}"
        for name, present, absent, text, expected, foreign in CAPTURE_POINTS
    )
    unknown = point("UNKNOWN", "The protocols seen fit no known place in the network", [], [])
    out = sets.withColumn("_p", F.expr(f"CASE {cases} ELSE {unknown} END"))
    return out.select("capture_id", "observed", "_p.*")


def absent_protocols(flow_table: DataFrame) -> DataFrame:
    """Common protocols that do not occur in a capture."""
    common = F.expr(f"array({dims.sql_list(dims.COMMON_PROTOCOLS)})")
    sets = observed_protocols(flow_table).groupBy("capture_id").agg(
        F.collect_set("protocol").alias("_o")
    )
    return sets.select(
        "capture_id", F.array_sort(F.array_except(common, "_o")).alias("absent")
    )


def expert_findings(ran: DataFrame | None = None, media: DataFrame | None = None) -> DataFrame:
    """RAN and media findings in one common shape."""
    parts = []
    if ran is not None:
        parts.append(
            ran.selectExpr(
                "capture_id",
                "initcap(severity) AS severity",
                "'RAN Analysis' AS `group`",
                "generation AS protocol",
                "concat(type, ': ', description) AS summary",
            )
        )
    if media is not None:
        parts.append(
            media.selectExpr(
                "capture_id",
                "IF(severity = 'warning', 'Warning', 'Error') AS severity",
                "'Voice Quality' AS `group`",
                "'VoIP' AS protocol",
                "concat(title, ': ', description) AS summary",
            )
        )
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def failures_of(failures: DataFrame, failure_type: str) -> DataFrame:
    """Failures of one kind: sip_errors, diameter_errors, gtp_errors or pfcp_errors."""
    names = {
        "sip_errors": "SIP",
        "diameter_errors": "Diameter",
        "gtp_errors": "GTP",
        "pfcp_errors": "PFCP",
    }
    if failure_type not in names:
        raise ValueError(f"unknown failure type {failure_type!r}; use one of {sorted(names)}")
    return failures.filter(F.col("error").contains(names[failure_type]))


def call_details(call_table: DataFrame, call_id: str) -> DataFrame:
    """One call by its Call-ID."""
    return call_table.filter(F.col("call_id") == call_id)


def trace_report(
    flow_table: DataFrame,
    sessions: DataFrame,
    summary: DataFrame,
    findings: DataFrame | None = None,
    top_flows: int = 20,
    top_sessions: int = 10,
    top_findings: int = 10,
) -> DataFrame:
    """One compact report per capture: summary, coverage flags, busiest flows, sessions and findings.

    Lists are cut to their length by rank before they are collected.
    """
    key = "capture_id"

    def head(df: DataFrame, order: list, n: int, name: str, fields: list) -> DataFrame:
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        return (
            ranked.filter(F.col("_r") <= n)
            .groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("index"), *fields))).alias(name))
        )

    busiest = head(
        flow_table,
        [F.desc("packet_count"), "first_frame"],
        top_flows,
        "top_flows",
        [
            "protocol",
            F.col("primary_tech").alias("tech"),
            F.concat_ws(":", "src_ip", "src_port").alias("src"),
            F.concat_ws(":", "dst_ip", "dst_port").alias("dst"),
            F.col("packet_count").alias("packets"),
            F.col("total_bytes").alias("bytes"),
            "is_gtp",
            "is_diameter",
        ],
    )
    families = head(
        sessions,
        [F.desc("total_packets"), "type"],
        top_sessions,
        "telecom_sessions",
        ["type", "flow_count", "total_packets"],
    )
    points = capture_points(flow_table)
    out = summary.join(points, key, "left").join(busiest, key, "left").join(families, key, "left")
    if findings is not None:
        voice = head(
            findings,
            ["severity", "type", "call_id"],
            top_findings,
            "voice_findings",
            ["type", "severity", "title", "call_id"],
        )
        out = out.join(voice, key, "left")

    def seen(name: str) -> str:
        return f"coalesce(array_contains(observed, '{name}'), false)"

    flags = F.expr(
        f"named_struct('has_signaling', size(observed) > 0, 'has_rtp', {seen('RTP')},"
        f" 'has_diameter', {seen('DIAMETER')}, 'has_gtp',"
        f" exists(observed, p -> contains(p, 'GTP')), 'has_sip', {seen('SIP')},"
        " 'capture_point_type', point)"
    )
    return out.withColumn("coverage_flags", flags)


def report_json(report: DataFrame) -> DataFrame:
    """Each report as one JSON text."""
    fields = [c for c in report.columns if c != "capture_id"]
    return report.select("capture_id", F.to_json(F.struct(*fields)).alias("context"))
