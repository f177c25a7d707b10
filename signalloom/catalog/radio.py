from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.catalog.base import Inputs, joined, r, register
from signalloom.functions import radio as fn
from signalloom.operators import correlate
from signalloom.operators import radio as ops
from signalloom.session import cut_lineage

# Expected normalised events, straight from the event table the export rows are derived from.
_EVENTS = """
fx_src AS (
  SELECT r.*, e.ts, e.event_type AS kind, e.value, epoch_us(e.ts) AS us FROM fx_radio_rows r JOIN events e ON e.event_id = r.row_no
),
fx_event AS (
  SELECT *, concat_ws(' ', event_name, coalesce(detail, '')) AS txt,
    CASE row_no % 7 WHEN 0 THEN us WHEN 1 THEN us // 1000 * 1000 WHEN 2 THEN us WHEN 3 THEN us - 7200000000
      WHEN 4 THEN us - 10800000000 WHEN 5 THEN us // 1000000 * 1000000 - 10800000000
      ELSE us // 1000000 * 1000000 - 10800000000 END AS ts_us,
    CASE kind WHEN 'error' THEN CASE row_no % 4 WHEN 0 THEN 'RLF' ELSE NULL END
      WHEN 'signup' THEN CASE WHEN row_no % 2 = 0 THEN 'HO_FAIL' ELSE 'HO_SUCCESS' END
      ELSE NULL END AS strong,
    CAST(regexp_extract(rsrp, '^[-0-9.]+') AS DOUBLE) AS rsrp_v, CAST(regexp_extract(sinr, '^[-0-9]+') AS DOUBLE) AS sinr_v,
    CAST(regexp_extract(dl_throughput, '^[0-9]+') AS DOUBLE) AS dl_v
  FROM fx_src WHERE event_time <> 'no time'
),
fx_norm AS (
  SELECT *, CASE WHEN strong IS NOT NULL THEN strong WHEN contains(txt, 'CS fallback') THEN 'CSFB'
      WHEN kind = 'purchase' THEN 'PAGING' WHEN kind = 'view' AND row_no % 3 = 2 THEN 'MEASUREMENT_REPORT'
      WHEN kind = 'click' AND row_no % 2 = 0 THEN 'RRC_REESTABLISHMENT' ELSE event_name END AS event_type,
    CASE WHEN network_type = '4g' THEN '4G' WHEN network_type = 'custom' THEN 'custom'
      WHEN contains(txt, 'success on NR') THEN '5G' WHEN earfcn IS NOT NULL THEN '4G' ELSE 'UNKNOWN' END AS generation,
    CASE WHEN network_type = '4g' THEN 'EUTRAN' WHEN network_type = 'custom' THEN 'UNKNOWN'
      WHEN contains(txt, 'success on NR') THEN 'NR' WHEN earfcn IS NOT NULL THEN 'EUTRAN' ELSE 'UNKNOWN' END AS rat
  FROM fx_event
)"""


def _norm(t: Inputs) -> DataFrame:
    return ops.normalize_rows(t.radio_rows)


def _stored(t: Inputs) -> DataFrame:
    """Normalised events, written once: the rules below read them several times."""
    return cut_lineage(_norm(t))


@register(
    "f11_normalize_radio_rows",
    f"""WITH {_EVENTS}
    SELECT trace_id, row_no, ts_us, event_type, coalesce(detail, event_time) AS event_label, generation, rat, cell_id, imsi, earfcn,
      rsrp_v AS rsrp, sinr_v AS sinr, dl_v AS throughput_dl_kbps, contains(event_type, 'HO') AS is_handover,
      contains(event_type, 'PAGING') AS is_paging FROM fx_norm""",
)
def _(t: Inputs) -> DataFrame:
    return _norm(t).select(
        "trace_id",
        "row_no",
        "ts_us",
        "event_type",
        "event_label",
        "generation",
        "rat",
        "cell_id",
        "imsi",
        "earfcn",
        "rsrp",
        "sinr",
        "throughput_dl_kbps",
        F.col("handover").isNotNull().alias("is_handover"),
        F.col("paging").isNotNull().alias("is_paging"),
    )


@register(
    "f13_f14_values",
    f"""WITH {_EVENTS} SELECT trace_id, row_no, ts_us, rsrp_v AS rsrp FROM fx_event""",
)
def _(t: Inputs) -> DataFrame:
    rows = t.radio_rows.select(
        "trace_id",
        "row_no",
        fn.parse_timestamp(F.col("event_time")).alias("ts_us"),
        fn.first_number(F.col("rsrp")).alias("rsrp"),
    )
    return rows.filter("ts_us is not null")


@register(
    "f15_detect_zone",
    """SELECT trace_id, 'UTC+2' AS zone FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY row_no) AS rn
      FROM fx_radio_rows) WHERE rn <= 20 GROUP BY 1 HAVING count(*) FILTER (row_no % 7 = 3) > 0""",
)
def _(t: Inputs) -> DataFrame:
    return ops.detect_zone(t.radio_rows, "event_time")


@register(
    "f17_event_types",
    f"WITH {_EVENTS} SELECT event_type, count(*) AS n FROM fx_norm GROUP BY 1",
)
def _(t: Inputs) -> DataFrame:
    rows = t.radio_rows.filter("event_time <> 'no time'")
    kind = fn.classify_event(F.col("event_name"), F.col("detail")).alias("event_type")
    return rows.groupBy(kind).agg(F.expr("count(1) AS n"))


@register(
    "f18_f19_handover_paging",
    f"""WITH {_EVENTS}
    SELECT trace_id, row_no, CASE WHEN contains(event_type, 'HO') THEN contains(event_type, 'SUCCESS') END AS ho_success,
      CASE WHEN contains(event_type, 'HO') THEN cell_id END AS from_cell,
      CASE WHEN event_type = 'PAGING' THEN coalesce(contains(detail, 'success'), false) END AS paged FROM fx_norm""",
)
def _(t: Inputs) -> DataFrame:
    return _norm(t).select(
        "trace_id",
        "row_no",
        F.col("handover.success").alias("ho_success"),
        F.col("handover.from_cell").alias("from_cell"),
        F.col("paging.success").alias("paged"),
    )


@register(
    "f24_harq_nack",
    """SELECT trace_id, row_no, CAST(regexp_extract(payload, 'qam>([0-9]+)', 1) AS INT) AS nack FROM fx_radio_rows
    WHERE payload IS NOT NULL""",
)
def _(t: Inputs) -> DataFrame:
    rows = t.radio_rows.filter("payload is not null")
    return rows.select("trace_id", "row_no", fn.harq_nack(F.col("payload")).alias("nack"))


@register(
    "a40_radio_summary",
    f"""WITH {_EVENTS}
    SELECT trace_id, count(*) AS total_events, min(ts_us) AS start_us, max(ts_us) AS end_us, count(rsrp_v) AS rsrp_count,
      min(rsrp_v) AS rsrp_min, max(rsrp_v) AS rsrp_max, round(avg(rsrp_v), 6) AS rsrp_avg, min(sinr_v) AS sinr_min,
      round(avg(sinr_v), 6) AS sinr_avg, min(dl_v) AS throughput_dl_kbps_min, round(avg(dl_v), 6) AS throughput_dl_kbps_avg
    FROM fx_norm GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return ops.radio_summary(_norm(t)).select(
        "trace_id",
        "total_events",
        "start_us",
        "end_us",
        "rsrp_count",
        "rsrp_min",
        "rsrp_max",
        r("rsrp_avg"),
        "sinr_min",
        r("sinr_avg"),
        "throughput_dl_kbps_min",
        r("throughput_dl_kbps_avg"),
    )


@register(
    "o9_event_counts",
    f"""WITH {_EVENTS}
    SELECT trace_id, event_type AS value, count(*) AS events, row_number() OVER (PARTITION BY trace_id
      ORDER BY count(*) DESC, min(row_no)) AS rank FROM fx_norm GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.event_counts(_norm(t), "event_type")
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "o11_identifiers",
    f"""WITH {_EVENTS}
    SELECT trace_id, kind, count(*) AS "values", array_to_string(list(value ORDER BY value)[1:CASE kind WHEN 'imsi' THEN 10 ELSE 20 END], '|') AS listed
    FROM (SELECT DISTINCT trace_id, 'imsi' AS kind, imsi AS value FROM fx_norm WHERE imsi IS NOT NULL
      UNION SELECT DISTINCT trace_id, 'cell_id', cell_id FROM fx_norm) GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.identifiers_found(_stored(t))
    return out.select("trace_id", "kind", "values", joined("listed"))


@register(
    "a40_issue_counts",
    f"""WITH {_EVENTS}
    SELECT trace_id, event_type, count(*) AS events FROM fx_norm
    WHERE event_type IN ('RLF', 'HO_FAIL', 'PAGING', 'RRC_REESTABLISHMENT', 'CSFB', 'SRVCC') GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return ops.issue_counts(_norm(t))


_RECONFIG = (
    _EVENTS
    + """,
fx_rrc AS (
  SELECT *, lag(k) OVER w AS pk, lag(ts_us) OVER w AS pts FROM (
    SELECT *, CASE WHEN event_type = 'RRC_RRC_CONNECTION_RECONFIGURATION' AND upper(to_node) = 'UE' THEN 'ask'
      WHEN event_type = 'RRC_RRC_CONNECTION_RECONFIGURATION_COMPLETE' AND upper(from_node) = 'UE' THEN 'done' END AS k FROM fx_norm)
  WHERE k IS NOT NULL WINDOW w AS (PARTITION BY trace_id ORDER BY ts_us, row_no)
),
fx_latency AS (SELECT trace_id, ts_us, event_time AS time_text, (ts_us - pts) / 1000 AS latency_ms FROM fx_rrc
  WHERE k = 'done' AND pk = 'ask' AND ts_us > pts)"""
)


@register(
    "w2_reconfiguration_latency",
    f"WITH {_RECONFIG} SELECT trace_id, ts_us, time_text, round(latency_ms, 3) AS latency_ms FROM fx_latency",
)
def _(t: Inputs) -> DataFrame:
    out = ops.reconfiguration_latency(_stored(t))
    return out.withColumn("latency_ms", F.round("latency_ms", 3))


_HITS = (
    _EVENTS
    + """,
fx_hit AS (
  SELECT trace_id, row_no, ts_us, unnest(list_filter([
    CASE WHEN event_type = 'RLF' THEN 'RLF' END, CASE WHEN event_type = 'HO_FAIL' THEN 'HO_FAIL' END,
    CASE WHEN event_type = 'PAGING' THEN 'PAGING' END,
    CASE WHEN event_type = 'PAGING' AND NOT coalesce(contains(detail, 'success'), false) THEN 'PAGING_FAILED' END,
    CASE WHEN event_type = 'CSFB' THEN 'CSFB' END, CASE WHEN event_type = 'RRC_REESTABLISHMENT' THEN 'REESTABLISHMENT' END,
    CASE WHEN rsrp_v < -110 THEN 'POOR_RSRP' END,
    CASE WHEN contains(concat(event_type, ' ', coalesce(detail, '')), 'INTERNAL_PROC_RRC_CONN_RECONF_NO_MOB') AND rrc_reconfig_result = '1' THEN 'RECONFIG' END,
    CASE WHEN release_cause IS NOT NULL THEN 'RELEASE' END,
    CASE WHEN event_type = 'INTERNAL_PROC_ERAB_SETUP' AND result = '1' THEN 'ERAB' END,
    CASE WHEN event_type = 'X2_SGNB_ADDITION_REJECT' THEN 'SGNB' END,
    CASE WHEN event_type = 'DU_PER_UE_TRAFFIC_REP' AND CAST(regexp_extract(payload, 'qam>([0-9]+)', 1) AS INT) > 10 THEN 'HARQ' END
  ], lambda x: x IS NOT NULL)) AS rule FROM fx_norm
),
fx_rule AS (SELECT trace_id, rule, count(*) AS n, min(ts_us) AS first_us FROM fx_hit GROUP BY 1, 2)"""
)


@register("r2_r13_rule_hits", f"WITH {_HITS} SELECT * FROM fx_rule")
def _(t: Inputs) -> DataFrame:
    return ops.rule_hits(_stored(t)).select("trace_id", "rule", "n", "first_us")


_FINDINGS = (
    _HITS
    + ","
    + _RECONFIG.split("fx_rrc AS (", 1)[1].join(["\nfx_rrc AS (", ""])
    + """,
fx_radio_finding AS (
  SELECT trace_id, CASE rule WHEN 'PAGING_FAILED' THEN 'PAGING_FAILURE_OR_UE_UNREACHABLE' WHEN 'REESTABLISHMENT' THEN 'RRC_REESTABLISHMENT_DETECTED'
      WHEN 'RECONFIG' THEN 'RRC_RECONFIGURATION_FAILURE' WHEN 'RELEASE' THEN 'ABNORMAL_RADIO_RELEASE' WHEN 'ERAB' THEN 'ERAB_SETUP_FAILURE'
      WHEN 'SGNB' THEN 'SGNB_ADDITION_FAILURE' WHEN 'HARQ' THEN 'HIGH_HARQ_NACK_RATIO' WHEN 'CSFB' THEN 'CSFB_DETECTED'
      WHEN 'RLF' THEN 'RADIO_LINK_FAILURE_IMPACTING_CALL' WHEN 'HO_FAIL' THEN 'HANDOVER_FAILURE_OR_SRVCC' END AS finding_type,
    CASE rule WHEN 'PAGING_FAILED' THEN 70 WHEN 'REESTABLISHMENT' THEN 70 WHEN 'HARQ' THEN 85 WHEN 'CSFB' THEN 80 WHEN 'RLF' THEN 60
      WHEN 'HO_FAIL' THEN 55 ELSE 95 END AS confidence_pct
  FROM fx_rule WHERE rule NOT IN ('PAGING', 'POOR_RSRP', 'SRVCC')
  UNION ALL SELECT trace_id, 'COVERAGE_DEGRADATION', 75 FROM fx_norm GROUP BY 1 HAVING min(rsrp_v) < -110 OR min(sinr_v) < -3 OR avg(sinr_v) < 0
  UNION ALL SELECT trace_id, 'RADIO_DATA_PATH_DEGRADATION', 65 FROM fx_norm GROUP BY 1 HAVING min(dl_v) < 100
  UNION ALL SELECT trace_id, 'RRC_RECONFIGURATION_LATENCY', 85 FROM fx_latency GROUP BY 1 HAVING max(latency_ms) > 1000
)"""
)


@register("r1_radio_findings", f"WITH {_FINDINGS} SELECT * FROM fx_radio_finding")
def _(t: Inputs) -> DataFrame:
    return ops.radio_findings(_stored(t)).select("trace_id", "finding_type", "confidence_pct")


@register(
    "r5_coverage_degradation",
    f"""WITH {_EVENTS}
    SELECT trace_id, concat(CASE WHEN min(rsrp_v) < -120 THEN concat('RSRP minimum: ', min(rsrp_v), ' dBm (CRITICAL, < -120.0)|') ELSE '' END,
      CASE WHEN min(sinr_v) < -3 THEN concat('SINR minimum: ', min(sinr_v), ' dB (CRITICAL, < -3.0)|') ELSE '' END,
      concat('Events with poor RSRP (< -110.0): ', count(*) FILTER (rsrp_v < -110), '/', count(*))) AS evidence
    FROM fx_norm GROUP BY 1 HAVING count(*) FILTER (rsrp_v < -110) > 0""",
)
def _(t: Inputs) -> DataFrame:
    events = _stored(t)
    out = ops.coverage_degradation(ops.radio_summary(events), ops.rule_hits(events))
    return out.select("trace_id", joined("evidence"))


@register(
    "r1_not_observable",
    """SELECT DISTINCT trace_id, 80 AS confidence_pct FROM (SELECT concat('trace', CAST(user_id % 5 AS STRING)) AS trace_id FROM events)
    WHERE trace_id NOT IN (SELECT trace_id FROM fx_radio_events)""",
)
def _(t: Inputs) -> DataFrame:
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    traces = events.selectExpr("concat('trace', user_id % 5) AS trace_id")
    out = ops.not_observable(traces, t.radio_events, traces)
    return out.select("trace_id", "confidence_pct")


# Correlation: every pair of the two planes scored, best one per radio event.
_SCORED = """
fx_pairs AS (
  SELECT r.trace_id, r.row_no, s.event_no, abs(r.ts_us - s.ts_us) AS d, r.event_type, s.type,
    greatest(CASE WHEN r.imsi = s.imsi THEN 95 ELSE 0 END, CASE WHEN r.guti = s.guti THEN 85 ELSE 0 END,
      CASE WHEN r.tmsi = s.tmsi THEN 85 ELSE 0 END, CASE WHEN r.ue_ip = s.ue_ip THEN 80 ELSE 0 END,
      CASE WHEN r.cell_id = s.cell_id THEN 70 ELSE 0 END) AS base,
    concat(CASE WHEN r.imsi = s.imsi THEN 'IMSI,' ELSE '' END, CASE WHEN r.guti = s.guti THEN 'GUTI,' ELSE '' END,
      CASE WHEN r.tmsi = s.tmsi THEN 'TMSI,' ELSE '' END, CASE WHEN r.ue_ip = s.ue_ip THEN 'UE_IP,' ELSE '' END,
      CASE WHEN r.cell_id = s.cell_id THEN 'CELL_ID,' ELSE '' END) AS keys,
    r.imsi, r.guti, r.tmsi, r.ue_ip, r.cell_id
  FROM fx_radio_events r JOIN fx_signals s ON s.trace_id = r.trace_id
),
fx_score AS (
  SELECT *, CASE WHEN base = 0 THEN CASE WHEN d <= 5000000 THEN 60 WHEN d <= 10000000 THEN 45 WHEN d <= 20000000 THEN 30 ELSE 0 END
    WHEN d <= 5000000 THEN least(base + 10, 99) WHEN d <= 10000000 THEN least(base + 5, 95) ELSE base END AS pct FROM fx_pairs
),
fx_corr AS (
  SELECT *, CASE WHEN pct >= 80 THEN 'HIGH' WHEN pct >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level,
    CASE WHEN d <= 5000000 THEN 'strong' WHEN d <= 10000000 THEN 'medium' WHEN d <= 20000000 THEN 'weak' ELSE 'none' END AS quality
  FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, row_no ORDER BY pct DESC, event_no) AS rn FROM fx_score WHERE pct >= 30)
  WHERE rn = 1
)"""


def _correlations(t: Inputs) -> DataFrame:
    return correlate.find_correlations(t.signals, t.radio_events)


@register(
    "j10_correlations",
    f"""WITH {_SCORED}
    SELECT trace_id, row_no, event_no, pct AS confidence_pct, level AS confidence_level, d AS delta_us, quality AS time_quality, keys
    FROM fx_corr""",
)
def _(t: Inputs) -> DataFrame:
    keys = F.array_join(F.transform("matched_keys", lambda k: F.concat(k["key"], F.lit(","))), "")
    return _correlations(t).select(
        "trace_id",
        "row_no",
        "event_no",
        "confidence_pct",
        "confidence_level",
        "delta_us",
        "time_quality",
        keys.alias("keys"),
    )


@register(
    "o8_top_correlations",
    f"""WITH {_SCORED}
    SELECT * FROM (SELECT trace_id, row_no, pct AS confidence_pct, row_number() OVER (PARTITION BY trace_id ORDER BY pct DESC, row_no) AS rank
      FROM fx_corr) WHERE rank <= 50""",
)
def _(t: Inputs) -> DataFrame:
    out = correlate.top_correlations(_correlations(t))
    return out.select(
        "trace_id", "row_no", "confidence_pct", F.col("rank").cast("bigint").alias("rank")
    )


@register(
    "a42_correlation_report",
    f"""WITH {_SCORED}
    SELECT trace_id, signal_events, radio_events, total_correlations, high_confidence_matches, medium_confidence_matches,
      low_confidence_matches, round(greatest(least(s1, r1) - greatest(s0, r0), 0) / 1e6, 6) AS overlap_seconds,
      'OVERLAPPING' AS time_alignment, 'CORRELATED' AS status
    FROM (SELECT trace_id, count(*) AS signal_events, min(ts_us) AS s0, max(ts_us) AS s1 FROM fx_signals GROUP BY 1)
    JOIN (SELECT trace_id, count(*) AS radio_events, min(ts_us) AS r0, max(ts_us) AS r1 FROM fx_radio_events GROUP BY 1) USING (trace_id)
    JOIN (SELECT trace_id, count(*) AS total_correlations, count(*) FILTER (pct >= 80) AS high_confidence_matches,
        count(*) FILTER (pct BETWEEN 50 AND 79) AS medium_confidence_matches, count(*) FILTER (pct < 50) AS low_confidence_matches
      FROM fx_corr GROUP BY 1) USING (trace_id)""",
)
def _(t: Inputs) -> DataFrame:
    out = correlate.correlation_report(t.signals, t.radio_events, _correlations(t))
    return out.withColumn("overlap_seconds", F.round("overlap_seconds", 6))


@register(
    "u9_matched_identifiers",
    f"""WITH {_SCORED}
    SELECT trace_id, 'IMSI' AS key, imsi AS value FROM fx_corr WHERE contains(keys, 'IMSI,')
    UNION SELECT trace_id, 'GUTI', guti FROM fx_corr WHERE contains(keys, 'GUTI,')
    UNION SELECT trace_id, 'TMSI', tmsi FROM fx_corr WHERE contains(keys, 'TMSI,')
    UNION SELECT trace_id, 'UE_IP', ue_ip FROM fx_corr WHERE contains(keys, 'UE_IP,')
    UNION SELECT trace_id, 'CELL_ID', cell_id FROM fx_corr WHERE contains(keys, 'CELL_ID,')""",
)
def _(t: Inputs) -> DataFrame:
    return correlate.matched_identifiers(_correlations(t))


@register(
    "r14_key_incidents",
    f"""WITH {_SCORED}
    SELECT * FROM (SELECT trace_id, row_no, CASE event_type WHEN 'RLF' THEN 'RLF_NEAR_CALL_EVENT' WHEN 'HO_FAIL' THEN 'HO_FAIL_NEAR_CALL'
        ELSE 'PAGING_NEAR_CALL' END AS type, pct AS confidence,
        row_number() OVER (PARTITION BY trace_id ORDER BY pct DESC, row_no) AS rank
      FROM fx_corr WHERE (event_type IN ('RLF', 'HO_FAIL') AND d <= 5000000) OR (event_type = 'PAGING' AND d <= 10000000))
    WHERE rank <= 20""",
)
def _(t: Inputs) -> DataFrame:
    out = correlate.key_incidents(correlate.incidents(_correlations(t)))
    return out.select(
        "trace_id", "row_no", "type", "confidence", F.col("rank").cast("bigint").alias("rank")
    )


@register(
    "r2_r3_correlated_findings",
    f"""WITH {_SCORED},
    inc AS (SELECT * FROM fx_corr
      WHERE (event_type IN ('RLF', 'HO_FAIL') AND d <= 5000000) OR (event_type = 'PAGING' AND d <= 10000000)),
    cnt AS (SELECT trace_id, count(*) FILTER (event_type = 'RLF') AS rlf, count(*) FILTER (event_type = 'HO_FAIL') AS ho
      FROM fx_radio_events GROUP BY 1)
    SELECT trace_id, 'RADIO_LINK_FAILURE_IMPACTING_CALL' AS finding_type, 90 AS confidence_pct FROM inc WHERE event_type = 'RLF'
    UNION ALL SELECT trace_id, 'RADIO_LINK_FAILURE_IMPACTING_CALL', 60 FROM cnt WHERE rlf > 0
      AND trace_id NOT IN (SELECT trace_id FROM inc WHERE event_type = 'RLF')
    UNION ALL SELECT trace_id, 'HANDOVER_FAILURE_OR_SRVCC', CASE WHEN trace_id IN (SELECT trace_id FROM inc WHERE event_type = 'HO_FAIL')
      THEN 85 ELSE 55 END FROM cnt WHERE ho > 0""",
)
def _(t: Inputs) -> DataFrame:
    events = t.radio_events.withColumns(
        {
            "event_label": F.col("event_type"),
            "generation": F.lit("4G"),
            "time_epoch": F.col("ts_us") / 1e6,
            "time_text": F.col("ts_us").cast("string"),
            "rsrp": F.lit(None).cast("double"),
            "paging": F.struct(F.lit(False).alias("success")),
            "raw": F.create_map().cast("map<string,string>"),
        }
    )
    hits = ops.rule_hits(events)
    incidents = correlate.incidents(_correlations(t))
    out = ops.link_failures(hits, incidents).unionByName(ops.handover_or_srvcc(hits, incidents))
    return out.select("trace_id", "finding_type", "confidence_pct")


_TIMELINE_SQL = """
    SELECT trace_id, ts_us, 'PCAP' AS source, event_no AS seq, type AS event_type, 'PCAP event' AS description, 'info' AS severity
    FROM fx_signals WHERE ts_us IS NOT NULL
    UNION ALL SELECT trace_id, ts_us, 'RADIO', row_no, event_type, event_type, CASE WHEN event_type IN ('RLF', 'HO_FAIL', 'PAGING')
      THEN 'critical' WHEN event_type = 'RRC_REESTABLISHMENT' THEN 'warning' ELSE 'info' END FROM fx_radio_events"""


@register("u3_cross_plane_timeline", _TIMELINE_SQL)
def _(t: Inputs) -> DataFrame:
    return correlate.cross_plane_timeline(t.signals, t.radio_events)


@register(
    "o10_timeline_by_time",
    f"SELECT * FROM ({_TIMELINE_SQL}) ORDER BY ts_us, trace_id, source, seq",
)
def _(t: Inputs) -> DataFrame:
    return correlate.by_time(correlate.cross_plane_timeline(t.signals, t.radio_events))


@register(
    "p33_radio_severity",
    """SELECT event_type, CASE WHEN event_type IN ('RLF', 'HO_FAIL', 'PAGING') THEN 'critical'
      WHEN event_type = 'RRC_REESTABLISHMENT' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n
    FROM fx_radio_events GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    severity = correlate.radio_severity(F.col("event_type")).alias("severity")
    return t.radio_events.groupBy("event_type", severity).agg(F.expr("count(1) AS n"))


@register(
    "o7_radio_events_by_time",
    "SELECT trace_id, row_no, ts_us FROM fx_radio_events ORDER BY ts_us, row_no",
)
def _(t: Inputs) -> DataFrame:
    return t.radio_events.select("trace_id", "row_no", "ts_us").orderBy("ts_us", "row_no")


@register(
    "f20_f21_entity_values",
    """SELECT event_no, coalesce(ts_us, event_no * 1000000) AS ts_us, coalesce(imsi, guti) AS id FROM fx_signals""",
)
def _(t: Inputs) -> DataFrame:
    seconds = F.when(F.col("ts_us").isNotNull(), F.format_string("%.6f", F.col("ts_us") / 1e6))
    return t.signals.select(
        "event_no",
        correlate.entity_time(seconds, F.col("event_no")).alias("ts_us"),
        correlate.entity_id(F.lit(""), F.col("imsi"), F.col("guti")).alias("id"),
    )
