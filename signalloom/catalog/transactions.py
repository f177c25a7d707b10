from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.catalog.base import Inputs, joined, r, register
from signalloom.operators import transactions as ops
from signalloom.sources.sample_tables import SAMPLE_SPAN


def _paired(t: Inputs) -> DataFrame:
    return ops.pair_transactions(t.transactions, span=SAMPLE_SPAN)


def _compared(t: Inputs) -> DataFrame:
    return ops.compare_windows(_paired(t), span=SAMPLE_SPAN, timeline=t.transactions)


# A response takes the latest earlier request of its reversed key, unless an earlier response did.
_PAIRED = """
fx_resp AS (
  SELECT r.capture_id, r.frame_number AS resp, max(q.frame_number) AS req
  FROM fx_transactions r JOIN fx_transactions q ON q.cause IS NULL AND r.cause IS NOT NULL
    AND q.capture_id = r.capture_id AND q.protocol = r.protocol AND q.seq = r.seq AND q.sess_id = r.sess_id
    AND q.src = r.dst AND q.dst = r.src AND q.frame_number < r.frame_number
  GROUP BY 1, 2
),
fx_match AS (SELECT capture_id, req, min(resp) AS resp FROM fx_resp GROUP BY 1, 2),
fx_paired AS (
  SELECT t.*, CASE WHEN t.cause IS NULL THEN 'request' WHEN b.req IS NOT NULL THEN 'response' END AS type,
    CASE WHEN t.cause IS NULL THEN CASE WHEN x.frame_number IS NULL THEN 'no_response'
      WHEN (t.protocol = 'PFCP' AND x.cause = '1') OR (t.protocol = 'GTPv2-C' AND x.cause = '16') THEN 'success'
      ELSE 'failure' END END AS status,
    greatest(x.ts_us - t.ts_us, 0 * x.ts_us) AS latency_us, x.frame_number AS response_frame,
    x.cause_label AS response_cause, b.req AS req_frame
  FROM fx_transactions t
  LEFT JOIN fx_match a ON a.capture_id = t.capture_id AND a.req = t.frame_number
  LEFT JOIN fx_transactions x ON x.capture_id = a.capture_id AND x.frame_number = a.resp
  LEFT JOIN fx_match b ON b.capture_id = t.capture_id AND b.resp = t.frame_number
)"""

_CELLS = (
    _PAIRED
    + """,
fx_top AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, procedure ORDER BY n DESC, first) AS rank
  FROM (SELECT capture_id, message_type AS procedure, cause_label AS cause, count(*) AS n,
          min(frame_number) AS first FROM fx_paired WHERE cause IS NOT NULL GROUP BY 1, 2, 3)
)"""
)


@register(
    "j1_pair_transactions",
    f"""WITH {_PAIRED}
    SELECT capture_id, frame_number, protocol, message_type, type, status, latency_us, response_frame,
      response_cause, req_frame FROM fx_paired""",
)
def _(t: Inputs) -> DataFrame:
    return _paired(t).select(
        "capture_id",
        "frame_number",
        "protocol",
        "message_type",
        "type",
        "status",
        "latency_us",
        "response_frame",
        "response_cause",
        "req_frame",
    )


@register(
    "j13_unanswered_requests",
    f"""WITH {_PAIRED}
    SELECT capture_id, frame_number, protocol, message_type FROM fx_paired WHERE status = 'no_response'""",
)
def _(t: Inputs) -> DataFrame:
    return ops.unanswered_requests(_paired(t)).select(
        "capture_id", "frame_number", "protocol", "message_type"
    )


@register(
    "a7_procedure_kpis",
    f"""WITH {_PAIRED}
    SELECT capture_id, message_type AS procedure, count(*) AS attempts,
      count(*) FILTER (status = 'success') AS successes, count(*) FILTER (type = 'request') AS requests,
      round(count(*) FILTER (status = 'success') * 100.0 / count(*), 6) AS success_rate,
      round(count(*) FILTER (status = 'success') * 100.0 / nullif(count(*) FILTER (type = 'request'), 0), 6)
        AS request_success_rate,
      round(coalesce(avg(latency_us) / 1000, 0), 6) AS avg_latency_ms
    FROM fx_paired GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return ops.procedure_kpis(_paired(t)).select(
        "capture_id",
        "procedure",
        "attempts",
        "successes",
        "requests",
        r("success_rate"),
        r("request_success_rate"),
        r("avg_latency_ms"),
    )


@register(
    "o5_top_causes",
    f"""WITH {_CELLS}
    SELECT capture_id, procedure, rank, cause, n FROM fx_top WHERE rank <= 5""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.procedure_top_causes(_paired(t))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


_HALVES = (
    _PAIRED
    + """,
fx_half AS (
  SELECT *, CASE WHEN rn <= greatest(1, CAST(floor(n * 0.25) AS BIGINT)) THEN 'b' ELSE 'i' END AS half
  FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts_us, frame_number) AS rn,
          count(*) OVER (PARTITION BY capture_id) AS n FROM fx_paired)
),
fx_hkpi AS (
  SELECT capture_id, half, message_type AS procedure,
    count(*) FILTER (status = 'success') * 100.0 / count(*) AS rate, coalesce(avg(latency_us) / 1000, 0) AS ms
  FROM fx_half GROUP BY 1, 2, 3
),
fx_hcause AS (
  SELECT capture_id, half, message_type AS procedure, list(DISTINCT cause_label) AS causes
  FROM fx_half WHERE cause IS NOT NULL GROUP BY 1, 2, 3
),
fx_delta AS (
  SELECT capture_id, procedure, coalesce(b.rate, 0) AS baseline_rate, coalesce(i.rate, 0) AS incident_rate,
    coalesce(b.ms, 0) AS baseline_ms, coalesce(i.ms, 0) AS incident_ms,
    coalesce(list_filter(ic.causes, lambda x: NOT coalesce(list_contains(bc.causes, x), false)), []) AS fresh
  FROM (SELECT * FROM fx_hkpi WHERE half = 'b') b FULL JOIN (SELECT * FROM fx_hkpi WHERE half = 'i') i
    USING (capture_id, procedure)
  LEFT JOIN (SELECT * FROM fx_hcause WHERE half = 'b') bc USING (capture_id, procedure)
  LEFT JOIN (SELECT * FROM fx_hcause WHERE half = 'i') ic USING (capture_id, procedure)
),
fx_change AS (
  SELECT *, CASE WHEN incident_rate - baseline_rate < -5 THEN 'degradation'
      WHEN incident_rate - baseline_rate > 5 THEN 'improvement' END AS rate_change,
    CASE WHEN baseline_ms > 0 AND (incident_ms - baseline_ms) / baseline_ms * 100 > 25 THEN 'degradation' END
      AS latency_change
  FROM fx_delta
),
fx_changed AS (SELECT * FROM fx_change WHERE rate_change IS NOT NULL OR latency_change IS NOT NULL OR len(fresh) > 0)"""
)


@register(
    "a8_compare_windows",
    f"""WITH {_HALVES}
    SELECT capture_id, procedure, round(baseline_rate, 6) AS baseline_rate, round(incident_rate, 6) AS incident_rate,
      round(baseline_ms, 6) AS baseline_ms, round(incident_ms, 6) AS incident_ms, rate_change, latency_change,
      array_to_string(list_sort(fresh), '|') AS new_causes FROM fx_changed""",
)
def _(t: Inputs) -> DataFrame:
    return _compared(t).select(
        "capture_id",
        "procedure",
        r("baseline_rate"),
        r("incident_rate"),
        r("baseline_ms"),
        r("incident_ms"),
        "rate_change",
        "latency_change",
        joined("new_causes"),
    )


@register(
    "a8_window_summary",
    f"""WITH {_HALVES}
    SELECT capture_id, count(*) FILTER (rate_change = 'degradation') AS degraded_procedures,
      count(*) FILTER (rate_change = 'improvement') AS improved_procedures,
      bool_or(len(fresh) > 0) AS new_failure_codes_detected FROM fx_changed GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return ops.window_summary(_compared(t))


_LATENCY = (
    _PAIRED
    + """,
fx_stats AS (
  SELECT capture_id, protocol, count(*) AS transaction_count, min(latency_us) / 1000 AS latency_min_ms,
    max(latency_us) / 1000 AS latency_max_ms, avg(latency_us) / 1000 AS latency_mean_ms,
    quantile_cont(latency_us, 0.5) / 1000 AS latency_median_ms, quantile_cont(latency_us, 0.95) / 1000 AS latency_p95_ms,
    quantile_cont(latency_us, 0.99) / 1000 AS latency_p99_ms
  FROM fx_paired WHERE latency_us IS NOT NULL GROUP BY 1, 2
),
fx_limit AS (SELECT * FROM (VALUES ('GTPv2-C', 500.0, 1500.0, 3000.0, 2, 4), ('PFCP', 1000.0, 3000.0, 5000.0, 2, 3))
  x(protocol, warning, critical, timeout, retry_warning, retry_critical)),
fx_anomaly AS (
  SELECT capture_id, 'latency_spike' AS type, CASE WHEN latency_us / 1000 >= critical THEN 'critical' ELSE 'warning' END AS severity,
    protocol, frame_number, message_type, CASE WHEN latency_us / 1000 >= critical THEN response_frame END AS response_frame,
    CASE WHEN latency_us / 1000 >= critical THEN critical ELSE warning END AS threshold_ms, latency_us / 1000 AS observed_ms
  FROM fx_paired JOIN fx_limit USING (protocol) WHERE latency_us / 1000 >= warning
  UNION ALL SELECT capture_id, 'timeout', 'critical', protocol, frame_number, message_type, NULL, timeout, NULL
  FROM fx_paired JOIN fx_limit USING (protocol) WHERE status = 'no_response'
  UNION ALL SELECT capture_id, 'latency_spike', CASE WHEN latency_p95_ms < critical THEN 'warning' ELSE 'critical' END, protocol,
    NULL, NULL, NULL, warning, latency_p95_ms FROM fx_stats JOIN fx_limit USING (protocol) WHERE latency_p95_ms >= warning
  UNION ALL SELECT capture_id, 'retransmission', CASE WHEN n >= retry_critical THEN 'critical' ELSE 'warning' END, protocol,
    NULL, NULL, NULL, CASE WHEN n >= retry_critical THEN retry_critical ELSE retry_warning END, n
  FROM (SELECT capture_id, protocol, count(*) AS n FROM fx_paired WHERE retransmission GROUP BY 1, 2)
  JOIN fx_limit USING (protocol) WHERE n >= retry_warning
)"""
)

_STATS = ["min", "max", "mean", "median", "p95", "p99"]


@register(
    "a9_latency_statistics",
    f"""WITH {_LATENCY}
    SELECT capture_id, protocol, transaction_count,
      {", ".join(f"round(latency_{c}_ms, 4) AS latency_{c}_ms" for c in _STATS)},
      timeout_count, retransmission_count
    FROM fx_stats JOIN (SELECT capture_id, protocol, count(*) FILTER (status = 'no_response') AS timeout_count,
      count(*) FILTER (retransmission) AS retransmission_count FROM fx_paired GROUP BY 1, 2)
    USING (capture_id, protocol)""",
)
def _(t: Inputs) -> DataFrame:
    return ops.latency_statistics(_paired(t)).select(
        "capture_id",
        "protocol",
        "transaction_count",
        *[r(f"latency_{c}_ms", 4) for c in _STATS],
        "timeout_count",
        "retransmission_count",
    )


_ANOMALY_SELECT = """SELECT capture_id, type, severity, protocol, frame_number, message_type, response_frame,
      CAST(threshold_ms AS DOUBLE) AS threshold_ms, round(observed_ms, 4) AS observed_ms FROM fx_anomaly"""


def _plain(df: DataFrame) -> DataFrame:
    return df.select(
        "capture_id",
        "type",
        "severity",
        "protocol",
        "frame_number",
        "message_type",
        "response_frame",
        "threshold_ms",
        r("observed_ms", 4),
    )


@register(
    "a11_latency_spikes",
    f"WITH {_LATENCY} {_ANOMALY_SELECT} WHERE type = 'latency_spike' AND frame_number IS NOT NULL",
)
def _(t: Inputs) -> DataFrame:
    return _plain(ops.latency_spikes(_paired(t)))


@register("a12_timeouts", f"WITH {_LATENCY} {_ANOMALY_SELECT} WHERE type = 'timeout'")
def _(t: Inputs) -> DataFrame:
    return _plain(ops.timeouts(_paired(t)))


@register(
    "a13_systemic_latency",
    f"WITH {_LATENCY} {_ANOMALY_SELECT} WHERE type = 'latency_spike' AND frame_number IS NULL",
)
def _(t: Inputs) -> DataFrame:
    return _plain(ops.systemic_latency(ops.latency_statistics(_paired(t))))


@register(
    "a14_retransmission_storms",
    f"WITH {_LATENCY} {_ANOMALY_SELECT} WHERE type = 'retransmission'",
)
def _(t: Inputs) -> DataFrame:
    return _plain(ops.retransmission_storms(_paired(t)))


@register(
    "a15_temporal_summary",
    f"""WITH {_LATENCY}
    SELECT capture_id, total_anomalies, critical_count, warning_count, timeout_count, retransmission_count, protocols_analyzed
    FROM (SELECT capture_id, count(*) AS total_anomalies, count(*) FILTER (severity = 'critical') AS critical_count,
        count(*) FILTER (severity = 'warning') AS warning_count FROM fx_anomaly GROUP BY 1)
    JOIN (SELECT capture_id, count(*) FILTER (status = 'no_response') AS timeout_count,
        count(*) FILTER (retransmission) AS retransmission_count,
        string_agg(DISTINCT protocol, '|' ORDER BY protocol) FILTER (latency_us IS NOT NULL) AS protocols_analyzed
      FROM fx_paired GROUP BY 1) USING (capture_id)""",
)
def _(t: Inputs) -> DataFrame:
    return ops.temporal_summary(_paired(t)).select(
        "capture_id",
        "total_anomalies",
        "critical_count",
        "warning_count",
        "timeout_count",
        "retransmission_count",
        joined("protocols_analyzed"),
    )
