"""Streaming twins, replayed over the derived tables. The SQL knows the last watermark: the latest time in whole
milliseconds less the allowed lateness of 10 s."""

from __future__ import annotations

from pyspark.sql import DataFrame

from signalloom.catalog.base import Inputs, register
from signalloom.catalog.ran import _KEYED
from signalloom.catalog.transactions import _PAIRED
from signalloom.operators import ran
from signalloom.streaming import alarms, traffic
from signalloom.streaming.replay import replayed


def _passed(table: str) -> str:
    return f"(SELECT (max(ts_us) // 1000 - 10000) * 1000 FROM {table})"


@register(
    "x1_traffic_counters",
    f"""SELECT capture_id, ts_us // 1000000 * 1000000 AS interval_us, count(*) AS frames, CAST(sum(length) AS BIGINT) AS bytes
    FROM fx_packets GROUP BY 1, 2 HAVING ts_us // 1000000 * 1000000 + 1000000 <= {_passed("fx_packets")}""",
)
def _(t: Inputs) -> DataFrame:
    return replayed(traffic.traffic_counters(t.stream("packets")))


# A flow is closed after 60.005 s without packets, a gap that no two packets have exactly.
@register(
    "x2_closed_flows",
    f"""WITH fx_ends AS (
      SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN fwd THEN src_port ELSE dst_port END AS port_a,
        CASE WHEN fwd THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN fwd THEN dst_port ELSE src_port END AS port_b
      FROM (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS fwd FROM fx_packets)
    ), fx_gap AS (
      SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= 60005000 THEN 0 ELSE 1 END AS opens FROM fx_ends
      WINDOW w AS (PARTITION BY capture_id, ip_a, port_a, ip_b, port_b, transport ORDER BY ts_us, frame_number)
    ), fx_session AS (
      SELECT *, sum(opens) OVER (PARTITION BY capture_id, ip_a, port_a, ip_b, port_b, transport ORDER BY ts_us, frame_number) AS s FROM fx_gap
    )
    SELECT capture_id, ip_a, port_a, ip_b, port_b, transport, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS total_bytes,
      min(ts_us) AS start_us, max(ts_us) AS end_us
    FROM fx_session GROUP BY 1, 2, 3, 4, 5, 6, s HAVING max(ts_us) + 60005000 <= {_passed("fx_packets")}""",
)
def _(t: Inputs) -> DataFrame:
    return replayed(traffic.closed_flows(t.stream("packets"), "60005 milliseconds"))


@register(
    "x3_unanswered_alarms",
    f"""WITH {_PAIRED}
    SELECT capture_id, protocol, frame_number, ts_us, due_us FROM (SELECT *, ts_us
      + CASE protocol WHEN 'PFCP' THEN 5000000 ELSE 3000000 END AS due_us FROM fx_paired WHERE type = 'request')
    WHERE (status = 'no_response' OR ts_us + latency_us > due_us) AND due_us <= {_passed("fx_transactions")}""",
)
def _(t: Inputs) -> DataFrame:
    return replayed(alarms.unanswered_alarms(t.stream("transactions")))


@register(
    "x4_anchored_congestion",
    f"""WITH {_KEYED}, fx_seen AS (
      SELECT *, lead(ts_us, 9) OVER (PARTITION BY capture_id, ue_key ORDER BY ts_us) AS tenth FROM fx_ue WHERE ts_us <= {_passed("fx_ue")}
    )
    SELECT capture_id, ue_key, min(ts_us) AS start_us, arg_min(tenth, ts_us) AS reached_us
    FROM fx_seen WHERE tenth - ts_us <= 5000000 GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return replayed(alarms.anchored_congestion(ran.with_ue_key(t.stream("ran_events"))))
