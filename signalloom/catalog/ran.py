from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.catalog.base import Inputs, joined, r, register
from signalloom.operators import packets as packet_ops
from signalloom.operators import ran as ops
from signalloom.operators import transactions as tx_ops
from signalloom.session import cut_lineage

_KEYED = """
fx_ue AS (
  SELECT * FROM (SELECT *, CASE WHEN amf_id IS NOT NULL AND ran_id IS NOT NULL THEN concat('5g:amf=', amf_id, ':ran=', ran_id)
      WHEN mme_id IS NOT NULL AND enb_id IS NOT NULL THEN concat('4g:mme=', mme_id, ':enb=', enb_id)
      WHEN amf_id IS NOT NULL THEN concat('5g:amf=', amf_id) WHEN ran_id IS NOT NULL THEN concat('5g:ran=', ran_id)
      WHEN mme_id IS NOT NULL THEN concat('4g:mme=', mme_id) WHEN enb_id IS NOT NULL THEN concat('4g:enb=', enb_id)
      WHEN sccp_calling IS NOT NULL THEN concat('sccp:', sccp_calling, '-', sccp_called)
      WHEN src IS NOT NULL AND sctp_assoc IS NOT NULL THEN concat('sctp:', sctp_assoc, ':', least(src, dst), '-', greatest(src, dst))
      WHEN src IS NOT NULL THEN concat('ip:', least(src, dst), '-', greatest(src, dst)) END AS ue_key
    FROM fx_ran_events) WHERE ue_key IS NOT NULL
),
fx_timeline AS (
  SELECT capture_id, ue_key, arg_max(generation, ts_us * 10000000 + frame_number) AS gen,
    string_agg(DISTINCT protocol, '|' ORDER BY protocol) AS protocols, min(ts_us) AS start_us, max(ts_us) AS end_us,
    count(*) AS event_count FROM fx_ue GROUP BY 1, 2
)"""

_FINDING = ["capture_id", "ue_key", "generation", "confidence_pct", "severity", "start_us", "end_us"]


def _events(t: Inputs) -> DataFrame:
    return ops.with_ue_key(t.ran_events)


def _view(df: DataFrame) -> DataFrame:
    return df.select(*_FINDING, "description", joined("evidence"))


@register(
    "a35_ue_keys",
    f"WITH {_KEYED} SELECT capture_id, frame_number, ue_key FROM fx_ue",
)
def _(t: Inputs) -> DataFrame:
    return _events(t).select("capture_id", "frame_number", "ue_key")


@register(
    "a34_ue_timelines",
    f"""WITH {_KEYED}
    SELECT capture_id, ue_key, gen AS generation, protocols, start_us, end_us, event_count,
      round((end_us - start_us) / 1e6, 6) AS duration FROM fx_timeline""",
)
def _(t: Inputs) -> DataFrame:
    out = ops.ue_timelines(_events(t))
    return out.select(
        "capture_id",
        "ue_key",
        "generation",
        joined("protocols"),
        "start_us",
        "end_us",
        "event_count",
        r("duration"),
    )


@register(
    "s16_timeline_samples",
    f"""WITH {_KEYED}
    SELECT * FROM (SELECT capture_id, ue_key, frame_number, ts_us, row_number() OVER (PARTITION BY capture_id, ue_key
      ORDER BY ts_us, frame_number) AS rank FROM fx_ue) WHERE rank <= 10""",
)
def _(t: Inputs) -> DataFrame:
    return ops.timeline_samples(_events(t)).select(
        "capture_id", "ue_key", "frame_number", "ts_us", F.col("rank").cast("bigint").alias("rank")
    )


@register(
    "p25_coverage_flags",
    """SELECT capture_id, bool_or(generation = '4G') AS has_4g, bool_or(generation = '5G') AS has_5g,
      bool_or(protocol = 'S1AP') AS has_s1ap, bool_or(protocol = 'NGAP') AS has_ngap, bool_or(protocol = 'SCTP') AS has_sctp,
      bool_or(protocol = 'RANAP') AS has_ranap FROM fx_ran_events GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return ops.coverage_flags(t.ran_events).select(
        "capture_id", "has_4g", "has_5g", "has_s1ap", "has_ngap", "has_sctp", "has_ranap"
    )


_RELEASES = """
fx_d15 AS (
  SELECT e.capture_id, e.ue_key, gen AS generation, CASE WHEN radio THEN 90 ELSE 70 END AS confidence_pct,
    CASE WHEN radio THEN 'warning' ELSE 'info' END AS severity, ts_us AS start_us, ts_us AS end_us,
    concat(CASE WHEN radio THEN 'Context released for a radio cause: ' ELSE 'Context released: ' END,
      coalesce(cause_label, 'none given')) AS description,
    concat('Frame ', frame_number, ': ', procedure_label, ' - ', coalesce(cause_label, 'None')) AS evidence
  FROM (SELECT *, coalesce(regexp_matches(lower(cause_label), 'radio|user inactivity|release due to'), false) AS radio FROM fx_ue
    WHERE procedure_label = 'UEContextRelease') e JOIN fx_timeline USING (capture_id, ue_key) WHERE gen IN ('4G', '5G')
)"""


@register("d15_context_releases", f"WITH {_KEYED}, {_RELEASES} SELECT * FROM fx_d15")
def _(t: Inputs) -> DataFrame:
    return _view(ops.context_releases(_events(t)))


_HANDOVERS = """
fx_bad AS (
  SELECT *, (procedure_label = 'HandoverCancel' OR coalesce(contains(lower(cause_label), 'handover'), false)) AS failed FROM fx_ue
  WHERE procedure_label = 'HandoverCancel' OR coalesce(contains(lower(cause_label), 'handover'), false)
    OR (contains(lower(procedure_label), 'release') AND coalesce(contains(lower(cause_label), 'ho'), false))
),
fx_pair AS (
  SELECT p.capture_id, p.ue_key, p.frame_number, p.ts_us, min(b.ts_us) AS hit_us, arg_min(b.frame_number, b.ts_us * 10000000 + b.frame_number) AS hit
  FROM fx_ue p JOIN fx_bad b ON b.capture_id = p.capture_id AND b.ue_key = p.ue_key AND b.ts_us > p.ts_us
    AND b.ts_us <= p.ts_us + 3000000
  WHERE p.procedure_label = 'HandoverPreparation' GROUP BY 1, 2, 3, 4
),
fx_d16 AS (
  SELECT p.capture_id, p.ue_key, gen AS generation, CASE WHEN failed THEN 90 ELSE 70 END AS confidence_pct,
    CASE WHEN failed THEN 'critical' ELSE 'warning' END AS severity, p.ts_us AS start_us, b.ts_us AS end_us,
    p.frame_number, p.hit FROM fx_pair p JOIN fx_bad b ON b.capture_id = p.capture_id AND b.frame_number = p.hit
  JOIN fx_timeline t ON t.capture_id = p.capture_id AND t.ue_key = p.ue_key
)"""


@register(
    "j9_d16_handover_failures",
    f"WITH {_KEYED}, {_HANDOVERS} SELECT {', '.join(_FINDING)}, frame_number, hit FROM fx_d16",
)
def _(t: Inputs) -> DataFrame:
    out = ops.handover_failures(_events(t))
    frames = [
        F.regexp_extract(F.get("evidence", F.lit(i)), r"Frame (\d+)", 1).cast("bigint")
        for i in (0, 1)
    ]
    return out.select(*_FINDING, frames[0].alias("frame_number"), frames[1].alias("hit"))


_RLF = """
fx_d17 AS (
  SELECT e.capture_id, e.ue_key, gen AS generation, 95 AS confidence_pct, 'critical' AS severity, ts_us AS start_us, ts_us AS end_us,
    concat('Radio link lost: ', cause_label) AS description,
    concat('Frame ', frame_number, ': ', procedure_label, ' - ', cause_label) AS evidence
  FROM fx_ue e JOIN fx_timeline USING (capture_id, ue_key) WHERE cause_label = 'Radio link failure'
)"""


@register("d17_radio_link_failures", f"WITH {_KEYED}, {_RLF} SELECT * FROM fx_d17")
def _(t: Inputs) -> DataFrame:
    return _view(ops.radio_link_failures(_events(t)))


_CONGESTION = """
fx_ahead AS (
  SELECT capture_id, ue_key, ts_us, frame_number, count(*) OVER w AS n,
    bool_or(coalesce(lower(cause_label) = 'congestion', false)) OVER w AS crowded, max(ts_us) OVER w AS last_us
  FROM fx_ue WINDOW w AS (PARTITION BY capture_id, ue_key ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 5000000 FOLLOWING)
),
fx_anchor AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, ue_key ORDER BY ts_us, frame_number) AS rn FROM fx_ahead WHERE n >= 10
),
fx_d18 AS (
  SELECT capture_id, ue_key, gen AS generation, CASE WHEN crowded THEN 85 ELSE 65 END AS confidence_pct, 'warning' AS severity,
    ts_us AS start_us, last_us AS end_us, concat('Signaling congestion: ', n, ' events in 5.0s window') AS description,
    concat('Frames ', frame_number, ' to ', (SELECT max(frame_number) FROM fx_ue x WHERE x.capture_id = a.capture_id
      AND x.ue_key = a.ue_key AND x.ts_us = a.last_us)) AS evidence
  FROM fx_anchor a JOIN fx_timeline USING (capture_id, ue_key) WHERE rn = 1
)"""


@register("w1_d18_signalling_congestion", f"WITH {_KEYED}, {_CONGESTION} SELECT * FROM fx_d18")
def _(t: Inputs) -> DataFrame:
    return _view(ops.signalling_congestion(_events(t)))


def _first_frames(test: str) -> str:
    return f"""(SELECT capture_id, count(*) AS n, min(ts_us) AS start_us, max(ts_us) AS end_us,
      array_to_string(list(concat('Frame ', frame_number) ORDER BY ts_us, frame_number)[1:5], '|') AS evidence
      FROM fx_ue WHERE {test} GROUP BY 1)"""


_TRANSPORT = f"""
fx_d19 AS (
  SELECT capture_id, 'transport_global' AS ue_key, 'Transport' AS generation, 90 AS confidence_pct, 'critical' AS severity,
    start_us, end_us, concat('SCTP ABORT detected (', n, ' events)') AS description, evidence
  FROM {_first_frames("protocol = 'SCTP' AND chunk_type = '6'")}
  UNION ALL SELECT capture_id, 'transport_global', 'Transport', 70, 'warning', start_us, end_us,
    concat('High SCTP retransmission rate (', n, ' retrans)'), evidence
  FROM {_first_frames("protocol = 'SCTP' AND retransmission")} WHERE n > 5
)"""


@register("d19_transport_instability", f"WITH {_KEYED}, {_TRANSPORT} SELECT * FROM fx_d19")
def _(t: Inputs) -> DataFrame:
    return _view(ops.transport_instability(_events(t)))


_PAGING = f"""
fx_d20 AS (
  SELECT capture_id, 'paging_global' AS ue_key, 'Mixed' AS generation, 40 AS confidence_pct, 'info' AS severity, start_us, end_us,
    concat('High paging activity (', n, ' paging events) - may indicate UE reachability issues') AS description, evidence
  FROM {_first_frames("procedure_label = 'Paging'")} WHERE n > 10
)"""


@register("d20_paging_activity", f"WITH {_KEYED}, {_PAGING} SELECT * FROM fx_d20")
def _(t: Inputs) -> DataFrame:
    return _view(ops.paging_activity(_events(t)))


_ALL = (
    f"{_KEYED}, {_RELEASES}, {_HANDOVERS}, {_RLF}, {_CONGESTION}, {_TRANSPORT}, {_PAGING}"
    + ",\nfx_ran AS ("
    + " UNION ALL ".join(
        f"SELECT {', '.join(_FINDING)}, '{kind}' AS type FROM fx_{d}"
        for d, kind in [
            ("d15", "UE_CONTEXT_RELEASE"),
            ("d16", "HANDOVER_FAILURE"),
            ("d17", "RADIO_LINK_FAILURE"),
            ("d18", "SIGNALING_CONGESTION"),
            ("d19", "TRANSPORT_INSTABILITY"),
            ("d20", "PAGING_FAILURE"),
        ]
    )
    + ")"
)


@register("d21_ran_findings", f"WITH {_ALL} SELECT * FROM fx_ran")
def _(t: Inputs) -> DataFrame:
    return ops.ran_findings(cut_lineage(_events(t))).select(*_FINDING, "type")


@register(
    "o6_ran_events_by_time",
    f"WITH {_KEYED} SELECT capture_id, ue_key, ts_us, frame_number FROM fx_ue ORDER BY ts_us, frame_number",
)
def _(t: Inputs) -> DataFrame:
    return (
        _events(t)
        .select("capture_id", "ue_key", "ts_us", "frame_number")
        .orderBy("ts_us", "frame_number")
    )


# Dissected rows: transactions and RAN events.
_TX = """
fx_tx AS (
  SELECT capture_id, CAST(frame_number AS BIGINT) AS frame_number, CAST(CAST(frame_time_epoch AS DECIMAL(20, 6)) * 1000000 AS BIGINT) AS ts_us,
    CASE WHEN kind = 3 THEN 'NGAP' WHEN kind = 0 THEN 'PFCP' WHEN kind = 1 THEN 'GTPv2-C' WHEN kind = 2 THEN 'GTP-U' WHEN kind = 4 THEN 'S1AP'
      WHEN kind = 5 THEN 'Diameter' WHEN kind = 6 THEN 'SIP' ELSE 'Unknown' END AS protocol,
    CASE kind WHEN 0 THEN concat('PFCP-Msg-', pfcp_msg_type) WHEN 1 THEN concat('GTP-Msg-', gtp_message)
      WHEN 3 THEN concat('Proc-', ngap_procedureCode) WHEN 4 THEN concat('Proc-', s1ap_procedureCode)
      WHEN 5 THEN concat('Cmd-', diameter_cmd_code) WHEN 6 THEN coalesce(sip_Method, concat(sip_Status_Code, ' Response'))
      ELSE 'Unknown' END AS message_type,
    CASE WHEN sctp_retransmission = '1' THEN 'SCTP Retransmission' WHEN nas_5gs_mm_5gmm_cause IS NOT NULL
      THEN concat('EMM:', nas_5gs_mm_5gmm_cause) ELSE coalesce(pfcp_cause, gtp_cause, ngap_cause, diameter_Result_Code,
      diameter_Experimental_Result_Code, sip_Reason) END AS cause,
    coalesce(pfcp_seqno, gtp_seq) AS seq, coalesce(pfcp_seid, CASE WHEN kind = 1 THEN gtp_teid END) AS sess_id,
    sctp_retransmission IS NOT NULL AS retransmission,
    CASE WHEN sctp_verification_tag IS NOT NULL THEN 'SCTP' END AS transport, nas_5gs_mm_message_type AS nas_msg
  FROM (SELECT *, CASE WHEN pfcp_msg_type IS NOT NULL THEN 0 WHEN gtp_message IS NOT NULL THEN 1 WHEN gtp_teid IS NOT NULL THEN 2
      WHEN ngap_procedureCode IS NOT NULL THEN 3 WHEN s1ap_procedureCode IS NOT NULL THEN 4 WHEN diameter_cmd_code IS NOT NULL THEN 5
      WHEN sip_Call_ID IS NOT NULL THEN 6 ELSE 9 END AS kind FROM fx_fields)
  WHERE kind < 9 OR sctp_retransmission = '1'
)"""


@register("p7_build_transactions", f"WITH {_TX} SELECT * FROM fx_tx")
def _(t: Inputs) -> DataFrame:
    return tx_ops.build_transactions(t.fields).select(
        "capture_id",
        "frame_number",
        "ts_us",
        "protocol",
        "message_type",
        "cause",
        "seq",
        "sess_id",
        "retransmission",
        "transport",
        F.col("info")["nas_msg"].alias("nas_msg"),
    )


_RAN_ROWS = """
fx_ran_row AS (
  SELECT capture_id, CAST(frame_number AS BIGINT) AS frame_number, 'NGAP' AS protocol, '5G' AS generation,
    CAST(ngap_procedureCode AS INT) AS procedure_code, ngap_cause_radioNetwork AS cause_raw FROM fx_fields WHERE ngap_procedureCode IS NOT NULL
  UNION ALL SELECT capture_id, CAST(frame_number AS BIGINT), 'S1AP', '4G', CAST(s1ap_procedureCode AS INT), NULL FROM fx_fields
    WHERE s1ap_procedureCode IS NOT NULL
  UNION ALL SELECT capture_id, CAST(frame_number AS BIGINT), 'SCTP', 'Unknown', NULL, NULL FROM fx_fields WHERE sctp_verification_tag IS NOT NULL
)"""


@register(
    "p19_p24_ran_events",
    f"""WITH {_RAN_ROWS}
    SELECT *, CASE WHEN protocol = 'NGAP' THEN CASE procedure_code WHEN 12 THEN 'HandoverPreparation' WHEN 13 THEN 'HandoverResourceAllocation'
        WHEN 14 THEN 'InitialContextSetup' WHEN 15 THEN 'InitialUEMessage' WHEN 16 THEN 'HandoverCancel' WHEN 25 THEN 'DownlinkNASTransport'
        WHEN 26 THEN 'PDUSessionResourceSetup' WHEN 27 THEN 'PDUSessionResourceModify' WHEN 28 THEN 'PDUSessionResourceRelease'
        WHEN 36 THEN 'Paging' WHEN 41 THEN 'UEContextRelease' WHEN 42 THEN 'UEContextReleaseRequest' WHEN 43 THEN 'UEContextModification'
        WHEN 46 THEN 'UplinkNASTransport' ELSE concat('ProcedureCode_', procedure_code) END
      WHEN protocol = 'S1AP' THEN CASE procedure_code WHEN 0 THEN 'HandoverPreparation' WHEN 1 THEN 'HandoverResourceAllocation'
        WHEN 2 THEN 'HandoverNotification' WHEN 3 THEN 'PathSwitchRequest' WHEN 4 THEN 'HandoverCancel' WHEN 5 THEN 'E-RABSetup'
        WHEN 6 THEN 'E-RABModify' WHEN 7 THEN 'E-RABRelease' WHEN 8 THEN 'E-RABReleaseIndication' WHEN 9 THEN 'InitialContextSetup'
        WHEN 10 THEN 'InitialContextSetupFailure' WHEN 12 THEN 'InitialUEMessage' WHEN 13 THEN 'DownlinkNASTransport' WHEN 14 THEN 'Paging'
        WHEN 17 THEN 'UECapabilityInfoIndication' WHEN 21 THEN 'UEContextReleaseRequest' WHEN 23 THEN 'UEContextRelease'
        WHEN 24 THEN 'UEContextReleaseCommand' WHEN 25 THEN 'UEContextModification' WHEN 27 THEN 'UplinkNASTransport'
        ELSE concat('ProcedureCode_', procedure_code) END END AS procedure_label,
      CASE CAST(cause_raw AS INT) WHEN 15 THEN 'Unspecified' WHEN 20 THEN 'Release due to UE generated signalling connection release'
        WHEN 26 THEN 'Failure in the Radio Interface Procedure' WHEN 27 THEN 'Release due to pre-emption'
        ELSE CASE WHEN cause_raw IS NOT NULL THEN concat('Unknown Cause ', cause_raw) END END AS cause_label FROM fx_ran_row""",
)
def _(t: Inputs) -> DataFrame:
    return ops.ran_events(t.fields).select(
        "capture_id",
        "frame_number",
        "protocol",
        "generation",
        "procedure_code",
        "cause_raw",
        "procedure_label",
        "cause_label",
    )


@register(
    "a44_sctp_statistics",
    """SELECT capture_id, sctp_verification_tag, count(*) AS chunks, count(*) FILTER (sctp_chunk_type = '6') AS aborts,
      count(*) FILTER (sctp_retransmission = '1') AS retransmissions FROM fx_fields
    WHERE sctp_verification_tag IS NOT NULL GROUP BY 1, 2""",
)
def _(t: Inputs) -> DataFrame:
    return packet_ops.sctp_statistics(t.fields)
