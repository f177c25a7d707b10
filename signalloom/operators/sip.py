"""SIP calls and registrations from messages, by conditional aggregates per Call-ID.

``sip_messages`` carries capture_id, frame_number, ts_us, call_id, msg_type (method, or
``Response``), status_code, reason, session_expires, min_se, refer_to, referred_by, event, src, dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.config import CallRules
from signalloom.functions.sdp import session_expires
from signalloom.operators.packets import optional

KEY = ["capture_id", "call_id"]
_RULES = CallRules()


def _first(value: str, test: str) -> str:
    return f"min_by({value}, frame_number) FILTER (WHERE {test})"


def _last(value: str, test: str) -> str:
    return f"max_by({value}, frame_number) FILTER (WHERE {test})"


def dialogs(sip_messages: DataFrame, rules: CallRules = _RULES) -> DataFrame:
    """One row per Call-ID with all milestones: one shuffle after map-side combine.

    The first message decides between call (INVITE) and registration. Of the messages that can end
    the set-up only the first counts, so its frame and outcome are two more aggregates.
    """
    code = F.coalesce(
        F.col("status_code").cast("string"),
        F.when(optional(sip_messages, "cause", "string").rlike(r"^\d+$"), F.col("cause"))
        if "cause" in sip_messages.columns
        else F.lit(None).cast("string"),
    )
    decides = "msg_type = 'CANCEL' OR code = '200' OR left(code, 1) IN ('4', '5', '6')"
    if rules.ignore_challenges:
        decides = f"({decides}) AND coalesce(code, '') NOT IN ('401', '407')"
    text = {
        name: optional(sip_messages, name, "string")
        for name in ("reason", "refer_to", "referred_by", "event", "min_se", "src", "dst")
    }
    rows = (
        sip_messages.filter("call_id is not null")
        .withColumns({**text, "code": code})
        .withColumns(
            {
                "se": session_expires(optional(sip_messages, "session_expires", "string")),
                "min_se": F.expr("try_cast(min_se as int)"),
                "transfer": F.expr(
                    "CASE WHEN msg_type = 'REFER' THEN 'PENDING'"
                    " WHEN msg_type = 'NOTIFY' AND contains(lower(event), 'refer') THEN"
                    " CASE left(code, 1) WHEN '2' THEN 'COMPLETED' WHEN '4' THEN 'FAILED'"
                    " WHEN '5' THEN 'FAILED' END END"
                ),
                "outcome": F.expr(f"CASE WHEN {decides} THEN coalesce(code, 'CANCEL') END"),
                "answered": F.expr("coalesce(code, '') = '200'"),
            }
        )
    )
    notified = "msg_type = 'NOTIFY' AND contains(lower(event), 'refer')"
    return rows.groupBy(*KEY).agg(
        F.expr("min_by(msg_type, frame_number) AS first_type"),
        F.expr("min_by(ts_us, frame_number) AS start_us"),
        F.expr("max_by(ts_us, frame_number) AS end_us"),
        F.expr("count(1) AS msg_count"),
        F.expr(
            _first("msg_type", "msg_type NOT IN ('Response', 'Ack') AND code IS NULL")
            + " AS method"
        ),
        F.expr("min_by(src, frame_number) AS src_ip"),
        F.expr("min_by(dst, frame_number) AS dst_ip"),
        F.expr(_first("ts_us", "msg_type = 'INVITE'") + " AS invite_us"),
        F.expr(_first("ts_us", "code IN ('100', '180', '183')") + " AS first_provisional_us"),
        F.expr(_last("ts_us", "code = '180'") + " AS ringing_us"),
        F.expr(_last("ts_us", "code = '183'") + " AS session_progress_us"),
        F.expr(_first("ts_us", "code = '200'") + " AS ok_us"),
        F.expr(_last("ts_us", "msg_type = 'BYE'") + " AS bye_us"),
        F.expr(_last("ts_us", "msg_type = 'CANCEL'") + " AS cancel_us"),
        F.expr(_last("ts_us", "msg_type = 'REFER'") + " AS refer_us"),
        F.expr(_last("ts_us", "msg_type = 'UPDATE'") + " AS update_us"),
        F.expr("max(frame_number) FILTER (WHERE msg_type = 'UPDATE') AS update_frame"),
        F.expr("max(frame_number) FILTER (WHERE msg_type = 'BYE') AS last_bye_frame"),
        F.expr("max(frame_number) FILTER (WHERE msg_type = 'INVITE') AS last_invite_frame"),
        F.expr(
            _first("reason", "msg_type = 'BYE' AND reason IS NOT NULL") + " AS reason_header"
        ),
        F.expr("min(frame_number) FILTER (WHERE outcome IS NOT NULL) AS decided_frame"),
        F.expr(_first("outcome", "outcome IS NOT NULL") + " AS outcome"),
        F.expr(
            _last("outcome", "outcome IS NOT NULL AND outcome <> 'CANCEL'") + " AS last_outcome"
        ),
        F.expr(_last("se.seconds", "se.seconds IS NOT NULL") + " AS session_expires"),
        F.expr(_last("se.refresher", "se.refresher IS NOT NULL") + " AS refresher"),
        F.expr(_last("min_se", "min_se IS NOT NULL") + " AS min_se"),
        F.expr("coalesce(max(msg_type = 'REFER'), false) AS is_transfer"),
        F.expr(_last("refer_to", "msg_type = 'REFER'") + " AS refer_to"),
        F.expr(_last("referred_by", "msg_type = 'REFER'") + " AS referred_by"),
        F.expr(_last("transfer", "transfer IS NOT NULL") + " AS transfer_status"),
        F.expr(f"count_if({notified}) AS notify_count"),
    )


def _reinvites(sip_messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Time of the last INVITE between the answer and the first BYE after it, per call."""
    busy = calls.filter("outcome = '200' and last_invite_frame > decided_frame")
    later = (
        sip_messages.filter("msg_type in ('INVITE', 'BYE')")
        .select(*KEY, "frame_number", "ts_us", "msg_type")
        .join(busy.select(*KEY, "decided_frame"), KEY)
        .filter("frame_number > decided_frame")
    )
    ends = (
        later.filter("msg_type = 'BYE'").groupBy(*KEY).agg(F.min("frame_number").alias("_end"))
    )
    return (
        later.filter("msg_type = 'INVITE'")
        .join(ends, KEY, "left")
        .filter("_end is null or frame_number < _end")
        .groupBy(*KEY)
        .agg(
            F.max("frame_number").alias("reinvite_frame"),
            F.max_by("ts_us", "frame_number").alias("reinvite_us"),
        )
    )


def calls(
    sip_messages: DataFrame, dialog_table: DataFrame | None = None, rules: CallRules = _RULES
) -> DataFrame:
    """Calls with state, end reason, class, timing, KPIs, session timer and transfer."""
    found = dialog_table if dialog_table is not None else dialogs(sip_messages, rules)
    found = found.filter("first_type = 'INVITE'")
    grace, early = rules.session_grace_s, rules.early_drop_s
    steps = [
        {
            "refresh_us": "CASE WHEN coalesce(update_frame, -1) > coalesce(reinvite_frame, -1)"
            " THEN update_us ELSE reinvite_us END",
            "duration_sec": "greatest(end_us - start_us, 0) / 1e6D",
            "pdd_ms": "(coalesce(ringing_us, session_progress_us) - invite_us) / 1000",
            "setup_time_ms": "(ok_us - invite_us) / 1000",
            "alerting_time_ms": "(ok_us - ringing_us) / 1000",
            "state": "CASE WHEN outcome IS NULL OR outcome <> '200' THEN 'FAILED'"
            " WHEN last_bye_frame > decided_frame THEN 'TERMINATED' ELSE 'ESTABLISHED' END",
            "_talk": "CASE WHEN outcome = '200' THEN (bye_us - ok_us) / 1e6D END",
        },
        {
            "end_reason": "CASE WHEN outcome IS NULL THEN 'INVITE_SETUP_TIMEOUT'"
            " WHEN outcome = 'CANCEL' THEN 'CANCELLED'"
            " WHEN outcome <> '200' THEN concat('SIP_ERROR_', outcome)"
            f" WHEN _talk < {early} THEN 'DROP_IMMEDIATE_BYE'"
            " WHEN state = 'TERMINATED' THEN 'NORMAL_CLEARING' ELSE 'DROP_NO_BYE' END",
            "classification": "CASE WHEN outcome IS NULL THEN 'INVITE_TIMEOUT'"
            " WHEN outcome = 'CANCEL' THEN 'CANCELLED_BY_CALLER'"
            " WHEN outcome <> '200' THEN concat('REJECTED_', left(outcome, 1), 'XX')"
            f" WHEN _talk < {early} THEN 'EARLY_DROP'"
            " WHEN _talk IS NOT NULL OR state = 'TERMINATED' THEN 'ESTABLISHED'"
            " ELSE 'EARLY_DROP' END",
            "confidence": f"CASE WHEN outcome = '200' AND _talk < {early} THEN 'high'"
            " WHEN state = 'ESTABLISHED' THEN 'medium' END",
            "is_long_setup": f"setup_time_ms > {rules.long_setup_ms}",
            "call_duration_ms": "_talk * 1000",
            "session_expired": "coalesce(session_expires > 0 AND (end_us - coalesce(refresh_us,"
            f" ok_us)) / 1e6D > session_expires + {grace}, false)",
        },
        {
            "_timed_out": "session_expired AND end_reason = 'DROP_NO_BYE'",
            "_moved": "CASE WHEN is_transfer THEN transfer_status END",
        },
        {
            "end_reason": "CASE WHEN _moved = 'COMPLETED' THEN 'NORMAL_TRANSFER'"
            " WHEN _timed_out THEN 'DROP_SESSION_TIMEOUT' ELSE end_reason END",
            "classification": "CASE WHEN _moved = 'COMPLETED' THEN 'TRANSFER_COMPLETED'"
            " WHEN _moved = 'PENDING' THEN 'TRANSFER_INCOMPLETE'"
            " WHEN _timed_out THEN 'SESSION_TIMER_EXPIRED' ELSE classification END",
            "confidence": "IF(_timed_out, 'high', confidence)",
        },
    ]
    out = found.join(_reinvites(sip_messages, found), KEY, "left")
    for step in steps:
        out = out.withColumns({name: F.expr(text) for name, text in step.items()})
    return out.select(
        *KEY,
        "start_us",
        "end_us",
        "duration_sec",
        "state",
        F.expr("coalesce(method, 'UNKNOWN')").alias("method"),
        "end_reason",
        "classification",
        "confidence",
        "msg_count",
        "src_ip",
        "dst_ip",
        "reason_header",
        F.struct(
            "invite_us",
            "first_provisional_us",
            "ringing_us",
            "session_progress_us",
            "ok_us",
            "bye_us",
            "cancel_us",
            "refresh_us",
            "refer_us",
        ).alias("timing"),
        F.struct(
            "pdd_ms", "setup_time_ms", "alerting_time_ms", "is_long_setup", "call_duration_ms"
        ).alias("kpis"),
        F.struct("session_expires", "min_se", "refresher", "session_expired").alias(
            "session_timer"
        ),
        F.struct("is_transfer", "refer_to", "referred_by", "transfer_status", "notify_count").alias(
            "transfer"
        ),
    )


def registrations(
    sip_messages: DataFrame, dialog_table: DataFrame | None = None, rules: CallRules = _RULES
) -> DataFrame:
    """Dialogs that do not start with INVITE; the last final response decides."""
    found = dialog_table if dialog_table is not None else dialogs(sip_messages, rules)
    return found.filter("first_type <> 'INVITE'").selectExpr(
        *KEY,
        "start_us",
        "end_us",
        "greatest(end_us - start_us, 0) / 1e6D AS duration_sec",
        "coalesce(method, 'UNKNOWN') AS method",
        "CASE WHEN last_outcome = '200' THEN 'SUCCESS' ELSE 'FAILED' END AS state",
        "CASE WHEN last_outcome = '200' THEN 'COMPLETED'"
        " WHEN last_outcome IS NOT NULL THEN concat('SIP_ERROR_', last_outcome)"
        " WHEN method = 'REGISTER' THEN 'REGISTER_TIMEOUT' ELSE 'TRANSACTION_TIMEOUT' END"
        " AS end_reason",
        "CASE WHEN last_outcome = '200' THEN 'ESTABLISHED'"
        " WHEN last_outcome IS NOT NULL THEN concat('REJECTED_', left(last_outcome, 1), 'XX')"
        " ELSE 'INVITE_TIMEOUT' END AS classification",
        "msg_count",
        "src_ip",
        "dst_ip",
    )


def sip_kpis(call_table: DataFrame, registration_table: DataFrame) -> DataFrame:
    """Per capture: calls, mean post-dial delay and set-up time, long set-ups and trace type."""
    per_call = call_table.groupBy("capture_id").agg(
        F.expr("count(1) AS total_calls"),
        F.expr("sum(kpis.pdd_ms) / count(kpis.pdd_ms) AS avg_pdd_ms"),
        F.expr("sum(kpis.setup_time_ms) / count(kpis.setup_time_ms) AS avg_setup_time_ms"),
        F.expr("count_if(kpis.is_long_setup) AS long_setup_count"),
    )
    per_registration = registration_table.groupBy("capture_id").agg(
        F.expr("count(1) AS total_registrations")
    )
    out = per_call.join(per_registration, "capture_id", "full").fillna(
        0,
        [
            "total_calls",
            "avg_pdd_ms",
            "avg_setup_time_ms",
            "long_setup_count",
            "total_registrations",
        ],
    )
    kind = "IF(total_calls = 0, 'REGISTRATION_ONLY', 'CALLS_AND_REGISTRATIONS')"
    return out.withColumn("trace_type", F.expr(kind))


def classification_counts(call_table: DataFrame) -> DataFrame:
    """Calls per class."""
    return call_table.groupBy("capture_id", "classification").agg(F.expr("count(1) AS calls"))


def voice_statistics(
    call_table: DataFrame, registration_table: DataFrame, findings: DataFrame
) -> DataFrame:
    """Per capture: calls, registrations, dropped calls and media issues."""
    per_call = call_table.groupBy("capture_id").agg(
        F.expr("count(1) AS total_calls"),
        F.expr("count_if(contains(end_reason, 'DROP')) AS dropped"),
    )
    per_registration = registration_table.groupBy("capture_id").agg(
        F.expr("count(1) AS total_registrations")
    )
    issues = findings.groupBy("capture_id").agg(F.expr("count(1) AS media_issues"))
    out = per_call.join(per_registration, "capture_id", "full")
    out = out.join(issues, "capture_id", "full")
    return out.fillna(0, ["total_calls", "dropped", "total_registrations", "media_issues"])


def calls_with_session_timer(call_table: DataFrame) -> DataFrame:
    """Calls that negotiated a session timer."""
    return call_table.filter("session_timer.session_expires > 0")


def calls_with_transfer(call_table: DataFrame) -> DataFrame:
    """Calls that were transferred."""
    return call_table.filter("transfer.is_transfer")
