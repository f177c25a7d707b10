"""RAN events from dissected fields, UE timelines and the rules on them."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom import dims
from signalloom.config import RanRules
from signalloom.functions.causes import cause_label
from signalloom.operators.packets import optional
from signalloom.operators.transactions import epoch_us
from signalloom.plans.deal import deal

UE = ["capture_id", "ue_key"]
FINDING = [
    "capture_id",
    "type",
    "generation",
    "confidence",
    "confidence_pct",
    "severity",
    "description",
    "evidence",
    "start_us",
    "end_us",
    "ue_key",
]
_RULES = RanRules()
# Events, with their questions, of one task.
EVENTS_EACH = 100_000

# Protocol, its generation, the fields that show it, its procedure field and causes.
PACKS = [
    (
        "S1AP",
        "4G",
        ["s1ap_procedureCode", "s1ap_MME_UE_S1AP_ID", "s1ap_ENB_UE_S1AP_ID"],
        "s1ap_procedureCode",
        [
            "s1ap_Cause",
            "s1ap_cause_radioNetwork",
            "s1ap_cause_transport",
            "s1ap_cause_nas",
            "s1ap_cause_protocol",
            "s1ap_cause_misc",
        ],
    ),
    (
        "NGAP",
        "5G",
        ["ngap_procedureCode", "ngap_AMF_UE_NGAP_ID", "ngap_RAN_UE_NGAP_ID"],
        "ngap_procedureCode",
        [
            "ngap_Cause",
            "ngap_cause_radioNetwork",
            "ngap_cause_transport",
            "ngap_cause_nas",
            "ngap_cause_protocol",
            "ngap_cause_misc",
        ],
    ),
    ("X2AP", "4G", ["x2ap_procedureCode"], "x2ap_procedureCode", ["x2ap_Cause"]),
    ("XnAP", "5G", ["xnap_procedureCode"], "xnap_procedureCode", ["xnap_Cause"]),
    (
        "RANAP",
        "3G",
        ["ranap_procedureCode", "ranap_RAB_ID"],
        "ranap_procedureCode",
        ["ranap_Cause"],
    ),
    (
        "BSSAP",
        "2G",
        [
            "bssap_pdu_type",
            "bssap_msgtype",
            "gsm_a_dtap_msg_rr_type",
            "gsm_a_dtap_msg_mm_type",
            "gsm_a_dtap_msg_cc_type",
        ],
        None,
        ["bssap_cause"],
    ),
    ("SCTP", "Unknown", ["sctp_verification_tag", "sctp_chunk_type"], None, []),
    (
        "SCCP",
        "Unknown",
        ["sccp_message_type", "sccp_calling_ssn", "sccp_called_ssn", "sccp_release_cause"],
        None,
        [],
    ),
]


def procedure_label(protocol, code):
    """Name of a procedure code, with a text for codes or protocols without a name."""
    text = code.cast("string")
    unnamed = F.concat(F.lit("ProcedureCode_"), text)
    other = F.concat(protocol, F.lit("_Procedure_"), text)
    return F.when(
        code.isNotNull(),
        F.when(protocol == "S1AP", F.coalesce(dims.lookup(dims.S1AP_PROCEDURES, code), unnamed))
        .when(protocol == "NGAP", F.coalesce(dims.lookup(dims.NGAP_PROCEDURES, code), unnamed))
        .otherwise(other),
    )


def ran_events(fields: DataFrame) -> DataFrame:
    """One event per RAN protocol a row carries: a single scan, where a row with several protocols
    yields several events."""
    given = set(fields.columns)

    def have(names: list[str]) -> str:
        known = [n for n in names if n in given]
        return f"coalesce({', '.join(known)})" if known else "CAST(NULL AS STRING)"

    def event(protocol: str, generation: str, code: str | None, causes: list[str]) -> str:
        number = f"try_cast({have([code])} as int)" if code else "CAST(NULL AS INT)"
        return (
            f"named_struct('protocol', '{protocol}', 'generation', '{generation}',"
            f" 'procedure_code', {number}, 'cause_raw', {have(causes)})"
        )

    items = ", ".join(
        f"IF({have(shown + causes)} IS NOT NULL, {event(protocol, generation, code, causes)}, NULL)"
        for protocol, generation, shown, code, causes in PACKS
    )

    def f(name: str):
        return optional(fields, name, "string")

    rows = fields.withColumn("_e", F.expr(f"explode(array_compact(array({items})))"))
    rows = rows.select("*", "_e.*")
    raw = F.col("cause_raw")
    numeric = raw.rlike(r"^\d+$") & F.col("protocol").isin("S1AP", "NGAP")
    return rows.select(
        "capture_id",
        F.coalesce(f("frame_number").try_cast("bigint"), F.lit(0)).alias("frame_number"),
        F.coalesce(epoch_us(f("frame_time_epoch")), F.lit(0)).alias("ts_us"),
        "generation",
        "protocol",
        "procedure_code",
        procedure_label(F.col("protocol"), F.col("procedure_code")).alias("procedure_label"),
        "cause_raw",
        F.when(numeric, cause_label(F.col("protocol"), raw)).otherwise(raw).alias("cause_label"),
        f("s1ap_MME_UE_S1AP_ID").alias("mme_id"),
        f("s1ap_ENB_UE_S1AP_ID").alias("enb_id"),
        f("ngap_AMF_UE_NGAP_ID").alias("amf_id"),
        f("ngap_RAN_UE_NGAP_ID").alias("ran_id"),
        f("sccp_calling_ssn").alias("sccp_calling"),
        f("sccp_called_ssn").alias("sccp_called"),
        f("sctp_verification_tag").alias("sctp_assoc"),
        f("sctp_chunk_type").alias("chunk_type"),
        F.coalesce(f("sctp_retransmission").isNotNull(), F.lit(False)).alias("retransmission"),
        f("ip_src").alias("src"),
        f("ip_dst").alias("dst"),
    )


def coverage_flags(events: DataFrame) -> DataFrame:
    """Per capture: which generations and protocols occur."""
    generations = [
        F.max(F.col("generation") == g).alias(f"has_{g.lower()}") for g in ("2G", "3G", "4G", "5G")
    ]
    protocols = [F.max(F.col("protocol") == p[0]).alias(f"has_{p[0].lower()}") for p in PACKS]
    return events.groupBy("capture_id").agg(*generations, *protocols)


def with_ue_key(events: DataFrame) -> DataFrame:
    """Add ``ue_key``: application ids, else the SCCP pair, else the SCTP association, else the
    address pair. Events without any are dropped."""
    keyed = events.withColumn(
        "ue_key",
        F.expr(
            "CASE WHEN amf_id IS NOT NULL AND ran_id IS NOT NULL THEN"
            " concat('5g:amf=', amf_id, ':ran=', ran_id)"
            " WHEN mme_id IS NOT NULL AND enb_id IS NOT NULL THEN"
            " concat('4g:mme=', mme_id, ':enb=', enb_id)"
            " WHEN amf_id IS NOT NULL THEN concat('5g:amf=', amf_id)"
            " WHEN ran_id IS NOT NULL THEN concat('5g:ran=', ran_id)"
            " WHEN mme_id IS NOT NULL THEN concat('4g:mme=', mme_id)"
            " WHEN enb_id IS NOT NULL THEN concat('4g:enb=', enb_id)"
            " WHEN sccp_calling IS NOT NULL AND sccp_called IS NOT NULL THEN"
            " concat('sccp:', sccp_calling, '-', sccp_called)"
            " WHEN src IS NOT NULL AND dst IS NOT NULL THEN"
            " concat(IF(sctp_assoc IS NOT NULL, concat('sctp:', sctp_assoc, ':'), 'ip:'),"
            " least(src, dst), '-', greatest(src, dst)) END"
        ),
    )
    return keyed.filter("ue_key is not null")


def ue_timelines(events: DataFrame) -> DataFrame:
    """One row per UE: generation of its last event, protocols, span and event count."""
    spans = events.groupBy(*UE).agg(
        F.expr("max_by(generation, struct(ts_us, frame_number)) AS generation"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.expr("count(1) AS event_count"),
    )
    return spans.withColumn("duration", F.expr("(end_us - start_us) / 1e6D"))


def timeline_samples(events: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` events of each UE (rank limit before the shuffle)."""
    order = Window.partitionBy(*UE).orderBy("ts_us", "frame_number")
    return events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _conditions() -> dict[str, Column]:
    """Which events the rules look at."""
    label, cause = F.lower("procedure_label"), F.lower("cause_label")
    squeezed = F.expr("replace(replace(lower(procedure_label), ' ', ''), '_', '')")
    failed = dims.contains_any(label, ["failure", "cancel"]) | dims.contains_any(
        cause, dims.HANDOVER_CAUSE_WORDS
    )
    released = dims.contains_any(label, ["release"]) & dims.contains_any(
        cause, ["handover", "ho", "relocation"]
    )
    found = {
        "is_release": squeezed.contains("uecontextrelease"),
        "is_radio": dims.contains_any(cause, dims.RADIO_CAUSE_WORDS),
        "is_lost": dims.contains_any(cause, ["radio link failure", "rlf", "radio connection"]),
        "is_prepared": dims.contains_any(label, ["handover", "relocation", "pathswitch"])
        & dims.contains_any(label, ["preparation", "request", "required"]),
        "is_failure": failed,
        "is_bad": failed | released,
        "is_crowded": dims.contains_any(cause, dims.CONGESTION_CAUSE_WORDS),
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in found.items()}


def _cell(at: str, width: int) -> str:
    return f"(({at} - pmod({at}, {width}L)) div {width}L)"


def _dealt(events: DataFrame, rules: RanRules, kinds: set[str]) -> DataFrame:
    """Events and their questions, dealt by UE and block of time, with the generation of the UE's last event.

    ``role`` 0 is the event at its own time; 1 and 2 ask for failures from just after a handover preparation and up to
    the end of its window; 3 asks for the events up to the end of the congestion window, whose start the event itself
    marks. Both windows' cells nest in a block, so a UE that holds much of the trace is cut along time. The
    generation comes from one row per UE and block, told to each block of the UE.
    """
    block = lcm(rules.handover_window_us, rules.congestion_window_us)
    latest = F.max(F.struct("ts_us", "frame_number", "generation"))
    blocks = events.groupBy(*UE, F.expr(f"{_cell('ts_us', block)} AS block")).agg(latest.alias("_last"))
    told = blocks.select(*UE, "block", F.max("_last").over(Window.partitionBy(*UE))["generation"].alias("told"))
    roles = ["IF(wanted, named_struct('role', 0, 'at', ts_us), NULL)"]
    wanted = {"UE_CONTEXT_RELEASE": "is_release", "RADIO_LINK_FAILURE": "is_lost", "HANDOVER_FAILURE": "is_bad OR is_prepared"}
    if "HANDOVER_FAILURE" in kinds:
        ends = (1, 1), (2, rules.handover_window_us)
        roles += [f"IF(is_prepared, named_struct('role', {r}, 'at', ts_us + {d}L), NULL)" for r, d in ends]
    if "SIGNALING_CONGESTION" in kinds:
        roles.append(f"named_struct('role', 3, 'at', ts_us + {rules.congestion_window_us}L)")
    own = "true" if "SIGNALING_CONGESTION" in kinds else " OR ".join(wanted[k] for k in sorted(kinds))
    rows = events.select(*UE, "ts_us", "frame_number", "procedure_label", "cause_label", *[c.alias(n) for n, c in _conditions().items()])
    rows = rows.withColumn("wanted", F.expr(own)).withColumn("_r", F.expr(f"explode(array_compact(array({', '.join(roles)})))"))
    rows = rows.drop("wanted").select("*", "_r.role", "_r.at").drop("_r").withColumn("block", F.expr(_cell("at", block)))
    rows = rows.unionByName(told, allowMissingColumns=True)
    rows = deal(rows, [F.col(c) for c in (*UE, "block")], events.count(), EVENTS_EACH)
    whole = Window.partitionBy(*UE, "block")
    return rows.withColumn("generation", F.max("told").over(whole)).filter("role is not null").drop("told")


def _answered(rows: DataFrame, rules: RanRules, kinds: set[str]) -> DataFrame:
    """Dealt rows with what their windows hold on their side."""
    if "HANDOVER_FAILURE" in kinds:
        hit = F.struct(F.col("at").alias("ts_us"), "frame_number", "procedure_label", "cause_label", "is_failure")
        cells = Window.partitionBy(*UE, "block", F.expr(_cell("at", rules.handover_window_us)))
        hits = F.min(F.when((F.col("role") == 0) & F.col("is_bad"), hit))
        sides = {1: hits.over(cells.orderBy(F.col("at").desc())), 2: hits.over(cells.orderBy(F.col("at").asc()))}
        rows = rows.withColumn("_hit", F.when(F.col("role") == 1, sides[1]).when(F.col("role") == 2, sides[2]))
    if "SIGNALING_CONGESTION" in kinds:
        cells = Window.partitionBy(*UE, "block", F.expr(_cell("at", rules.congestion_window_us)))
        event = F.col("role") == 0
        place = F.when(event, F.struct(F.col("at").alias("ts_us"), "frame_number"))
        counts = [F.count(F.when(event, 1)), F.max(event & F.col("is_crowded")), F.min(place), F.max(place)]
        for name, order in (("_on", F.col("at").desc()), ("_up", F.col("at").asc())):
            side = F.struct(*[c.over(cells.orderBy(order)).alias(n) for c, n in zip(counts, ("n", "crowded", "first", "last"), strict=True)])
            rows = rows.withColumn(name, F.when(F.col("role") == (0 if name == "_on" else 3), side))
    return rows


def _ue_findings(events: DataFrame, rules: RanRules, kinds: set[str]) -> DataFrame:
    """Findings of the wanted kinds per UE, from one pass over its blocks of time."""
    rows = _answered(_dealt(events, rules, kinds), rules, kinds)
    for name, kind in (("_hit", "struct<ts_us:bigint,frame_number:bigint,procedure_label:string,cause_label:string,is_failure:boolean>"), *((n, _SIDE) for n in ("_on", "_up"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    tests = {
        "UE_CONTEXT_RELEASE": "role = 0 AND is_release",
        "RADIO_LINK_FAILURE": "role = 0 AND is_lost",
        "HANDOVER_FAILURE": "is_prepared AND role < 3",
        "SIGNALING_CONGESTION": "role IN (0, 3) AND ts_us IS NOT NULL",
    }
    named = ", ".join(f"IF({tests[k]}, '{k}', NULL)" for k in sorted(kinds))
    rows = rows.withColumn("type", F.expr(f"explode(array_compact(array({named})))"))
    # both sides of each window meet; a crowded instant counts once, however many events it has
    frame = "IF(type = 'SIGNALING_CONGESTION', NULL, frame_number)"
    met = rows.groupBy(*UE, "type", "ts_us", F.expr(f"{frame} AS frame_number")).agg(
        F.max("generation").alias("generation"),
        F.expr("max(procedure_label) AS procedure_label"),
        F.expr("max(cause_label) AS cause_label"),
        F.expr("max(is_radio) AS is_radio"),
        F.min("_hit").alias("_hit"),
        F.max("_on").alias("_on"),
        F.max("_up").alias("_up"),
    )
    met = met.withColumn("_n", F.expr("_on.n + coalesce(_up.n, 0)")).filter(
        "CASE type WHEN 'HANDOVER_FAILURE' THEN _hit IS NOT NULL WHEN 'UE_CONTEXT_RELEASE' THEN generation IN ('4G', '5G')"
        f" WHEN 'SIGNALING_CONGESTION' THEN _n >= {rules.congestion_events} ELSE true END"
    )
    if "SIGNALING_CONGESTION" in kinds:  # the first crowded instant of each UE
        fields = ["ts_us", "frame_number", *[c for c in met.columns if c not in {*UE, "type", "ts_us", "frame_number"}]]
        single = "IF(type = 'SIGNALING_CONGESTION', NULL, {})"
        keys = [F.expr(f"{single.format(c)} AS _{c}") for c in ("ts_us", "frame_number")]
        met = met.groupBy(*UE, "type", *keys).agg(F.min(F.struct(*fields)).alias("_m")).select(*UE, "type", "_m.*")
    seconds = "format_string('%.3f', {} / 1e6D)"
    last = "greatest(_on.last, _up.last)"
    forms = {
        "UE_CONTEXT_RELEASE": (
            "IF(is_radio, 'HIGH', 'MEDIUM')",
            "IF(is_radio, 90, 70)",
            "IF(is_radio, 'warning', 'info')",
            "concat('Context released', IF(is_radio, ' for a radio cause: ', ': '), coalesce(cause_label, 'none given'))",
            "array(concat('Frame ', frame_number, ': ', procedure_label, ' - ', coalesce(cause_label, 'None')))",
            "ts_us",
        ),
        "HANDOVER_FAILURE": (
            "IF(_hit.is_failure, 'HIGH', 'MEDIUM')",
            "IF(_hit.is_failure, 90, 70)",
            "IF(_hit.is_failure, 'critical', 'warning')",
            "IF(_hit.is_failure, concat('Handover failure detected: ', coalesce(_hit.procedure_label, 'None')),"
            " concat('Possible handover failure (release after prep): ', coalesce(_hit.cause_label, 'None')))",
            f"IF(_hit.is_failure, array(concat('Frame ', frame_number, ': HO Preparation at ', {seconds.format('ts_us')}),"
            f" concat('Frame ', _hit.frame_number, ': Failure at ', {seconds.format('_hit.ts_us')}, ' - ',"
            " coalesce(_hit.cause_label, 'None'))), array(concat('Frame ', frame_number, ': HO Preparation'),"
            " concat('Frame ', _hit.frame_number, ': UE Release with HO-related cause')))",
            "_hit.ts_us",
        ),
        "RADIO_LINK_FAILURE": (
            "'HIGH'",
            "95",
            "'critical'",
            "concat('Radio link lost: ', cause_label)",
            "array(concat('Frame ', frame_number, ': ', coalesce(procedure_label, 'None'), ' - ', cause_label))",
            "ts_us",
        ),
        "SIGNALING_CONGESTION": (
            "IF(_on.crowded OR coalesce(_up.crowded, false), 'HIGH', 'MEDIUM')",
            "IF(_on.crowded OR coalesce(_up.crowded, false), 85, 65)",
            "'warning'",
            f"concat('Signaling congestion: ', _n, ' events in {rules.congestion_window_us / 1e6}s window')",
            f"array(concat('Frames ', _on.first.frame_number, ' to ', {last}.frame_number))",
            f"{last}.ts_us",
        ),
    }
    names = ["confidence", "confidence_pct", "severity", "description", "evidence", "end_us"]
    cases = [
        f"CASE type {' '.join(f'WHEN {k!r} THEN {forms[k][i]}' for k in sorted(kinds))} END AS {name}" for i, name in enumerate(names)
    ]
    return met.selectExpr(*UE, "type", "generation", *cases, "ts_us AS start_us").select(*FINDING)


_SIDE = (
    "struct<n:bigint,crowded:boolean,first:struct<ts_us:bigint,frame_number:bigint>,last:struct<ts_us:bigint,frame_number:bigint>>"
)


def context_releases(events: DataFrame) -> DataFrame:
    """UE context releases of 4G and 5G UEs; a radio-related cause raises the confidence."""
    return _ue_findings(events, _RULES, {"UE_CONTEXT_RELEASE"})


def handover_failures(events: DataFrame, rules: RanRules = _RULES) -> DataFrame:
    """Handover preparations followed within the window by a failure, a cancel, a handover-related
    cause or a release with one. The first such event of the UE counts."""
    return _ue_findings(events, rules, {"HANDOVER_FAILURE"})


def radio_link_failures(events: DataFrame) -> DataFrame:
    """Events whose cause names a radio link failure."""
    return _ue_findings(events, _RULES, {"RADIO_LINK_FAILURE"})


def signalling_congestion(events: DataFrame, rules: RanRules = _RULES) -> DataFrame:
    """The first event of each UE with enough events in the window that starts with it."""
    return _ue_findings(events, rules, {"SIGNALING_CONGESTION"})


def _capture_findings(events: DataFrame, rules: RanRules, kinds: dict[str, str], n: int = 5) -> DataFrame:
    """Findings over whole captures, with the first ``n`` frames as evidence. ``kinds`` maps names to conditions."""
    named = ", ".join(f"IF({test}, '{kind}', NULL)" for kind, test in kinds.items())
    rows = events.select("capture_id", "ts_us", "frame_number", F.expr(f"explode(array_compact(array({named}))) AS _kind"))
    key = ["capture_id", "_kind"]
    order = Window.partitionBy(*key).orderBy("ts_us", "frame_number")
    head = (
        rows.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= n)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("_r", "frame_number"))).alias("_f"))
    )
    spans = rows.groupBy(*key).agg(
        F.expr("count(1) AS _n"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us")
    )
    forms = {
        "abort": ("TRANSPORT_INSTABILITY", "Transport", "HIGH", 90, "critical", "concat('SCTP ABORT detected (', _n, ' events)')", "transport_global", "true"),
        "resent": (
            "TRANSPORT_INSTABILITY", "Transport", "MEDIUM", 70, "warning", "concat('High SCTP retransmission rate (', _n, ' retrans)')",
            "transport_global", f"_n > {rules.retransmissions}",
        ),
        "paging": (
            "PAGING_FAILURE", "Mixed", "LOW", 40, "info",
            "concat('High paging activity (', _n, ' paging events) - may indicate UE reachability issues')", "paging_global", f"_n > {rules.paging_events}",
        ),
    }
    rows = ", ".join(
        f"IF(_kind = '{k}' AND {test}, named_struct('type', '{kind}', 'generation', '{of}', 'confidence', '{level}', 'confidence_pct', {pct},"
        f" 'severity', '{severity}', 'description', {text}, 'ue_key', '{ue}'), NULL)"
        for k, (kind, of, level, pct, severity, text, ue, test) in forms.items()
        if k in kinds
    )
    found = spans.join(head, key).withColumn("evidence", F.expr("transform(_f, x -> concat('Frame ', x.frame_number))"))
    found = found.withColumn("_x", F.expr(f"explode(array_compact(array({rows})))"))
    return found.select("capture_id", "_x.*", "evidence", "start_us", "end_us").select(*FINDING)


_TRANSPORT = {"abort": "protocol = 'SCTP' AND chunk_type = '6'", "resent": "protocol = 'SCTP' AND retransmission"}
_PAGING = {"paging": "contains(lower(procedure_label), 'paging')"}


def transport_instability(events: DataFrame, rules: RanRules = _RULES) -> DataFrame:
    """SCTP aborts (chunk type 6) and many SCTP retransmissions per capture."""
    return _capture_findings(events, rules, _TRANSPORT)


def paging_activity(events: DataFrame, rules: RanRules = _RULES) -> DataFrame:
    """Captures with many paging events."""
    return _capture_findings(events, rules, _PAGING)


def ran_findings(events: DataFrame, rules: RanRules = _RULES) -> DataFrame:
    """All RAN findings over events that carry a ``ue_key``: one pass per UE, one per capture."""
    kinds = {"UE_CONTEXT_RELEASE", "HANDOVER_FAILURE", "RADIO_LINK_FAILURE", "SIGNALING_CONGESTION"}
    per_ue = _ue_findings(events, rules, kinds)
    return per_ue.unionByName(_capture_findings(events, rules, {**_TRANSPORT, **_PAGING}))
