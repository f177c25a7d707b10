"""Correlation of signalling and radio events of a trace by identity and time.

``signals`` carries trace_id, event_no (unique per trace, order of precedence), ts_us, type, imsi,
guti, tmsi, ue_ip, cell_id and optionally src, dst, severity, procedure_label, cause_label.
``radio`` is the table of :mod:`signalloom.operators.radio`.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.config import CorrelationRules
from signalloom.functions.causes import confidence_level
from signalloom.operators.packets import optional
from signalloom.plans.deal import deal

KEY = ["trace_id"]
_RULES = CorrelationRules()
_VALUE = ["trace_id", "kind", "value"]
# Identities of either plane that one task looks at.
IDENTITIES_EACH = 200_000


def entity_time(*candidates: Column) -> Column:
    """First of several time columns (epoch seconds as number or text) that can be read, in µs."""
    seconds = F.coalesce(*[c.cast("string").try_cast("double") for c in candidates])
    return F.round(seconds * 1e6).cast("bigint")


def entity_id(*candidates: Column) -> Column:
    """First identifier that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in candidates])


def _identities(rules: CorrelationRules, with_time: bool) -> str:
    items = [
        f"IF({kind.lower()} IS NOT NULL, named_struct('kind', '{kind}', 'value', {kind.lower()}),"
        " NULL)"
        for kind in rules.identity
    ]
    if with_time:
        items.append("IF(ts_us IS NOT NULL, named_struct('kind', 'TIME', 'value', ''), NULL)")
    return f"explode(array_compact(array({', '.join(items)})))"


def find_correlations(
    signals: DataFrame, radio: DataFrame, rules: CorrelationRules = _RULES
) -> DataFrame:
    """The best signalling event of each radio event, lowest ``event_no`` first among equals.

    The confidence of a pair depends only on its strongest common identity and its time band. So per
    identity value (and for time alone, as one more value) the lowest event within each band, and the
    lowest at all, is looked up; no pairs are formed. Of a radio event's answers the most certain wins.
    """
    ids = [kind.lower() for kind in rules.identity]
    event = F.struct(
        "event_no",
        F.col("ts_us").alias("ts"),
        F.col("type").alias("signal_type"),
        optional(signals, "src", "string").alias("src"),
        optional(signals, "dst", "string").alias("dst"),
        *ids,
    )
    events = signals.select(
        "trace_id", "ts_us", event.alias("event"), F.expr(_identities(rules, True)).alias("_i")
    ).select("trace_id", "ts_us", "event", "_i.*")
    asked = radio.select(
        "trace_id", "row_no", "ts_us", F.expr(_identities(rules, True)).alias("_i")
    ).select("trace_id", "row_no", "ts_us", "_i.*")
    base = " ".join(f"WHEN '{kind}' THEN {pct}" for kind, pct in rules.identity.items())
    score = (
        "CASE WHEN kind = 'TIME' THEN CASE band WHEN 0 THEN 60 WHEN 1 THEN 45 WHEN 2 THEN 30 END"
        f" ELSE CASE band WHEN 0 THEN least(CASE kind {base} END + 10, 99)"
        f" WHEN 1 THEN least(CASE kind {base} END + 5, 95) ELSE CASE kind {base} END END END"
    )
    answers = _lowest_events(events, asked, rules).withColumn("confidence_pct", F.expr(score))
    best = (
        answers.filter(F.col("confidence_pct") >= rules.min_confidence)
        .groupBy("trace_id", "row_no")
        .agg(F.min(F.struct((-F.col("confidence_pct")).alias("c"), "event")).alias("_b"))
        .select("trace_id", "row_no", (-F.col("_b.c")).alias("confidence_pct"), "_b.event")
    )
    return _described(best, radio, rules)


def _lowest_events(events: DataFrame, asked: DataFrame, rules: CorrelationRules) -> DataFrame:
    """trace_id, row_no, kind, band, event: per asked row, identity and band (0 to 2: strong to weak, the
    latter for time alone; 3: at any time) the lowest event on either side of the asked instant.

    A band of width ``2w`` covers the end of one cell of that width and the start of the next, so running minima
    from both sides of each cell answer it. Cells of all bands nest in blocks of their common multiple: rows are
    dealt once, by identity and block, so that a busy cell or the time of a whole trace is cut along time. The
    lowest event at any time is found per identity first and sent to each block that asks for it.
    """
    widths = [2 * w for w in (rules.strong_us, rules.medium_us, rules.weak_us)]
    size = lcm(*widths)

    def cell(at: str, width: int) -> str:
        return f"(({at} - pmod({at}, {width}L)) div {width}L)"

    timed = events.filter("ts_us is not null").selectExpr(
        *_VALUE, f"{cell('ts_us', size)} AS block", "IF(kind = 'TIME', array(0, 1, 2), array(0, 1)) AS bands", "ts_us AS at", "event"
    )
    sides = [
        f"IF(ts_us IS NOT NULL{only}, named_struct('band', {i}, 'onward', {onward}, 'at', ts_us {sign} {w // 2}L), NULL)"
        for i, (w, only) in enumerate(zip(widths, ("", "", " AND kind = 'TIME'"), strict=True))
        for onward, sign in (("true", "-"), ("false", "+"))
    ]
    last = f"{(1 << 63) - 1}L"
    sides.append(f"IF(kind <> 'TIME', named_struct('band', 3, 'onward', false, 'at', {last}), NULL)")
    asks = asked.withColumn("_a", F.expr(f"explode(array_compact(array({', '.join(sides)})))"))
    # rows without time are spread over some blocks of their own
    block = f"CASE WHEN _a.band < 3 THEN {cell('_a.at', size)} WHEN ts_us IS NULL THEN -1 - pmod(xxhash64(row_no), 64) ELSE {cell('ts_us', size)} END"
    asks = asks.selectExpr(
        *_VALUE, f"{block} AS block", "array(_a.band) AS bands", "_a.at AS at", "row_no", "_a.onward AS onward"
    )
    ever = events.filter("kind <> 'TIME'").groupBy(*_VALUE).agg(F.min("event").alias("event"))
    told = asks.filter("bands[0] = 3").select(*_VALUE, "block").distinct().join(ever, _VALUE)
    told = told.selectExpr(*_VALUE, "block", "array(3) AS bands", "-1L AS at", "event")

    rows = timed.unionByName(told).unionByName(asks, allowMissingColumns=True)
    rows = deal(rows, [F.col(c) for c in (*_VALUE, "block")], events.count() + asked.count(), IDENTITIES_EACH)
    rows = rows.withColumn("band", F.explode("bands")).drop("bands")
    inner = " ".join(f"WHEN {i} THEN {cell('at', w)}" for i, w in enumerate(widths))
    rows = rows.withColumn("cell", F.expr(f"CASE band {inner} END"))
    group = Window.partitionBy(*_VALUE, "block", "band", "cell")
    upto = F.min("event").over(group.orderBy(F.col("at").asc()))
    onward = F.min("event").over(group.orderBy(F.col("at").desc()))
    found = rows.select("trace_id", "kind", "band", "row_no", F.when(F.col("onward"), onward).otherwise(upto).alias("event"))
    return found.filter("row_no is not null and event is not null")


def _described(best: DataFrame, radio: DataFrame, rules: CorrelationRules) -> DataFrame:
    ids = [kind.lower() for kind in rules.identity]
    right = radio.select(
        "trace_id",
        "row_no",
        "ts_us",
        "event_type",
        optional(radio, "event_label", "string").alias("event_label"),
        optional(radio, "generation", "string").alias("generation"),
        *ids,
    )
    keys = ", ".join(
        f"IF({i} = event.{i}, named_struct('key', '{i.upper()}', 'value', {i}), NULL)" for i in ids
    )
    out = best.join(right, ["trace_id", "row_no"]).withColumns(
        {
            "matched_keys": F.expr(f"array_compact(array({keys}))"),
            "delta_us": F.expr("abs(ts_us - event.ts)"),
            "confidence_level": confidence_level(F.col("confidence_pct")),
        }
    )
    return out.select(
        "trace_id",
        "row_no",
        "event.event_no",
        F.expr("coalesce(get(matched_keys, 0).key, 'TIME_PROXIMITY')").alias("match_type"),
        "matched_keys",
        "confidence_pct",
        "confidence_level",
        "delta_us",
        F.expr(
            f"CASE WHEN delta_us <= {rules.strong_us} THEN 'strong'"
            f" WHEN delta_us <= {rules.medium_us} THEN 'medium'"
            f" WHEN delta_us <= {rules.weak_us} THEN 'weak' ELSE 'none' END"
        ).alias("time_quality"),
        "event.signal_type",
        "event.src",
        "event.dst",
        "event_type",
        "event_label",
        "generation",
        "cell_id",
    )


def top_correlations(correlations: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most certain correlations per trace."""
    best = Window.partitionBy(*KEY).orderBy(F.desc("confidence_pct"), "row_no")
    ranked = correlations.withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= n)


def matched_identifiers(correlations: DataFrame) -> DataFrame:
    """Distinct matched identifiers per trace and kind."""
    keys = correlations.select(*KEY, F.explode("matched_keys").alias("_k"))
    return keys.select(*KEY, "_k.key", "_k.value").distinct()


def time_alignment(signals: DataFrame, radio: DataFrame) -> DataFrame:
    """How the time ranges of both planes of a trace relate, and their overlap in seconds."""
    left = signals.groupBy(*KEY).agg(
        F.expr("count(1) AS signal_events"),
        F.expr("min(ts_us) AS _s0"),
        F.expr("max(ts_us) AS _s1"),
    )
    right = radio.groupBy(*KEY).agg(
        F.expr("count(1) AS radio_events"),
        F.expr("min(ts_us) AS _r0"),
        F.expr("max(ts_us) AS _r1"),
    )
    both = left.join(right, KEY, "full").fillna(0, ["signal_events", "radio_events"])
    both = both.withColumn(
        "overlap_seconds",
        F.expr("coalesce(greatest(least(_s1, _r1) - greatest(_s0, _r0), 0), 0) / 1e6D"),
    )
    return both.selectExpr(
        *KEY,
        "signal_events",
        "radio_events",
        "overlap_seconds",
        "CASE WHEN _s0 IS NULL OR _r0 IS NULL THEN 'UNKNOWN'"
        " WHEN overlap_seconds > 0 THEN 'OVERLAPPING'"
        " WHEN abs(_s0 - _r0) < 3600000000 THEN 'CLOSE' ELSE 'DISJOINT' END AS time_alignment",
        "CASE WHEN radio_events = 0 THEN 'PCAP_ONLY' WHEN signal_events = 0 THEN"
        " 'RADIO_ONLY' ELSE 'CORRELATED' END AS status",
    )


def correlation_report(signals: DataFrame, radio: DataFrame, correlations: DataFrame) -> DataFrame:
    """Per trace: match counts by confidence next to the time alignment."""
    counts = correlations.groupBy(*KEY).agg(
        F.expr("count(1) AS total_correlations"),
        F.expr("count_if(confidence_pct >= 80) AS high_confidence_matches"),
        F.expr("count_if(confidence_pct BETWEEN 50 AND 79) AS medium_confidence_matches"),
        F.expr("count_if(confidence_pct < 50) AS low_confidence_matches"),
    )
    names = [c for c in counts.columns if c not in KEY]
    return time_alignment(signals, radio).join(counts, KEY, "left").fillna(0, names)


def incidents(correlations: DataFrame) -> DataFrame:
    """Radio failures within 5 s, and paging within 10 s, of the matched event."""
    seconds = "format_string('%.1f', delta_us / 1e6D)"
    tests = [
        ("RLF", 5, "RLF_NEAR_CALL_EVENT", "Radio Link Failure", "critical"),
        ("HO_FAIL", 5, "HO_FAIL_NEAR_CALL", "Handover Failure", "critical"),
        ("PAGING", 10, "PAGING_NEAR_CALL", "Paging event", "warning"),
    ]
    cases = " ".join(
        f"WHEN upper(event_type) = '{kind}' AND delta_us <= {limit * 1_000_000} THEN"
        f" named_struct('type', '{name}', 'description', concat('{text} within ', {seconds},"
        f" 's of ', upper(coalesce(signal_type, ''))), 'severity', '{severity}')"
        for kind, limit, name, text, severity in tests
    )
    hits = correlations.withColumn("_i", F.expr(f"CASE {cases} END")).filter("_i is not null")
    return hits.select(*KEY, "row_no", "_i.*", F.col("confidence_pct").alias("confidence"))


def key_incidents(found: DataFrame, n: int = 20) -> DataFrame:
    """View of the ``n`` most certain incidents per trace. Spark cuts ranks before the shuffle up to 1,000."""
    best = Window.partitionBy(*KEY).orderBy(F.desc("confidence"), "row_no")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def cross_plane_timeline(signals: DataFrame | None, radio: DataFrame | None) -> DataFrame:
    """Signalling and radio events in one table; either side may be missing."""
    parts = []
    if signals is not None:
        kind = optional(signals, "protocol", "string")
        procedure = optional(signals, "procedure_label", "string")
        cause = optional(signals, "cause_label", "string")
        text = F.concat_ws(" - ", *[F.nullif(c, F.lit("")) for c in (kind, procedure, cause)])
        parts.append(
            signals.filter("ts_us is not null").select(
                *KEY,
                "ts_us",
                F.lit("PCAP").alias("source"),
                F.col("event_no").alias("seq"),
                F.coalesce(kind, optional(signals, "type", "string"), procedure, F.lit("unknown"))
                .alias("event_type"),
                F.coalesce(F.nullif(text, F.lit("")), F.lit("PCAP event")).alias("description"),
                F.coalesce(optional(signals, "severity", "string"), F.lit("info")).alias(
                    "severity"
                ),
            )
        )
    if radio is not None:
        label = F.nullif(optional(radio, "event_label", "string"), F.lit(""))
        parts.append(
            radio.filter("ts_us is not null").select(
                *KEY,
                "ts_us",
                F.lit("RADIO").alias("source"),
                F.col("row_no").alias("seq"),
                "event_type",
                F.coalesce(label, F.col("event_type")).alias("description"),
                radio_severity(F.col("event_type")).alias("severity"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def radio_severity(event_type: Column) -> Column:
    """Severity of a radio event type."""
    kind = F.upper(event_type)
    return (
        F.when(kind.isin("RLF", "HO_FAIL", "PAGING"), "critical")
        .when(kind.isin("HO_ATTEMPT", "RRC_REESTABLISHMENT", "CSFB", "SRVCC"), "warning")
        .otherwise("info")
    )


def by_time(timeline: DataFrame) -> DataFrame:
    """Timeline in time order."""
    return timeline.orderBy("ts_us", "trace_id", "source", "seq")
