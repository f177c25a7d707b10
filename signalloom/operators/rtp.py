"""RTP stream quality per call: jitter, loss, reordering, MOS, and the rules on them.

``rtp_packets`` carries capture_id, frame_number, ts_us, ssrc, seq, rtp_ts and, unless call_id is
already known, dst_ip and dst_port.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.config import CHUNK_FRAMES, MediaRules, RtpRules
from signalloom.functions.quality import estimate_mos, mos_rating
from signalloom.operators.media import media_spans
from signalloom.plans.ordered import with_neighbours
from signalloom.plans.spans import overlap_join

CALL = ["capture_id", "call_id"]
STREAM = [*CALL, "ssrc"]
ENDPOINT = ["capture_id", "dst_ip", "dst_port"]
_RULES = RtpRules()
_TIMES = MediaRules()


def extended_sequence(
    rtp_packets: DataFrame, keys: list[str] = STREAM, span: int = CHUNK_FRAMES, one_wrap: bool = False
) -> DataFrame:
    """Packets with ``_p`` (the one before in arrival order), ``_ext``, the sequence number without wraps, and ``_turn``,
    the wraps since the packet before.

    A step of more than half the 16-bit range is a wrap, forwards or (a late packet) back. Wraps are summed inside
    chunks of the frame number and then over chunks, of which a stream has one row each. With ``one_wrap`` a stream is
    judged as a whole: if its numbers span more than half the range, its low ones come after its high ones.
    """
    before = F.struct("ts_us", "rtp_ts", "seq")
    turn = "CASE WHEN {0} - {1} < -32768 THEN 1L WHEN {0} - {1} > 32768 THEN -1L ELSE 0L END"
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_order")
    across = Window.partitionBy(*keys).orderBy("_chunk")
    rows = rtp_packets.withColumn("_order", F.col("frame_number").cast("bigint"))
    rows = rows.withColumn("_chunk", F.expr(f"_order div {span}L"))
    steps = rows.withColumn("_p", F.lag(before).over(inside)).withColumn("_turn", F.expr(turn.format("seq", "_p.seq")))
    # the first row of a chunk follows the last one of the chunk before
    chunks = steps.groupBy(*keys, "_chunk").agg(
        F.min_by("seq", "_order").alias("_first"), F.max_by(before, "_order").alias("_last"), F.sum("_turn").alias("_sum")
    )
    chunks = chunks.withColumn("_ahead", F.lag("_last").over(across))
    chunks = chunks.withColumn("_step", F.expr(turn.format("_first", "_ahead.seq")))
    chunks = chunks.withColumn("_before", F.sum(F.col("_sum") + F.col("_step")).over(across) - F.col("_sum"))
    counted = steps.withColumn("_inside", F.sum("_turn").over(inside))
    joined = counted.join(chunks.drop("_first", "_last", "_sum"), [*keys, "_chunk"])
    joined = joined.withColumns(
        {"_turn": F.expr("IF(_p IS NULL, _step, _turn)"), "_p": F.expr("coalesce(_p, _ahead)")}
    )
    ext = joined.withColumn("_ext", F.expr("seq + 65536L * (_before + _inside)"))
    ext = ext.drop("_chunk", "_before", "_inside", "_ahead", "_step")
    if not one_wrap:
        return ext
    ranges = rtp_packets.groupBy(*keys).agg(F.expr("max(seq) - min(seq) > 32768 AS _wrapped"))
    late = "IF(_wrapped AND {0} < 32768, 1L, 0L)"
    once = ext.join(ranges, keys).withColumns(
        {
            "_ext": F.expr(f"seq + 65536L * {late.format('seq')}"),
            "_turn": F.expr(f"{late.format('seq')} - {late.format('_p.seq')}"),
        }
    )
    return once.drop("_wrapped")


def rtp_streams(
    rtp_packets: DataFrame,
    rules: RtpRules = _RULES,
    strict: bool = False,
    span: int = CHUNK_FRAMES,
    keys: list[str] = STREAM,
) -> DataFrame:
    """Metrics per stream (call and SSRC, or other ``keys``), however often its sequence number wraps, or with
    ``rules.one_wrap`` as if it wrapped once at most.

    Jitter and reordering follow arrival order (the order of the sequence if ``strict``). Packets are first reduced
    to one row per sequence number, which tells lost and repeated ones.
    """
    rows = extended_sequence(rtp_packets, keys, span, rules.one_wrap)
    if strict:
        rows = rows.withColumn("_order", F.expr("shiftleft(_ext, 31) + frame_number % 2147483648L"))
        before = F.struct("ts_us", "rtp_ts", "seq")
        rows = with_neighbours(rows.drop("_p"), keys, "_order", {"_p": ("lag", before)}, 1 << 41)
    moved = f"abs((ts_us - _p.ts_us) - (rtp_ts - _p.rtp_ts) * 1000000D / {rules.clock_rate})"
    late = "0L" if strict else "count_if(seq + 65536L * _turn < _p.seq)"
    cells = rows.groupBy(*keys, "_ext").agg(
        F.expr("count(1) AS _n"),
        F.expr(f"sum({moved}) FILTER (WHERE rtp_ts > _p.rtp_ts) AS _moved"),
        F.expr("count_if(rtp_ts > _p.rtp_ts) AS _moves"),
        F.expr(f"{late} AS _late"),
    )
    sums = cells.groupBy(*keys).agg(
        F.expr("sum(_n) AS packet_count"),
        F.expr("count(1) AS _unique"),
        F.expr("max(_ext) - min(_ext) + 1 AS _spread"),
        F.expr("sum(_moved) AS _moved"),
        F.expr("sum(_moves) AS _moves"),
        F.expr("sum(_late) AS out_of_order"),
    )
    out = sums.selectExpr(
        *keys,
        "packet_count",
        "coalesce(_moved / nullif(_moves, 0) / 1000, 0D) AS jitter_ms",
        "(_spread - _unique) * 100D / _spread AS packet_loss_pct",
        "out_of_order",
        "packet_count - _unique AS duplicates",
    )
    out = out.withColumn("mos_lqe", estimate_mos(F.col("jitter_ms"), F.col("packet_loss_pct")))
    return out.withColumn("quality_rating", mos_rating(F.col("mos_lqe")))


def packets_of_calls(
    rtp_packets: DataFrame, media: DataFrame, call_table: DataFrame, times: MediaRules = _TIMES
) -> DataFrame:
    """Packets without a call, with the calls that advertised their destination and are live when they arrive."""
    ends = media.filter("phase in ('offer', 'answer') and ip is not null and port > 0").select(
        *CALL, F.col("ip").alias("dst_ip"), F.col("port").alias("dst_port")
    )
    live = ends.distinct().join(media_spans(call_table, times), CALL)
    at = rtp_packets.withColumn("_at", F.col("ts_us"))
    met = overlap_join(live, at, ENDPOINT, ("live_us", "gone_us"), ("ts_us", "_at"))
    return met.select(*ENDPOINT, *[c for c in rtp_packets.columns if c not in ENDPOINT], "call_id")


def streams_of_calls(
    rtp_packets: DataFrame,
    media: DataFrame,
    call_table: DataFrame,
    rules: RtpRules = _RULES,
    strict: bool = False,
    span: int = CHUNK_FRAMES,
    times: MediaRules = _TIMES,
) -> DataFrame:
    """Streams towards the media endpoints a call advertised, while it is live, for packets without a call.

    An endpoint and source that later calls use again gives each of them the packets of its own time."""
    packets = packets_of_calls(rtp_packets, media, call_table, times)
    return rtp_streams(packets, rules, strict, span, [*ENDPOINT, "call_id", "ssrc"])


def call_quality(streams: DataFrame, rules: RtpRules = _RULES) -> DataFrame:
    """Per call, over streams of enough packets: mean jitter and loss, lowest MOS."""
    out = (
        streams.filter(F.col("packet_count") >= rules.min_packets)
        .groupBy(*CALL)
        .agg(
            F.expr("count(1) AS streams"),
            F.expr("coalesce(avg(jitter_ms) FILTER (WHERE jitter_ms > 0), 0D) AS avg_jitter_ms"),
            F.expr("avg(packet_loss_pct) AS avg_loss_pct"),
            F.expr("min(mos_lqe) AS min_mos"),
        )
    )
    return out.withColumn("overall_quality", mos_rating(F.col("min_mos")))


def rtcp_summary(rtcp_reports: DataFrame) -> DataFrame:
    """Per call: number of reports, mean jitter, total loss and mean fraction lost."""
    rows = rtcp_reports.selectExpr(
        *CALL,
        "try_cast(jitter as bigint) / 8 AS jitter",
        "try_cast(lost as bigint) AS lost",
        "try_cast(fraction as bigint) / 256 * 100 AS fraction",
    )
    return rows.groupBy(*CALL).agg(
        F.expr("count(1) AS reports_found"),
        F.expr("coalesce(avg(jitter), 0D) AS avg_jitter_ms"),
        F.expr("coalesce(sum(lost), 0) AS total_lost"),
        F.expr("coalesce(avg(fraction), 0D) AS avg_fraction_lost"),
    )


def quality_findings(quality: DataFrame, rules: RtpRules = _RULES) -> DataFrame:
    """High jitter, high loss and low MOS per call."""
    tests = [
        (
            f"avg_jitter_ms > {rules.jitter_warning_ms}",
            f"avg_jitter_ms < {rules.jitter_critical_ms}",
            "Jitter above the limit",
            "concat('Jitter averages ', round(avg_jitter_ms, 2), ' ms')",
            "avg_jitter_ms",
            "high",
        ),
        (
            f"avg_loss_pct > {rules.loss_warning_pct}",
            f"avg_loss_pct < {rules.loss_critical_pct}",
            "Loss above the limit",
            "concat('Loss averages ', round(avg_loss_pct, 2), '%')",
            "avg_loss_pct",
            "high",
        ),
        (
            f"min_mos < {rules.mos_warning}",
            f"min_mos >= {rules.mos_critical}",
            "MOS below the limit",
            "concat('The worst stream rates ', overall_quality, ', MOS ', round(min_mos, 2))",
            "min_mos",
            "medium",
        ),
    ]
    rows = ", ".join(
        f"IF({test}, named_struct('type', 'rtp_quality', 'severity',"
        f" IF({mild}, 'warning', 'critical'), 'title', '{title}', 'description', {text},"
        f" 'evidence', array(concat('{value}=', round({value}, 2))),"
        f" 'confidence', '{confidence}'), NULL)"
        for test, mild, title, text, value, confidence in tests
    )
    found = quality.select(*CALL, F.expr(f"explode(array_compact(array({rows})))").alias("f"))
    return found.select(*CALL, "f.*")
