"""Whole analyses: stages written as tables, so that every later stage reads a stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalloom.operators import correlate, handover, media, nodes, ran, report, rtp, sip
from signalloom.operators import packets as packet_ops
from signalloom.operators import radio as radio_ops
from signalloom.operators import transactions as tx_ops
from signalloom.sources import sinks


class Store:
    """Stage tables below one folder."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark = spark
        self.out = out

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.out}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def analyze_packets(store: Store, packets: DataFrame) -> dict[str, DataFrame]:
    """Packets to flows, sessions, summary and capture report."""
    classified = packet_ops.classify_packets(packets)
    if "payload" in packets.columns and "sip_status" not in packets.columns:
        classified = packet_ops.with_sip_failures(classified)
    classified = store.write("packets", classified)
    flow_table = store.write("flows", packet_ops.flows(classified))
    sessions = store.write("sessions", packet_ops.telecom_sessions(flow_table))
    summary = store.write("summary", packet_ops.capture_summary(classified, flow_table))
    trace = store.write("report", report.trace_report(flow_table, sessions, summary))
    return {
        "packets": classified,
        "flows": flow_table,
        "sessions": sessions,
        "summary": summary,
        "report": trace,
    }


def analyze_fields(
    store: Store, fields: DataFrame, flow_table: DataFrame, packets: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Dissected rows to transactions, KPIs, anomalies, calls, voice and RAN findings, node roles.

    With ``packets``, media are matched to calls second by second, else by whole flows."""
    built = store.write("built", tx_ops.build_transactions(fields))
    paired = store.write("transactions", tx_ops.pair_transactions(built))
    messages = store.write("sip_messages", tx_ops.sip_messages(fields))
    dialogs = store.write("dialogs", sip.dialogs(messages))
    calls = store.write("calls", sip.calls(messages, dialogs))
    registrations = store.write("registrations", sip.registrations(messages, dialogs))
    lines = store.write("media", media.media_lines(messages))
    presence = store.write("media_presence", media.media_presence(lines, flow_table))
    traffic = media.media_traffic(packets) if packets is not None else media.flow_traffic(flow_table)
    streams = store.write("media_streams", media.media_streams(lines, traffic, calls))
    voice = media.voice_findings(
        media.one_way_audio(streams, calls),
        media.silent_calls(streams, calls),
        media.codec_findings(lines),
        media.precondition_findings(messages, calls),
        media.ringback_findings(media.ringback(messages, calls, presence)),
    )
    events = store.write("ran_events", ran.with_ue_key(ran.ran_events(fields)))
    evidence = handover.ran_evidence(events)
    moved = handover.handover_findings(
        handover.hints_with_ran(handover.sip_hints(calls, messages), evidence)
    )
    findings = store.write("ran_findings", ran.ran_findings(events))
    votes = store.write("role_votes", nodes.role_votes(built))
    return {
        "transactions": paired,
        "procedure_kpis": store.write("procedure_kpis", tx_ops.procedure_kpis(paired)),
        "window_changes": store.write(
            "window_changes", tx_ops.compare_windows(paired, timeline=built)
        ),
        "anomalies": store.write("anomalies", tx_ops.temporal_anomalies(paired)),
        "calls": calls,
        "registrations": registrations,
        "sip_kpis": store.write("sip_kpis", sip.sip_kpis(calls, registrations)),
        "voice_findings": store.write("voice_findings", voice),
        "handover_findings": store.write("handover_findings", moved),
        "ran_timelines": store.write("ran_timelines", sinks.timelines_with_sample(events)),
        "ran_findings": findings,
        "node_roles": store.write("node_roles", nodes.classify_nodes(votes)),
    }


def analyze_rtp(
    store: Store, rtp_packets: DataFrame, lines: DataFrame, calls: DataFrame
) -> dict[str, DataFrame]:
    """RTP packets to stream and call quality and the findings on it."""
    streams = store.write("rtp_streams", rtp.streams_of_calls(rtp_packets, lines, calls))
    quality = store.write("call_quality", rtp.call_quality(streams))
    return {
        "rtp_streams": streams,
        "call_quality": quality,
        "quality_findings": store.write("quality_findings", rtp.quality_findings(quality)),
    }


def analyze_planes(store: Store, signals: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Signalling and radio events of a case to correlations, incidents and radio findings."""
    correlations = store.write("correlations", correlate.find_correlations(signals, events))
    incidents = store.write("incidents", correlate.incidents(correlations))
    timeline = correlate.cross_plane_timeline(signals, events)
    return {
        "correlations": correlations,
        "incidents": incidents,
        "key_incidents": store.write("key_incidents", correlate.key_incidents(incidents)),
        "timeline": store.write("timeline", timeline),
        "correlation_report": store.write(
            "correlation_report", correlate.correlation_report(signals, events, correlations)
        ),
        "radio_findings": store.write(
            "radio_findings", radio_ops.radio_findings(events, incidents)
        ),
    }
