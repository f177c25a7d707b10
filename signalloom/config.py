"""Thresholds of the rules, overridable per call."""

from __future__ import annotations

from dataclasses import dataclass, field

# Rows of one window group when a key is cut along its frame numbers.
CHUNK_FRAMES = 1 << 22


@dataclass(frozen=True)
class TimingRule:
    response_timeout_ms: float
    latency_warning_ms: float
    latency_critical_ms: float
    retry_warning: int = 2
    retry_critical: int = 4


# Response timers and latency limits per protocol.
TIMING_RULES = {
    "GTPv2-C": TimingRule(3000, 500, 1500, 2, 4),
    "PFCP": TimingRule(5000, 1000, 3000, 2, 3),
    "SIP": TimingRule(32000, 200, 1000),
    "Diameter": TimingRule(4000, 1000, 3000),
    "NGAP": TimingRule(5000, 500, 2000),
    "S1AP": TimingRule(5000, 500, 2000),
}
DEFAULT_TIMING = TimingRule(5000, 1000, 3000)


@dataclass(frozen=True)
class CallRules:
    long_setup_ms: float = 10000.0
    early_drop_s: float = 3.0
    session_grace_s: float = 32.0
    ignore_challenges: bool = False


@dataclass(frozen=True)
class MediaRules:
    """When media belong to a call: from ``slack_us`` before its first to as long after its last message, and for
    ``open_us`` more if it was answered and its end was not seen."""

    slack_us: int = 2_000_000
    open_us: int = 1_800_000_000
    slot_us: int = 1_000_000


@dataclass(frozen=True)
class RtpRules:
    clock_rate: int = 8000
    one_wrap: bool = False
    min_packets: int = 10
    jitter_warning_ms: float = 50.0
    jitter_critical_ms: float = 100.0
    loss_warning_pct: float = 2.0
    loss_critical_pct: float = 5.0
    mos_warning: float = 3.5
    mos_critical: float = 3.0


@dataclass(frozen=True)
class RanRules:
    handover_window_us: int = 3_000_000
    congestion_window_us: int = 5_000_000
    congestion_events: int = 10
    retransmissions: int = 5
    paging_events: int = 10


@dataclass(frozen=True)
class RadioRules:
    rsrp_poor: float = -110.0
    rsrp_critical: float = -120.0
    sinr_poor: float = 0.0
    sinr_critical: float = -3.0
    throughput_collapse_kbps: float = 100.0
    harq_nack_critical: float = 10.0
    reconfig_latency_ms: float = 1000.0


@dataclass(frozen=True)
class CorrelationRules:
    strong_us: int = 5_000_000
    medium_us: int = 10_000_000
    weak_us: int = 20_000_000
    min_confidence: int = 30
    # Confidence of an identity match, in order of precedence.
    identity: dict[str, int] = field(
        default_factory=lambda: {
            "IMSI": 95,
            "GUTI": 85,
            "TMSI": 85,
            "UE_IP": 80,
            "CELL_ID": 70,
        }
    )
