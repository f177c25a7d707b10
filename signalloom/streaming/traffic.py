"""Streaming twins of batch operators, over a stream of packet or RAN event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.operators.packets import FLOW_KEY, with_flow_key


def event_time() -> Column:
    """Timestamp of a row with ``ts_us``."""
    return F.timestamp_micros("ts_us")


def traffic_counters(packets: DataFrame, interval: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Frames and bytes per capture and interval; the twin of ``io_statistics``."""
    timed = packets.withColumn("ts", event_time()).withWatermark("ts", late)
    counted = timed.groupBy("capture_id", F.window("ts", interval)).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("length").cast("bigint").alias("bytes")
    )
    return counted.select(
        "capture_id", F.unix_micros("window.start").alias("interval_us"), "frames", "bytes"
    )


def closed_flows(packets: DataFrame, idle: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Flow records, each closed after a gap without packets; the twin of ``flows``."""
    timed = with_flow_key(packets).withColumn("ts", event_time()).withWatermark("ts", late)
    grouped = timed.groupBy(*FLOW_KEY, F.session_window("ts", idle).alias("w")).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("length").cast("bigint").alias("total_bytes"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
    )
    return grouped.drop("w")


def congestion_alarms(
    events: DataFrame, events_per_window: int = 10, late: str = "10 seconds"
) -> DataFrame:
    """UEs with many events in a window of 5 s that slides by 1 s. The batch rule anchors its window at
    an event; this one looks at whole seconds, so it may see up to 1 s less."""
    timed = events.withColumn("ts", event_time()).withWatermark("ts", late)
    counted = timed.groupBy("capture_id", "ue_key", F.window("ts", "5 seconds", "1 second")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return counted.filter(F.col("events") >= events_per_window).select(
        "capture_id", "ue_key", F.unix_micros("window.start").alias("start_us"), "events"
    )
