"""Written results of a case, partitioned by capture or trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.ran import timeline_samples, ue_timelines


def write_capture(out: str, summary: DataFrame, flow_table: DataFrame) -> None:
    """Summary and flows of the captures."""
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    flow_table.write.mode("overwrite").partitionBy("capture_id").parquet(f"{out}/flows")


def timelines_with_sample(events: DataFrame, n: int = 10) -> DataFrame:
    """UE timelines with their first ``n`` events."""
    key = ["capture_id", "ue_key"]
    sample = (
        timeline_samples(events, n)
        .groupBy(*key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", "frame_number", "ts_us", "protocol", "procedure_label")
                )
            ).alias("events_sample")
        )
    )
    return ue_timelines(events).join(sample, key, "left")


def write_ran(out: str, events: DataFrame, findings: DataFrame) -> None:
    """RAN events, timelines with a sample of their events, and findings."""
    events.write.mode("overwrite").partitionBy("capture_id").parquet(f"{out}/ran_events")
    timelines_with_sample(events).write.mode("overwrite").parquet(f"{out}/ran_timelines")
    findings.write.mode("overwrite").parquet(f"{out}/ran_findings")


def write_correlation(
    out: str, timeline: DataFrame, report: DataFrame, findings: DataFrame
) -> None:
    """Cross-plane timeline, correlation report and radio findings."""
    timeline.write.mode("overwrite").partitionBy("trace_id").parquet(f"{out}/timeline")
    report.write.mode("overwrite").json(f"{out}/correlation_report")
    findings.write.mode("overwrite").json(f"{out}/radio_findings")


def load_signal_events(spark: SparkSession, out: str, *tables: str) -> DataFrame:
    """Stored flows and findings of a case as one table of signalling events.

    Each table keeps its columns; ``event_no`` orders tables as named and rows by their start.
    """
    parts = []
    for i, name in enumerate(tables):
        part = spark.read.parquet(f"{out}/{name}")
        kind = "protocol" if "protocol" in part.columns else "type"
        first = "first_frame" if "first_frame" in part.columns else "start_us"
        parts.append(
            part.withColumns(
                {
                    "trace_id": F.col("capture_id"),
                    "ts_us": F.col("start_us"),
                    "type": F.col(kind),
                    "table_no": F.lit(i),
                    "first": F.col(first),
                }
            )
        )
    out_df = parts[0]
    for part in parts[1:]:
        out_df = out_df.unionByName(part, allowMissingColumns=True)
    return out_df
