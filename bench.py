"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The derived trace tables are written once (not timed), since the operators read stored tables. Each
query is run once to warm up and once timed; its result is fully computed and thrown away.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from signalloom.catalog import base
from signalloom.catalog.base import CATALOG

HEADLINES = [
    "a1_flows",
    "j1_pair_transactions",
    "a9_latency_statistics",
    "a20_a24_calls",
    "f1_sdp_media_lines",
    "a28_a29_rtp_streams",
    "j8_hints_with_ran",
    "a34_ue_timelines",
    "j9_d16_handover_failures",
    "w1_d18_signalling_congestion",
    "f11_normalize_radio_rows",
    "j10_correlations",
    "a17_assign_subscribers",
    "p7_build_transactions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    staged = tempfile.mkdtemp(prefix="run-")
    derive = base.sample_table

    def stored(session: SparkSession, folder: str, name: str) -> DataFrame:
        path = f"{staged}/{name}"
        if not os.path.exists(path):
            rows = derive(session, folder, name).repartition(int(cpus))
            rows.write.mode("overwrite").parquet(path)
        return session.read.parquet(path)

    base.sample_table = stored
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            frame = CATALOG[name].query(spark, sf_dir)
            frame.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
