"""Staged analyses over the derived tables of the smallest data set."""

import os

import pytest

from signalloom.operators import media, sip
from signalloom.plans import trace
from signalloom.sources.sample_tables import sample_table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_staged_analyses(spark, tmp_path):
    store = trace.Store(spark, str(tmp_path))

    def table(name):
        return store.write(f"in_{name}", sample_table(spark, FOLDER, name))

    packets = trace.analyze_packets(store, table("packets"))
    assert packets["flows"].count() > 0 and packets["report"].count() == 3
    found = trace.analyze_fields(store, table("fields"), packets["flows"], table("media_packets"))
    assert found["transactions"].count() > 0 and found["ran_findings"].count() > 0
    assert found["node_roles"].count() > 0 and found["calls"].count() > 0
    messages = table("sip_messages")
    rtp = trace.analyze_rtp(store, table("rtp_packets").drop("call_id"), media.media_lines(messages), sip.calls(messages))
    assert rtp["rtp_streams"].count() > 0
    planes = trace.analyze_planes(store, table("signals"), _events(table("radio_events")))
    assert planes["correlations"].count() > 0 and planes["radio_findings"].count() > 0


def _events(radio):
    from pyspark.sql import functions as F

    names = ["rsrp", "rsrq", "sinr", "throughput_dl_kbps", "throughput_ul_kbps"]
    return radio.withColumns(
        {
            "event_label": F.col("event_type"),
            "generation": F.lit("4G"),
            "time_epoch": F.col("ts_us") / 1e6,
            "time_text": F.col("ts_us").cast("string"),
            "paging": F.struct(F.lit(False).alias("success")),
            "raw": F.create_map().cast("map<string,string>"),
            **{n: F.lit(None).cast("double") for n in names},
        }
    )
