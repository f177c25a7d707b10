"""Registered queries against their SQL on copies of the smallest data set with shifted keys."""

import os
import time

import duckdb
import pytest

from pyspark.sql import functions as F

from signalloom.catalog import CATALOG, voice
from signalloom.operators import correlate, media, ran
from signalloom.plans.deal import deal
from signalloom.plans.spans import _listed, overlap_join
from signalloom.session import stored
from signalloom.sources import radio_files
from test_catalog import FOLDER, _plain, _sorted

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """Five copies whose order keys lie far apart, so that sequence numbers wrap again and again."""
    folder = tmp_path_factory.mktemp("larger")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(
        f"copy (select t.* replace (l_orderkey + i * 50000 as l_orderkey, l_partkey + i * 200 as l_partkey,"
        f" l_suppkey + i * 20 as l_suppkey) from '{FOLDER}/lineitem.parquet' t, (select unnest(range(5)) as i))"
        f" to '{folder}/lineitem.parquet'"
    )
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["a28_a29_rtp_streams", "a30_call_quality", "d9_quality_findings", "j4_media_streams", "j11_streams_of_calls", "f2_call_media", "u1_voice_findings"])
def test_query_equals_sql_on_copies(spark, larger, name):
    folder, con = larger
    frame = CATALOG[name].query(spark, folder)
    columns = sorted(frame.columns)
    got = [tuple(_plain(row[c]) for c in columns) for row in frame.collect()]
    result = con.execute(CATALOG[name].sql)
    names = [d[0] for d in result.description]
    want = [tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert want and _sorted(got) == _sorted(want)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sdp_is_parsed_once(spark):
    rows = spark.sql("select 'c' capture_id, id call_id, id frame_number, 'INVITE' msg_type, 0 status_code, concat('c=IN IP4 1.1.1.', id) sdp from range(3)")
    assert _plan(media.media_lines(rows)).count("split(sdp") == 1
    assert _plan(media.call_media(media.media_lines(rows))).count("split(sdp") == 1


def test_parts_of_streams_are_summed_before_they_are_dealt(spark, larger):
    plan = _plan(CATALOG["j4_media_streams"].query(spark, larger[0]))
    keys = [line.split("functions=")[0] for line in plan.splitlines() if "Aggregate(" in line]
    assert keys and not any("end_us" in line for line in keys)


def test_points_are_listed_once_for_short_spans(spark):
    rows = "select 'k' k, id * 1000000 {0}, id * 1000000 + 5 {1}, id {2} from range(200)"
    spans, points = (spark.sql(rows.format(*names)) for names in ("beh", "uvi"))
    met = overlap_join(spans, points, ["k"], ("b", "e"), ("u", "v"))
    assert met.count() == 200
    top = points.select(F.lit(0)).limit(1).scalar()
    assert _listed(points, "u", "v", 900_000_000, top).count() == 200


def test_many_rows_are_dealt_into_parts_by_their_number(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 700)
    assert deal(rows, [F.col("k")], 5000, 100).rdd.getNumPartitions() == 50
    assert deal(rows, [F.col("k")], 5000, 4000).rdd.getNumPartitions() == 8
    assert sorted(r["id"] for r in deal(rows, [F.col("k")], 5000, 5000).collect()) == list(range(5000))


def test_rules_and_correlations_hold_over_many_parts(spark, monkeypatch):
    names = ["d21_ran_findings", "j10_correlations"]
    few = [_sorted(tuple(map(str, r)) for r in CATALOG[n].query(spark, FOLDER).collect()) for n in names]
    monkeypatch.setattr(ran, "EVENTS_EACH", 30)
    monkeypatch.setattr(correlate, "IDENTITIES_EACH", 100)
    many = [_sorted(tuple(map(str, r)) for r in CATALOG[n].query(spark, FOLDER).collect()) for n in names]
    assert few[0] and few[1] and few == many


def test_xml_rows_are_found_piece_by_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(radio_files, "PIECE", 40)
    row = "<ev><name>a &gt; b</name><cell id='1'/></ev>"
    texts = {"a": f"<log>{row * 300}</log>", "b": f"﻿<?xml version='1.0'?>\n<r><x>{row * 3}</x>text > more</r>\n", "c": "<log><ev>", "d": "<r><row/><row/></r> <!-- e -->", "e": "none", "f": f"<log>{row * 2}</log>x"}
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text)
    found = radio_files._row_elements(spark, str(tmp_path))
    got = {file.rsplit("/", 1)[1][0]: tag for tag, files in found.items() for file in files}
    want = {name: radio_files.row_element(text.removeprefix("﻿")) for name, text in texts.items()}
    assert got == {name: tag for name, tag in want.items() if tag} == {"a": "ev", "b": "ev", "d": "row"}
    pieces = radio_files._xml_pieces(spark, str(tmp_path)).filter("_file like '%a.xml'")
    assert max(len(r["piece"]) for r in pieces.collect()) < 100


@pytest.mark.parametrize("name", ["d1_one_way_audio", "d2_silent_calls"])
def test_messages_are_read_once(spark, larger, name):
    folder, con = larger
    frame = CATALOG[name].query(spark, folder)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_") == 1  # the packets
    columns = sorted(frame.columns)
    got = [tuple(_plain(row[c]) for c in columns) for row in frame.collect()]
    result = con.execute(CATALOG[name].sql)
    names = [d[0] for d in result.description]
    want = [tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert want and _sorted(got) == _sorted(want)


@pytest.mark.parametrize("name", ["u1_voice_findings", "a41_voice_statistics"])
def test_voice_stores_what_it_reads(spark, larger, name, monkeypatch):
    folder, con = larger
    kept, keep = [], voice.stored
    monkeypatch.setattr(voice, "stored", lambda df: kept.append(set(df.columns)) or keep(df))
    frame = CATALOG[name].query(spark, folder)
    calls, lines, streams = kept
    assert {"state", "classification"} <= calls and not calls & {"timing", "kpis", "transfer", "session_timer", "reason_header"}
    assert "phase" in lines and not streams & {"bytes", "first_frame"}
    columns = sorted(frame.columns)
    got = [tuple(_plain(row[c]) for c in columns) for row in frame.collect()]
    result = con.execute(CATALOG[name].sql)
    names = [d[0] for d in result.description]
    want = [tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert want and _sorted(got) == _sorted(want)


def test_what_was_shuffled_for_a_stored_table_goes(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    had = files()
    rows = stored(spark.range(1000).repartition(3, "id"))
    end = time.time() + 20
    while (left := {f for f in files() - had if f.startswith("shuffle_")}) and time.time() < end:
        time.sleep(0.5)
    assert rows.count() == 1000 and not left
