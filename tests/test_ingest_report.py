"""Files without rows and columns without a field."""

import json

from signalloom.sources import ingest_report


def test_failed_files(spark, tmp_path):
    texts = {
        "a.json": json.dumps([{"Time": "x"}]),
        "b.json": '[{"Time": "x"}, {"Ti',
        "c.JSON": '{"n": 1}',
        "d.json": " \n",
        "e.xml": "<log><ev>1</ev><ev>2</ev></log>",
        "f.xml": "<log><ev>1</ev",
        "g.xml": "<log><ev>1</ev></log>",
        "below/h.html": "<table><tr><th>Time</th></tr><tr><td>1</td></tr></table>",
        "below/i.html": "<p>nothing</p>",
        "j.csv": "",
        "k.csv": "Time\n1",
        "l.bin": "",
    }
    (tmp_path / "below").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r["file"].rsplit("/", 1)[1]: (r["kind"], r["reason"]) for r in ingest_report.failed_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"b.json", "c.JSON", "d.json", "f.xml", "g.xml", "i.html"}
    assert got["b.json"][1].startswith("no JSON: ") and got["b.json"][1].endswith("line 1")
    assert got["c.JSON"] == ("json", "no list of objects") and got["d.json"] == ("json", "empty")
    assert got["f.xml"][1].startswith("no XML: ") and got["g.xml"] == ("xml", "no repeated element")
    assert got["i.html"][0] == "html"


def test_column_report(spark):
    rows = spark.createDataFrame([("t", 1, "10:00", " ", "a"), ("t", 2, None, "x", "b")], "trace_id string, row_no int, `Time` string, `odd.name` string, Message string")
    got = {r["column"]: (r["field"], r["filled"]) for r in ingest_report.column_report(rows).collect()}
    assert got["Time"] == ("timestamp", 1) and got["odd.name"] == (None, 1) and got["Message"][1] == 2


def test_ingest_with_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([{"Time": "2024-01-01 10:00:00", "Message": "m", "odd": "1"}]))
    (tmp_path / "in/b.json").write_text('[{"Time": "2024-')
    events, failed, columns = ingest_report.ingest_with_report(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert events.count() == 1
    assert [r["file"].rsplit("/", 1)[1] for r in failed.collect()] == ["b.json"]
    assert {r["column"]: r["field"] for r in columns.collect()}["odd"] is None
