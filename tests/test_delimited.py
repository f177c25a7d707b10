"""Delimited files against Python's csv module, whole and in small blocks."""

import csv
import io
import random

import pytest

from signalloom.sources.delimited import POSITION, read_delimited
from signalloom.sources.fields import read_fields
from signalloom.sources.radio_files import read_radio_csv


def plain(texts, delimiter):
    rows = []
    for name, text in texts.items():
        head, *body = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if any(c.strip() for c in r) or len(r) > 1]
        rows += [(name, {k.strip(): v.replace("\r\n", "\n") for k, v in zip(head, r, strict=False) if v != ""}) for r in body]
    return rows


def random_text(rng, delimiter, names, n):
    def cell():
        kind = rng.random()
        if kind < 0.15:
            return '"' + rng.choice(["two\nlines", "a\n\nb", f"x{delimiter}y", 'say ""hi""', '""\n""', "\n", f'end""{delimiter}\n']) + '"'
        return rng.choice(["1", "ab c", 'inch 5"', "", "x", "ü"])

    lines = [delimiter.join(names)] + [delimiter.join(["r" + str(i), *[cell() for _ in names[1:]]]) for i in range(n)]
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("size", [None, 4096])
@pytest.mark.parametrize("delimiter", [",", ";"])
def test_records_with_breaks_equal_csv(spark, tmp_path, delimiter, size):
    rng = random.Random(ord(delimiter) + (size or 0))
    texts = {f"f{k}": random_text(rng, delimiter, ["id", "b", "c", f"only{k}"], 900) for k in range(3)}
    texts["plain"] = delimiter.join(["c", "id"]) + "\n" + "".join(f"v{i}{delimiter}p{i}\n\n" for i in range(50))
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_delimited(spark, str(tmp_path))
        if size:
            assert rows.select("_file", "_block").distinct().count() > 10
        got = [(r["trace_id"], {k: v for k, v in r.asDict().items() if k not in {"trace_id", *POSITION} and v not in (None, "")}) for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda r: (r[0], sorted(r[1].items()))
    assert sorted(got, key=key) == sorted(plain(texts, delimiter), key=key)


def test_a_quote_that_is_never_closed_joins_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"open\n2,x\n3,y\n')
    (tmp_path / "b.csv").write_text('a,b\n4,"two\nlines"\n5,z\n')
    (tmp_path / "empty.csv").write_text("")
    rows = sorted((r["a"], r["b"]) for r in read_radio_csv(spark, str(tmp_path)).collect())
    assert [r[0] for r in rows] == ["1", "2", "3", "4", "5"] and rows[3][1] == "two\nlines" and rows[1][1] == "x"


def test_field_exports_of_unequal_headers(spark, tmp_path):
    (tmp_path / "capture_id=c1").mkdir()
    (tmp_path / "capture_id=c2").mkdir()
    (tmp_path / "capture_id=c1/x.csv").write_text('frame.number,ip.src\n7,10.0.0.2\n8,\n,\n')
    (tmp_path / "capture_id=c2/y.csv").write_text('ip.src,frame.number,sip.Method,sip.msg_body\n10.0.0.9,3,INVITE,"v=0\nc=IN IP4 1.2.3.4"\n')
    rows = read_fields(spark, str(tmp_path))
    got = sorted((r["capture_id"], r["frame_number"], r["ip_src"], r["sip_Method"], r["sip_msg_body"]) for r in rows.collect())
    assert got == [("c1", "7", "10.0.0.2", None, None), ("c1", "8", None, None, None), ("c2", "3", "10.0.0.9", "INVITE", "v=0\nc=IN IP4 1.2.3.4")]


def test_torn_header_and_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id;"Event\nname"\n1;RLF\n2;"two\nparts"\n3;HO\n')
    rows = read_radio_csv(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r["Event\nname"], r["id"]) for r in rows] == [("RLF", "1"), ("two\nparts", "2"), ("HO", "3")]
