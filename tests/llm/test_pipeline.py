"""Stages of the corpus pipeline against plain versions."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np

from signalloom.llm import catalog, toxicity
from signalloom.llm.tokens import library, public_path

from .conftest import SCHEMA
from .test_documents import plain_components


def grown_rows():
    """Documents with words appended or replaced, so that similarities lie around 0.8."""
    rng, rows = random.Random(11), []
    for size in (6, 9, 15, 30, 60, 110, 200, 400):
        base = [f"s{size}v{i}" for i in range(size)]
        for share in (0, 0.05, 0.12, 0.17, 0.2, 0.23, 0.27, 0.35):
            rows.append((len(rows), " ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(int(size * share))]), None, None, 0))
        for edits in range(1, 6):
            words = list(base)
            for i in rng.sample(range(size), min(size, edits * size // 50 + 1)):
                words[i] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), None, None, 0))
    return rows


def test_near_duplicates_of_five_words(spark):
    rows = grown_rows()
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "")
    want = sorted(d for d, (_, first) in plain_components(rows, 5, 80, 100).items() if first == d)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert want != sorted(d for d, (_, first) in plain_components(rows).items() if first == d)


def test_copy_with_forty_words_appended(spark):
    base = " ".join(f"v{i}" for i in range(200))
    rows = [(1, base, None, None, 0), (2, base + " " + " ".join(f"x{i}" for i in range(40)), None, None, 0)]
    assert [r.doc_id for r in corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [1]


def test_repeated_rows_and_copies_without_id(spark):
    base, other = " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(1, base), (1, base), (2, base), (3, other), (3, other), (3, base + " end"), (None, base), (None, base), (None, other)]
    rows += [(4, ""), (4, ""), (5, ""), (6, None), (None, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], SCHEMA).repartition(4)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    # the rows of 3 are one document, which a copy of 1 joins to 1
    assert sorted(kept, key=str) == sorted([(1, base), (None, base), (None, other), (4, ""), (5, ""), (6, None), (None, None), (None, "")], key=str)


def test_run_stage_by_stage(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    plain = [f"{a}{b}n" for a in "bdkmstvz" for b in "aeiou"]
    texts = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        for _ in range(4 * (i % 5 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(["wretchful", "scumlike"]))
        texts.append(" ".join(words))
    texts += [t + " end" for t in texts[:40]] + texts[40:60]
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["src0", "src7", "src12"]), len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = [tuple(r) for r in docs.collect()]
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    assert sorted(seen["toxicity"]) == rows
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    clean = [r for r in rows if not predicted[r[0]]]
    assert sorted(seen["near_duplicates"]) == clean
    assert np.mean([predicted[i] == (i % 5 == 0) for i in range(400)]) > 0.9

    first = plain_components(clean, 5, 80, 100)
    kept = [r for r in clean if first[r[0]][1] == r[0]]
    assert sorted(seen["mixing"]) == kept and len(kept) < len(clean)

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", kept)
    result = con.execute(catalog.SQL["op10_mixing"])
    at = [d[0] for d in result.description].index("doc_id")
    times = Counter(r[at] for r in result.fetchall())
    assert Counter(seen["packing"]) == Counter({r: times[r[0]] for r in kept if times[r[0]]})

    want, encoder = Counter(), library(public_path("byte_bpe_50k.json"))
    for r in kept:
        ids = np.array([*encoder.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids) * bool(times[r[0]]), 2048):
            want[r[0], start, zlib.crc32(ids[start : start + 2048].tobytes())] += times[r[0]]
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in out) == want


NAMES = ["score", "Predicted", "digest", "component_id", "set_id", "epoch", "tokens", "leaf_budget", "mix_lang", "cut", "whole", "piece", "start", "length"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 91}x{i if j % 2 else 0}" for j in range(30)), "en", "src0", 0, *["mine"] * len(NAMES)) for i in range(40)]
    rows += [(i, rows[i][1], *rows[i][2:]) for i in range(5)] + [(90, None, None, None, None, *["mine"] * len(NAMES)), (None, "", "xx", "?", 1, *["mine"] * len(NAMES))]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in NAMES))
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.schema == docs.schema, name
        assert found.count() > 0 and all(r[n] == "mine" for r in found.collect() for n in NAMES), name
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(r[0]) for r in rows)


def test_stages_on_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b c d e f", "en", "src0", 11), (2, None, None, None, None)], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, some, str(tmp_path)).collect()) == [1, 2]
