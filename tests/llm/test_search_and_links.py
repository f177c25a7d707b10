"""Cover-tree search, URL verdicts, the pipeline, and registered queries against SQL."""

import os

import duckdb
import numpy as np
import pytest

from signalloom.llm import catalog, covertree, linkgraph

FOLDER = "/root/testdata/sf0.001"


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(300, 6)) + c for c in rng.normal(size=(5, 6)) * 9] + [np.ones((200, 6))])
    tree = covertree.CoverTree.build(np.arange(len(points)), points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for i in range(len(tree.centre)):
        gaps = np.linalg.norm(points[tree.below(i)] - points[tree.centre[i]], axis=1)
        assert gaps.max() <= tree.radius[i] + 1e-9
        if tree.width[i]:
            heads = points[tree.centre[tree.first[i] : tree.first[i] + tree.width[i]]]
            apart = np.linalg.norm(heads[:, None] - heads[None], axis=2) + np.eye(len(heads)) * 1e9
            assert apart.min() >= tree.radius[i] / covertree.SHRINK - 1e-9


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) + 3 * (i % 4)).tolist()) for i in range(700)]
    rows += [(i, [1.0] * 8) for i in range(700, 900)]  # one very common vector
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [9.0] * 8), (1200, [2.0] * 3), (1201, [1.0] * 3), (1250, [])]
    rows += [(850, [1.0] * 8)]
    table = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = sorted(tuple(r) for r in covertree.top_k(table, 5, 50, block=128, query_block=4).collect())
    good = {(i, tuple(np.floor(256 * np.array(v)).astype(int))) for i, v in rows if i is not None and v is not None and np.isfinite(np.array(v, float)).all()}
    want = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-int(np.dot(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert covertree.top_k(table.limit(0)).count() == 0


def test_blocks_are_pruned_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 6)) * 2000
    points = {i: np.floor(centres[i % 24] + rng.normal(size=6) * 20).astype(int) for i in range(4800)}
    rows = [(i, len(v), bytearray(v.astype("<f8").tobytes())) for i, v in points.items()]
    table = spark.createDataFrame(rows, "vec_id long, dim long, vec binary").repartition(4)
    found, bounds, rest = covertree.search_blocks(table, 5, 50, 50, 50)
    queries = bounds.select("query_number").distinct().count()
    assert (queries + rest.count()) / bounds.count() < 0.2
    best = {}
    for r in found.distinct().collect():
        best.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    matrix = np.stack([points[i] for i in range(4800)])
    for i in range(0, 4800, 50):
        scores = matrix @ matrix[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert sorted(best[i])[:5] == want


def test_url_parts_and_rules(spark):
    urls = ["https://A.Example.NET/en/1?x#y", "http://example.net/de/", "http://b.example.com/de/x", "ftp://x.org?q=/fr/", "http://x.org/fr/#a", "nothing", None, "", "http://", "http://notnet/", "http://É.org:80/fr/", "x://net/"]
    pages = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.url_verdicts(pages, linkgraph.RULES).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        1: ("example.net", "/de/", "net/", "block"),
        2: ("b.example.com", "/de/x", "example.com/de/", "block"),
        3: ("x.org", "", None, "allow"),
        4: ("x.org", "/fr/", "org/fr/", "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("notnet", "/", None, "allow"),
        10: ("É.org:80", "/fr/", None, "allow"),
        11: ("net", "/", "net/", "block"),
    }
    assert linkgraph.url_verdicts(pages.limit(0), linkgraph.RULES).count() == 0


def link_pages():
    """Hosts a, b and c link in a ring that ends at a blocked host; d links to a trusted one."""
    html = lambda *hosts: " ".join(f'<a href="//{h}/p">x</a>' for h in hosts)
    rows = [("http://bad.net/p", html("good.org")), ("http://a.com/", html("bad.net", "b.com")), ("http://b.com/", html("bad.net")), ("http://c.com/", html("a.com", "bad.net", "bad.net"))]
    rows += [("http://good.org/fr/", html("d.com")), ("http://d.com/", html("good.org")), ("http://d.com/2", None), ("http://e.com/", "<a href='/x'>")]
    return [(i, u, h) for i, (u, h) in enumerate(rows)]


def test_distrust_flows_against_links(spark):
    pages = spark.createDataFrame(link_pages(), "page_id long, url string, html string")
    got = {r.host: r for r in linkgraph.url_verdicts(pages, linkgraph.RULES, threshold=0.1).collect()}
    assert all(got[h].distrust > 0.1 and got[h].trust == 0 and got[h].verdict == "block" for h in ("a.com", "b.com", "c.com"))
    assert got["bad.net"].distrust > got["c.com"].distrust
    assert got["d.com"].trust > 0.1 and got["d.com"].verdict == "allow"
    assert got["e.com"].trust == got["e.com"].distrust == 0 and got["e.com"].verdict == "allow"


def rows_of(result, names):
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[n]) for n in names) for r in result), key=str)


def test_link_flow_equals_sql(spark):
    pages = spark.createDataFrame(link_pages(), "page_id long, url string, html string")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", link_pages())
    result = con.execute(catalog.SQL["op6_link_graph"])
    names = [d[0] for d in result.description]
    want = rows_of([dict(zip(names, r, strict=True)) for r in result.fetchall()], sorted(names))
    got = linkgraph.url_verdicts(pages, linkgraph.RULES, tolerance=0.0)
    assert rows_of(got.collect(), sorted(got.columns)) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    frame = catalog.QUERIES[name](spark, FOLDER)
    result = con.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.collect(), sorted(names)) == rows_of(want, sorted(names))


def test_pipeline_stages(spark, docs, rows):
    """Each stage against a plain version on a fixture: near duplicates go, mixing takes its rows, packing all ids."""
    import corpus_pipeline
    from signalloom.llm import mixing
    from signalloom.llm.tokens import library, public_path

    from .test_documents import plain_components

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "mixing", "packing"]
    kept = stages["near_duplicates"](spark, docs, "")
    of = plain_components([r for r in rows if r[0] is not None])
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] is None or of[r[0]][1] == r[0])
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() == mixing.mixed_documents(docs).count()
    packed = stages["packing"](spark, docs, "").collect()
    ids = sum(len(library(public_path("byte_bpe_50k.json")).encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r.length for r in packed) == ids


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert out and all(r.offset + r.length <= 2048 for r in out)
