"""Parts of the parity sketches: no similar pair without a common key, small groups, bounded blocks."""

import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest

from signalloom.llm import oracles, paritysketch
from signalloom.llm.catalog import table

from .conftest import SCHEMA
from .test_documents import plain_components
from .test_pipeline import grown_rows

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("num", [50, 80, 85, 95])
def test_similar_sets_share_a_key(num):
    rng, starts = np.random.default_rng(num), paritysketch.band_starts(num, 100)
    for size in [*range(1, 40), 60, 100, 333, 1000]:
        for _ in range(12):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            most = size * (100 - num) // num
            gone, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                assert np.intersect1d(*(paritysketch.part_keys(x, num, 100, starts) for x in (a, b))).size


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("size, num", [(5, 80), (4, 85)])
def test_groups_stay_small(size, num):
    """On the documents: few pairs meet beyond the similar ones, and no group is large."""
    known, starts, sets = paritysketch.WordHashes(), paritysketch.band_starts(num, 100), {}
    for (text,) in duckdb.sql(f"select distinct text from '{FOLDER}/documents.parquet'").fetchall():
        found = paritysketch.shingle_hashes(text, size, known)
        if len(found):
            sets[paritysketch._set_id(found)] = found
    groups = defaultdict(set)
    for name, found in sets.items():
        for key in paritysketch.part_keys(found, num, 100, starts).tolist():
            groups[key].add(name)
    pairs = {p for g in groups.values() for p in combinations(sorted(g), 2)}
    met = Counter(map(len, groups.values()))
    assert max(met) <= 8 and len(pairs) < 2 * len(sets)
    assert sum(map(len, groups.values())) < 0.7 * sum(map(len, sets.values()))


@pytest.mark.parametrize("block", [3, 1024])
def test_blocks_find_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(paritysketch, "BLOCK", block)
    rng, rows = random.Random(2), grown_rows()
    base = [f"c{i}" for i in range(120)]
    for _ in range(60):  # one large group of near copies, and a passage in otherwise different texts
        words = list(base)
        for i in rng.sample(range(120), rng.randint(0, 3)):
            words[i] = f"n{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(words), None, None, 0))
        rows.append((len(rows), " ".join(base[:60] + [f"y{rng.randrange(10**6)}" for _ in range(60)]), None, None, 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in paritysketch.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_components(rows, 5, 80, 100)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_five_words_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = con.execute(oracles.near_duplicates_sql(5, 80, 100)).fetchall()
    got = paritysketch.near_duplicates(table(spark, FOLDER, "documents")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(want)
