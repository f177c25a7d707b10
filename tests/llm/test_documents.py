"""Fingerprints, sharding, near duplicates, toxicity and mixing against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import mixing, paritysketch, toxicity
from signalloom.llm.components import connected
from signalloom.llm.sharding import shard_by_bytes
from signalloom.llm.winnowing import fingerprints

from .conftest import SCHEMA, plain_words


def test_fingerprints(docs, rows, none):
    got = {r.doc_id: r for r in fingerprints(docs.where("doc_id is not null").withColumnRenamed("lang", "tail")).collect()}
    own = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    assert len(got) == len(own)
    for at, (doc_id, text, *_) in enumerate(own):
        text, after = text or "", own[(at + 1) % len(own)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.near_edited == 1
        places = [int(p.split("@")[1]) for p in r.fingerprint.split()]
        assert places == sorted(set(places))
        gaps = np.diff(places)
        assert not len(gaps) or gaps.max() <= 16  # every window has a chosen gram
    by_text = defaultdict(set)
    for doc_id, text, *_ in own:
        by_text[text or ""].add(got[doc_id].fingerprint)
    assert all(len(s) == 1 for s in by_text.values())
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.2 > np.mean([r.near_next for r in long])
    assert fingerprints(none).count() == 0 and fingerprints(docs).count() == len(rows)


def test_one_document_is_its_own_next(spark):
    row = fingerprints(spark.createDataFrame([(5, "abcd efgh", "en", "s", 9)], SCHEMA)).first()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()


def test_sharding(docs, rows, none):
    got = shard_by_bytes(docs.withColumnRenamed("lang", "shard")).collect()
    assert len(got) == len(rows)
    sizes = {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows if d is not None}
    total, slots = defaultdict(int), defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == sizes[r.doc_id]
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest, whole = max(r.size for r in got), sum(r.size for r in got)
    assert all(abs(total[i] - whole / 8) <= 2 * largest for i in range(8))
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())  # no group here outweighs the largest row
    assert shard_by_bytes(none).count() == 0


def plain_components(rows, size=4, num=85, den=100):
    sets = {}
    for doc_id, text, *_ in rows:
        w = plain_words(text)
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(docs, rows, none):
    known = [r for r in rows if r[0] is not None]
    got = paritysketch.near_duplicates(docs.withColumnRenamed("lang", "component"), 4, 85, 100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == plain_components(known)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert paritysketch.near_duplicates(none).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    """Chains of edits around the least similarity, for many sizes: no link may be lost."""
    rng, rows = random.Random(7), []
    for size in range(4, 60):
        base = [f"s{size}v{i}" for i in range(size)]
        for _ in range(4):
            rows.append((len(rows), " ".join(base), None, None, 0))
            base = list(base)
            if rng.random() < 0.6:
                base[-1 - rng.randrange(min(3, size))] = f"n{rng.randrange(10**6)}"
            else:
                base += [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 4))]
    got = paritysketch.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_similar_sets_share_a_part():
    rng, starts = np.random.default_rng(5), paritysketch.band_starts(85, 100)
    for size in [6, 7, 11, 30, 100, 700, 3000]:
        for _ in range(20):
            one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            differ = int(rng.integers(0, len(one) * 15 // 100 + 1))
            cut = int(rng.integers(0, differ + 1))
            other = np.unique(np.concatenate([one[cut:], rng.integers(0, 1 << 63, differ - cut).astype(np.uint64)]))
            both = len(np.intersect1d(one, other))
            if 100 * both >= 85 * (len(one) + len(other) - both):
                keys = [set(paritysketch.part_keys(x, 85, 100, starts).tolist()) for x in (one, other)]
                assert keys[0] & keys[1] or paritysketch._set_id(one) == paritysketch._set_id(other)
                sketches = [paritysketch.folded_sketch(x) for x in (one, other)]
                words = paritysketch.folded_to(sketches, min(map(len, sketches)))
                assert np.bitwise_count(words[0] ^ words[1]).sum() <= len(one) + len(other) - 2 * both


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}
    for _ in range(70):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: parent[x] for x in touched}


def test_toxicity_finds_held_out_rows(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}n" for a in "bdkmstvz" for b in "aeiou"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["wretchful", "scumlike"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, None, None, None), (9001, "", None, None, 0), (None, "x", None, None, 1), (9002, "y" * 400000, None, None, 0)]
    labels += [(9000, None, None), (None, 1, 1), (5, 1, 1), (77777, 0, 1)]
    docs, known = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs.withColumn("score", F.lit("x")), known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert toxicity.toxicity(docs.limit(0), known).count() == 0
    none = toxicity.toxicity(docs, known.limit(0)).collect()
    assert len(none) == len(rows) and len({r.score for r in none}) == 1


def test_score_ignores_the_span_it_is_read_in():
    model = toxicity.Model(np.arange(0, 1 << 20, 7), np.full(len(range(0, 1 << 20, 7)), 0.01), 0.0)
    text = "".join(random.Random(1).choice("abcdef gh") for _ in range(5000))
    whole = toxicity.score_texts(model, [text])
    span, toxicity.SPAN = toxicity.SPAN, 700
    try:
        assert toxicity.score_texts(model, [text]) == pytest.approx(whole)
    finally:
        toxicity.SPAN = span


def test_shortage_goes_to_siblings_first(spark):
    supply = [("web", "en", 10), ("web", "de", 500), ("books", "en", 900)]
    table = spark.createDataFrame(supply, "d string, l string, tokens long")
    got = {(r.d, r.l): r.budget for r in mixing.budgets(table, ["d", "l"], {("web",): 1, ("books",): 1}, 600, 2).collect()}
    # web's 300: en can use 20 of its 150, de takes the other 280; books is not touched
    assert got == {("web", "en"): 20, ("web", "de"): 280, ("books", "en"): 300}
    got = {(r.d, r.l): r.budget for r in mixing.budgets(table, ["d", "l"], {("web",): 9, ("books",): 1}, 1500, 2).collect()}
    assert got == {("web", "en"): 20, ("web", "de"): 1000, ("books", "en"): 480}


def test_mixing_takes_epochs_and_a_prefix(docs, rows, none):
    out = mixing.mixed_documents(docs.withColumnRenamed("n_chars", "epoch")).collect()
    budget = {(r.mix_domain, r.mix_lang, r.mix_source): r.leaf_budget for r in out}
    leaf = defaultdict(list)
    for r in out:
        leaf[r.mix_domain, r.mix_lang, r.mix_source].append(r)
    for name, taken in leaf.items():
        used, last = sum(r.tokens for r in taken), max(r.epoch for r in taken)
        assert last < 3 and used >= budget[name] and used - max(r.tokens for r in taken) <= budget[name]
    assert sum(budget.values()) <= sum(len(plain_words(r[1])) for r in rows)
    assert mixing.mixed_documents(none).count() == 0
