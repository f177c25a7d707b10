"""Clustering by bit planes and the trie self-join of fingerprints against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from signalloom.llm import bitplanes, bittrie

from .conftest import plain_words

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_clusters(rows, k=8, rounds=10, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    spot = {i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i, _ in kept}
    centroids = [v for i, v in sorted((r for r in kept if r[0] is not None), key=lambda r: spot[r[0]])[:k]]

    def nearest(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        for c, of in groups.items():
            centroids[c] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = [sum(d for _, c, d in found if c == k) for k in range(len(centroids))]
    return [(i, c, d, total[c], sum(total), names[c]) for i, c, d in found]


def vector_rows(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, 64))
    rows = [(i * 3, (centres[i % 5] + rng.normal(0, 0.1, 64)).astype(np.float32).tolist()) for i in range(n)]
    odd = [(5001, None), (5002, [0.5] * 63), (5003, [0.5] * 63 + [None]), (5004, [0.5] * 63 + [float("nan")]), (5005, [float("inf")] * 64), (5006, [])]
    return rows + odd + [rows[0], rows[0], (5007, rows[1][1]), (2**53 + 1, [0.0] * 64), (5008, [-1.0] * 64)]


@pytest.mark.parametrize("n", [0, 3, 200])
def test_clusters_equal_plain(spark, n):
    rows = vector_rows(n, n) if n else []
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(4)
    got = bitplanes.cluster_vectors(frame)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_clusters(rows))


def test_clusters_of_rows_without_id_and_clashing_columns(spark):
    rows = [*vector_rows(9, 40), (2**60 + 1, [0.25] * 64)]
    frame = spark.createDataFrame([(i, v, "x", b"y") for i, v in rows] + [(None, [0.1] * 64, "x", b"y")], "vec_id long, embedding array<double>, cluster string, planes binary")
    got = {r.vec_id: r for r in bitplanes.cluster_vectors(frame).collect()}
    assert None in got and 2**60 + 1 in got and 2**53 + 1 in got
    assert got[None].distance >= 0 and isinstance(got[None].cluster, int)


def test_plane_products_are_exact():
    rng = np.random.default_rng(1)
    for high in (1, 5, 1000, 2**26):
        x, y = rng.integers(-high, high, (20, 64)), rng.integers(-high // 3 - 1, high, (7, 64))
        assert (bitplanes.dots(bitplanes.to_planes(x), bitplanes.to_planes(y)) == x @ y.T).all()
        want = ((x[:, None, :] - y[None]) ** 2).sum(axis=2)
        assert (bitplanes.distances(bitplanes.to_planes(x), bitplanes.to_planes(y)) == want).all()
        assert (bitplanes.plane_sums(bitplanes.to_planes(x)) == x.sum(axis=0)).all()


def plain_fingerprint(text, size=4):
    words = plain_words(text)
    width = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, budget=4):
    """Smallest value that each of distinct values reaches."""
    left, out = set(values), {}
    for v in sorted(values):
        if v in left:
            todo = [v]
            left.discard(v)
            while todo:
                x = todo.pop()
                out[x] = v
                near = [y for y in left if (x ^ y).bit_count() <= budget]
                left.difference_update(near)
                todo += near
    return out


def fingerprints(seed, n, centres, flips):
    rng = random.Random(seed)
    heart = [rng.getrandbits(64) for _ in range(centres)]
    out = {0, 2**64 - 1}
    for _ in range(n):
        v = rng.choice(heart)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            v ^= 1 << b
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("seed, centres, flips, equal, capacity", [(1, 300, 4, 1, 8192), (2, 2, 6, 1, 16), (3, 40, 5, 2, 8192), (4, 1, 9, 1, 64), (5, 3, 12, 2, 32)])
def test_trie_links_equal_plain(spark, seed, centres, flips, equal, capacity):
    from signalloom.llm.components import connected

    values = fingerprints(seed, 600, centres, flips)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = bittrie.links_within(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), equal=equal, capacity=capacity)
    got = {r.node % 2**64: r.component for r in connected(links).collect()}
    want = plain_groups(values)
    groups = {}
    for v, first in want.items():
        groups.setdefault(first, set()).add(v)
    found = {}
    for v in values:
        found.setdefault(got.get(v, v - 2**64 if v >= 2**63 else v), set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_simhash_equals_plain(spark, docs, rows, none):
    got = bittrie.simhash_duplicates(docs).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    first = plain_groups({p for i, p in prints if i is not None})
    low = {}
    for i, p in prints:
        if i is not None:
            low[first[p]] = min(i, low.get(first[p], i))
    want = [(i, f"{p:016x}", None if i is None else low[first[p]]) for i, p in prints]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})
    assert bittrie.simhash_duplicates(none).collect() == []


def test_simhash_of_repeated_ids_and_clashing_columns(spark):
    base, other = " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(1, base, "x"), (1, other, "x"), (2, other, "x"), (2**60 + 1, base, "x"), (None, base, "x"), (7, None, "x"), (8, "", None), (8, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = sorted((str(r.doc_id), r.component_id) for r in bittrie.simhash_duplicates(frame).collect())
    assert got == sorted([("1", 1), ("1", 1), ("2", 1), (str(2**60 + 1), 1), ("None", None), ("7", 7), ("8", 7), ("8", 7)])
