"""Skew-safe building blocks against naive loops on seeded random rows."""

import random

from pyspark.sql import functions as F

from signalloom.plans.bands import band_aggregate
from signalloom.plans.ordered import with_neighbours
from signalloom.plans.quantiles import exact_percentiles
from signalloom.plans.ranks import rows_at_ranks
from signalloom.plans.spans import overlap_join


def test_neighbours_across_chunks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), n, rng.randint(0, 9)) for n in rng.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "k string, n long, v int")
    got = with_neighbours(
        df, ["k"], "n", {"p": ("lag", F.col("v")), "q": ("lead", F.col("v"))}, 16
    )
    want = set()
    for key in "ab":
        mine = sorted((n, v) for k, n, v in rows if k == key)
        for i, (n, v) in enumerate(mine):
            before = mine[i - 1][1] if i else None
            after = mine[i + 1][1] if i + 1 < len(mine) else None
            want.add((key, n, v, before, after))
    assert {tuple(r) for r in got.select("k", "n", "v", "p", "q").collect()} == want


def test_band_aggregate_includes_both_ends(spark):
    rng = random.Random(2)
    build = [(rng.choice("ab"), rng.randint(0, 200), i) for i in range(120)]
    probe = [(rng.choice("ab"), rng.randint(0, 200)) for _ in range(80)] + [("a", 0), ("c", 5)]
    b = spark.createDataFrame(build, "k string, ts_us long, i int")
    p = spark.createDataFrame(probe, "k string, ts_us long")
    for lo, hi in ((-5, 5), (0, 7), (1, 3)):
        got = band_aggregate(
            p, b, ["k"], lo, hi, {"n": ("sum", F.lit(1)), "low": ("min", F.col("i"))}
        )
        want = set()
        for k, t in set(probe):
            hits = [i for bk, bt, i in build if bk == k and t + lo <= bt <= t + hi]
            want.add((k, t, len(hits) or None, min(hits) if hits else None))
        assert {tuple(r) for r in got.select("k", "ts_us", "n", "low").collect()} == want


def test_exact_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), int(10 ** rng.uniform(0, 9))) for _ in range(500)] + [("c", 7)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()
    assert len(got) == 3
    for row in got:
        data = sorted(v for k, v in rows if k == row["k"])
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            at = (len(data) - 1) * p
            low = int(at)
            high = min(low + 1, len(data) - 1)
            assert abs(row[name] - (data[low] + (data[high] - data[low]) * (at - low))) < 1e-3
        assert (row["n"], row["min"], row["max"]) == (len(data), data[0], data[-1])


def test_rows_at_ranks_with_ties(spark):
    rng = random.Random(4)
    rows = [("a", rng.choice([5, 5, 5, 3_000_000, 9_000_000]), n) for n in range(90)]
    rows += [("b", 1, n) for n in range(3)]
    df = spark.createDataFrame(rows, "k string, ts long, seq long")

    def ranks(total):
        return F.lit(0).cast("bigint"), F.lit(7).cast("bigint"), total - 1

    got = rows_at_ranks(df, ["k"], "ts", "seq", ranks, 8)
    want = set()
    for key in "ab":
        mine = sorted((t, s) for k, t, s in rows if k == key)
        want |= {(key, *mine[i], i, len(mine)) for i in range(0, len(mine), 7)}
    assert {tuple(r) for r in got.select("k", "ts", "seq", "rank", "total").collect()} == want


def test_plans_have_no_cross_joins(spark):
    events = spark.range(100).selectExpr(
        "'c' AS capture_id", "concat('u', id % 3) AS ue_key", "id * 1000 AS ts_us"
    )
    out = band_aggregate(events, events, ["capture_id", "ue_key"], 0, 5000, {"n": ("sum", F.lit(1))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "SinglePartition" not in plan


def test_overlap_join_equals_pairs(spark):
    rng = random.Random(9)

    def spans(n):
        rows = []
        for i in range(n):
            begin = rng.randint(-500, 5000)
            rows.append((rng.choice(["a", "a", "b", None]), i, begin, begin + int(10 ** rng.uniform(0, 5)) - 1))
        return rows + [("a", n, 7, 3), ("a", n + 1, None, 9), ("a", n + 2, 9, None), ("a", n + 3, 50, 50), ("a", n + 3, 50, 50)]

    left, right = spans(150), spans(120)
    x = spark.createDataFrame(left, "k string, i long, b long, e long")
    y = spark.createDataFrame(right, "k string, j long, u long, v long")
    want = sorted(
        (i, j) for k, i, b, e in left for q, j, u, v in right
        if None not in (k, b, e, u, v) and k == q and b <= e and u <= v and b <= v and u <= e
    )
    for width in (1, 10, 100_000):
        got = overlap_join(x, y, ["k"], ("b", "e"), ("u", "v"), width)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    assert got.columns == ["k", "i", "b", "e", "j", "u", "v"]
    assert overlap_join(x.limit(0), y, ["k"], ("b", "e"), ("u", "v")).count() == 0
