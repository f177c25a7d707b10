"""Correlation of both planes against a plain scorer of all pairs."""

import random
import re

import pytest

from signalloom.config import CorrelationRules
from signalloom.operators import correlate

IDS = ["imsi", "guti", "tmsi", "ue_ip", "cell_id"]
SIGNALS = "trace_id string, event_no long, ts_us long, type string, " + ", ".join(f"{i} string" for i in IDS)
RADIO = "trace_id string, row_no long, ts_us long, event_type string, " + ", ".join(f"{i} string" for i in IDS)


def plain(signals, radio, rules):
    base = list(rules.identity.values())
    out = {}
    for trace, row, at, _, *own in radio:
        best = None
        for other, no, ts, _, *ids in signals:
            if other != trace:
                continue
            same = [b for b, x, y in zip(base, own, ids, strict=True) if x is not None and x == y]
            pct, gap = max(same, default=0), None if None in (at, ts) else abs(at - ts)
            if gap is not None and gap <= rules.strong_us:
                pct = min(pct + 10, 99) if same else 60
            elif gap is not None and gap <= rules.medium_us:
                pct = min(pct + 5, 95) if same else 45
            elif gap is not None and gap <= rules.weak_us and not same:
                pct = 30
            if pct >= rules.min_confidence and (best is None or (-pct, no) < best[:2]):
                best = (-pct, no, gap)
        if best:
            out[trace, row] = (-best[0], best[1], best[2])
    return out


def rows(rng, n, start):
    def value(i, name):
        return f"{name}{rng.randrange(1 if name == 'cell_id' else 12)}" if rng.random() < 0.25 else None

    def at():
        return None if rng.random() < 0.15 else rng.randrange(-60, 240) * 500_000 + rng.choice([0, 0, 1, -1])

    return [(rng.choice("ttu"), start + i, at(), "S", *[value(i, x) for x in IDS]) for i in range(n)]


@pytest.mark.parametrize("rules", [CorrelationRules(), CorrelationRules(strong_us=3_000_000, medium_us=7_000_000, weak_us=11_000_000, min_confidence=50)])
def test_correlations_equal_all_pairs(spark, rules):
    rng = random.Random(rules.weak_us)
    signals, radio = rows(rng, 160, 0), rows(rng, 150, 1000)
    found = correlate.find_correlations(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(radio, RADIO), rules)
    got = {(r["trace_id"], r["row_no"]): (r["confidence_pct"], r["event_no"], r["delta_us"]) for r in found.collect()}
    assert got == plain(signals, radio, rules)


def test_plan_deals_rows_by_identity_and_block(spark):
    rng = random.Random(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = correlate.find_correlations(spark.createDataFrame(rows(rng, 9, 0), SIGNALS), spark.createDataFrame(rows(rng, 9, 9), RADIO))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) < 8
    # nothing is dealt by the number of an event, and raw rows only together with their block
    assert not any("event_no" in e for e in exchanges)
    assert any("block" in e and "kind" in e and "REPARTITION" in plan for e in exchanges)


def test_empty_planes(spark):
    rng = random.Random(4)
    some, none = spark.createDataFrame(rows(rng, 9, 0), SIGNALS), spark.createDataFrame([], RADIO)
    assert correlate.find_correlations(some, none).count() == 0
    assert correlate.find_correlations(some.limit(0), spark.createDataFrame(rows(rng, 9, 0), RADIO)).count() == 0
