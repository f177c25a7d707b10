"""RAN rules against plain loops over each UE."""

import random
import re

import pytest

from signalloom.config import RanRules
from signalloom.operators import ran

SCHEMA = (
    "capture_id string, ue_key string, ts_us long, frame_number long, generation string, protocol string,"
    " procedure_label string, cause_label string, chunk_type string, retransmission boolean"
)
LABELS = ["HandoverPreparation", "UE Context Release", "HandoverCancel", "Paging", "UplinkNASTransport", None]
CAUSES = ["Radio link failure", "handover triggered", "congestion", "user inactivity", None, None]


def rows(seed, n, step):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ue = rng.choice(["hot", "hot", "hot", "b", "c"])
        at = rng.randrange(-20, 150) * step + rng.choice([0, 0, 1, -1])
        out.append(("cap", ue, at, i, rng.choice(["4G", "5G", "Unknown"]), "S1AP", rng.choice(LABELS), rng.choice(CAUSES), None, False))
    return out


def plain(events, rules):
    found = []
    for ue in {e[1] for e in events}:
        mine = sorted((e for e in events if e[1] == ue), key=lambda e: (e[2], e[3]))
        generation = mine[-1][4]
        label, cause = (lambda e: (e[6] or "").lower()), (lambda e: (e[7] or "").lower())
        for e in mine:
            if "release" in label(e) and "context" in label(e) and generation in ("4G", "5G"):
                found.append(("UE_CONTEXT_RELEASE", ue, generation, e[2], e[2]))
            if "radio link failure" in cause(e):
                found.append(("RADIO_LINK_FAILURE", ue, generation, e[2], e[2]))
            if "preparation" in label(e):
                bad = [x for x in mine if 0 < x[2] - e[2] <= rules.handover_window_us and ("cancel" in label(x) or "handover" in cause(x))]
                if bad:
                    found.append(("HANDOVER_FAILURE", ue, generation, e[2], bad[0][2]))
        for e in mine:
            ahead = [x for x in mine if 0 <= x[2] - e[2] <= rules.congestion_window_us]
            if len(ahead) >= rules.congestion_events:
                found.append(("SIGNALING_CONGESTION", ue, generation, e[2], ahead[-1][2], f"{len(ahead)} events"))
                break
    return found


@pytest.mark.parametrize("step, rules", [(500_000, RanRules()), (100_000, RanRules(handover_window_us=1_500_000, congestion_window_us=700_000, congestion_events=6))])
def test_rules_equal_plain(spark, step, rules):
    events = rows(step, 400, step)
    got = ran.ran_findings(spark.createDataFrame(events, SCHEMA).repartition(4), rules).filter("ue_key <> 'paging_global'")
    want = plain(events, rules)
    assert sorted((r["type"], r["ue_key"], r["generation"], r["start_us"], r["end_us"]) for r in got.collect()) == sorted(w[:5] for w in want)
    crowded = {(r["ue_key"], r["description"]) for r in got.filter("type = 'SIGNALING_CONGESTION'").collect()}
    assert all(any(u == w[1] and w[5] in text for u, text in crowded) for w in want if w[0] == "SIGNALING_CONGESTION")
    assert len({w[0] for w in want}) == 4


def test_one_rule_alone_equals_its_part(spark):
    events = spark.createDataFrame(rows(7, 300, 400_000), SCHEMA)
    whole = sorted(map(str, ran.ran_findings(events).collect()))
    parts = [ran.context_releases, ran.handover_failures, ran.radio_link_failures, ran.signalling_congestion, ran.transport_instability, ran.paging_activity]
    assert sorted(str(r) for part in parts for r in part(events).collect()) == whole
    assert ran.ran_findings(events.limit(0)).count() == 0


def test_plan_of_all_rules(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ran.ran_findings(spark.createDataFrame(rows(7, 9, 9), SCHEMA))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) < 8
    # the one join is of captures, not of UEs
    assert len(re.findall(r"Join \[", plan)) == 1
