"""Search phrases over whole investigations, and the split of sources."""

import random

import pytest

from signalbook import rules
from signalbook.operators import evidence
from signalbook.plans import fixtures

SAMPLE = (
    "inv_id string, seq long, status string, prb_utilization_dl_pct double, sinr_avg_db double, erab_drop_rate_pct double, "
    "rrc_setup_success_pct double, ul_interference_dbm double")
PHRASES = list(rules.ISSUE_PHRASES.values())


def tags_of(r):
    hits = [r[3] is not None and r[3] > 80, r[4] is not None and r[4] < 5, r[5] is not None and r[5] > 1, r[6] is not None and r[6] < 95,
            r[7] is not None and r[7] > -100]
    return [p for p, hit in zip(PHRASES, hits) if hit and r[2] == "DEGRADED"]


def alarm_of(kind):
    return next((text for parts, text in rules.ALARM_PHRASES if kind and any(p in kind for p in parts)), None)


@pytest.mark.parametrize("distinct", [False, True])
def test_search_over_an_investigation(spark, distinct):
    rng = random.Random(2)
    inv = lambda: "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c"])
    some = lambda low, high: rng.choice([None, rng.uniform(low, high)])
    samples = [(inv(), rng.randrange(50), rng.choice(["DEGRADED", "NORMAL", None]), some(60, 100), some(0, 10), some(0, 2), some(90, 100), some(-120, -80)) for _ in range(200)]
    alarms = [(inv(), rng.randrange(50), rng.choice(["S1_LINK_DOWN", "VSWR_HIGH", "UL_INTERFERENCE", "CPU_X", "OTHER", None])) for _ in range(60)] + [("d", 1, "CPU")]
    asked = [(k, f"q {k}") for k in "abcd"] + [("hot", "q"), ("none", "what?")]
    got = evidence.investigation_search(
        spark.createDataFrame(asked, "inv_id string, query string"), spark.createDataFrame(samples, SAMPLE).repartition(7),
        spark.createDataFrame(alarms, "inv_id string, seq long, type string"), distinct=distinct)
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()  # cut before the shuffle
    want = {}
    for key, query in asked:
        places = [((0, r[1], i), t) for r in samples if r[0] == key for i, t in enumerate(tags_of(r))]
        places += [((1, s, 0), alarm_of(kind)) for k, s, kind in alarms if k == key and alarm_of(kind)]
        ordered = [t for _, t in sorted(places)]
        if distinct:
            ordered = list(dict.fromkeys(ordered))
        want[key] = " ".join(ordered[:3]) or f"3GPP procedure for {query}"
    assert {r.inv_id: r.search for r in got.collect()} == want


def test_first_in_order_of_nothing(spark):
    rows = spark.createDataFrame([("a", 1, None)], "k string, at long, v string")
    assert evidence.first_in_order(rows, "k", ["at"], "v", 3).collect() == []


def test_sources_without_a_number_are_in_the_base(spark, tmp_path):
    names = ["src1", "src2", None, "", "web", "s99999999999999999999", "7up"]
    rows = [(i, f"t{i}", "en", s) for i, s in enumerate(names)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    new, base = fixtures.new_and_base(spark, str(tmp_path))
    assert sorted(r.source for r in new.collect()) == ["7up", "src1"]
    assert new.count() + base.count() == len(names)
