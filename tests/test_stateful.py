"""Stateful jobs: order of events, late rows, many triggers, against batch results."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_streaming import RUN, files_stream

from signalbook import rules
from signalbook.streaming import jobs, stateful

START = datetime(2024, 1, 1)


def at(minutes):
    return str(START + timedelta(minutes=minutes))


def test_usage_counts_in_event_order(spark, tmp_path):
    """The second run arrives first; a late run and its slot's end are told by the watermark."""
    s = files_stream(spark, tmp_path, RUN, [
        [(2, 7, at(5), True), (9, 8, at(1), False)],
        [(1, 7, at(2), False), (3, 7, at(6), True), (4, 7, at(130), False)],
        [(6, 7, at(300), True)],  # closes the first slot: the watermark is at 70 minutes
        [(5, 7, at(20), True), (7, 7, at(900), True)],  # the first one is too late
        [(8, 7, at(2000), True)],
    ])
    rows = jobs.run_available(stateful.usage_in_order(s, "1 hour", "1 hour", 2, 0.6)).orderBy("agent_id", "closed").collect()
    seen = [(r.agent_id, r.uses, r.wins, r.promoted_at_run) for r in rows]
    assert seen == [(7, 3, 2, 3), (7, 4, 2, 3), (7, 5, 3, 3), (7, 6, 4, 3), (8, 1, 0, 0)]


def test_usage_of_a_busy_agent(spark, tmp_path):
    """An agent with most runs, dealt over several triggers and out of order inside the delay."""
    rng = random.Random(4)
    runs = [(i, 1 if rng.random() < 0.8 else rng.randrange(2, 5), i * 2, rng.choice([True, False, None])) for i in range(300)]
    arrival = sorted(runs, key=lambda r: r[2] + rng.randrange(0, 50))
    batches = [[(i, a, at(m), ok) for i, a, m, ok in arrival[k : k + 75]] for k in range(0, 300, 75)] + [[(999, 99, at(100_000), True)]]
    s = files_stream(spark, tmp_path, RUN, batches)
    out = jobs.run_available(stateful.usage_in_order(s, "30 minutes", "1 hour"))
    got = {r.agent_id: tuple(r.s) for r in out.groupBy("agent_id").agg(F.max(F.struct("uses", "wins", "promoted_at_run")).alias("s")).collect()}
    want = {}
    for _, a, _, ok in runs:
        uses, wins, promoted = want.get(a, (0, 0, 0))
        uses, wins = uses + 1, wins + bool(ok)
        if not promoted and uses >= rules.MIN_USES_FOR_PROMOTION and wins / uses >= rules.MIN_SUCCESS_RATE_FOR_PROMOTION:
            promoted = uses
        want[a] = (uses, wins, promoted)
    assert got == want


def test_runs_without_an_agent_are_an_agent_of_their_own(spark, tmp_path):
    """Null agents are counted together and leave the agents beside them alone."""
    runs = [(i, None if i % 3 == 0 else i % 40, at(i), i % 2 == 0) for i in range(240)]
    s = files_stream(spark, tmp_path, RUN, [runs, [(999, 99, at(100_000), True)]])
    out = jobs.run_available(stateful.usage_in_order(s, "1 hour", "1 hour"))
    got = {r.agent_id: (r.uses, r.wins) for r in out.groupBy("agent_id").agg(F.max("uses").alias("uses"), F.max("wins").alias("wins")).collect()}
    want = {}
    for _, a, _, ok in runs:
        want[a] = (want.get(a, (0, 0))[0] + 1, want.get(a, (0, 0))[1] + ok)
    assert got == want


@pytest.mark.parametrize("slot", [600, 3600, 50_000])
def test_last_change(spark, tmp_path, slot):
    """A hot cell cut into slots; ties, alarms without a change, changes of earlier slots."""
    rng = random.Random(slot)
    cell = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b"])
    changes = [(i, cell(), f"p{i}", rng.randrange(0, 900)) for i in range(60)]
    alarms = [(i, cell(), rng.choice([rng.randrange(0, 900), changes[i % 60][3]])) for i in range(150)]
    merged = sorted([(m, 0, c) for *c, m in changes] + [(m, 1, c) for *c, m in alarms], key=lambda x: x[0] + rng.randrange(0, 40))
    kinds = "kind int, id long, cell_id string, param string, at timestamp"
    rows = [(k, c[0], c[1], c[2] if k == 0 else None, at(m)) for m, k, c in merged] + [(1, 999, "end", None, at(100_000))]
    s = files_stream(spark, tmp_path, kinds, [rows[k : k + 60] for k in range(0, len(rows), 60)])
    live = stateful.last_change_stream(
        s.filter("kind = 0").select(F.col("id").alias("change_id"), "cell_id", "param", F.col("at").alias("time")),
        s.filter("kind = 1").select(F.col("id").alias("alarm_id"), "cell_id", F.col("at").alias("raised_time")), 3600, slot, "1 hour")
    got = sorted((r.alarm_id, r.cell_id, r.change_id, r.param, r.age_seconds) for r in jobs.run_available(live).collect())
    want = []
    for i, c, m in alarms:
        best = max(((cm, ci, p) for ci, cc, p, cm in changes if cc == c and cm <= m), default=None)
        near = best if best and m - best[0] <= 60 else None
        want.append((i, c, near and near[1], near and near[2], near and (m - near[0]) * 60))
    assert got == sorted(want)


class _Value:
    """A value state that counts how often it is read and written."""

    def __init__(self):
        self.held, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.held is not None

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value


class _Handle:
    """Knows one value state and neither maps nor timers: their calls would be one or more a slot."""

    def __init__(self):
        self.value = _Value()

    def getValueState(self, name, schema):
        return self.value


def test_usage_touches_its_state_once_a_trigger():
    """Five hundred slots in disorder and in two batches cost as many state calls as one; the next trigger goes on from them."""
    handle, usage = _Handle(), stateful.UsageInOrder(2, 0.6)
    usage.init(handle)
    slots = [(i * 1000, bytes([i % 2, 0, 1])) for i in range(1, 501)]
    random.Random(5).shuffle(slots)
    parts = [pd.DataFrame(slots[k : k + 250], columns=["closed_ms", "outcomes"]) for k in (0, 250)]
    out = pd.concat(usage.handleInputRows((7, False), iter(parts), None))
    flags = [f for _, outcomes in sorted(slots) for f in outcomes]
    first = next(n for n in range(2, 1501) if sum(flags[:n]) / n >= 0.6)
    want = [(7, pd.Timestamp(i, unit="s"), 3 * i, sum(flags[: 3 * i]), first if first <= 3 * i else 0) for i in range(1, 501)]
    assert list(out.itertuples(index=False, name=None)) == want
    assert handle.value.calls <= 3
    late = pd.DataFrame({"closed_ms": [501_000], "outcomes": [b"\x01"]})
    [row] = pd.concat(usage.handleInputRows((7, False), iter([late]), None)).itertuples(index=False, name=None)
    assert row == (7, pd.Timestamp(501, unit="s"), 1501, sum(flags) + 1, first)
