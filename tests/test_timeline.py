"""Batch sessions, windows from panes and time ranges against brute force."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from signalbook.operators import timeline
from signalbook.streaming import jobs

START = datetime(2024, 1, 1)


def frame(spark, rows):
    """(cell, seconds or None, value) as cell_id, ts, value."""
    data = [(i, c, None if t is None else START + timedelta(seconds=t), v) for i, (c, t, v) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, cell_id string, ts timestamp_ntz, value long")


def random_rows(n, seed):
    """A cell with most of the rows, ties, repeated rows, times before 1970, null cells and null times."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([rng.randrange(0, 400_000), 3600 * rng.randrange(0, 110), -10**10 + rng.randrange(9)]), rng.randrange(-5, 90)) for _ in range(n)]
    return rows + rows[:5] + [("a", None, 7), (None, None, 7)]


@pytest.mark.parametrize("gap", [60, 3600, 6 * 3600])
def test_sessions(spark, gap):
    rows = random_rows(600, gap)
    want = []
    for cell in {c for c, _, _ in rows}:
        burst = []
        for t, v in sorted((t, v) for c, t, v in rows if c == cell and t is not None):
            if burst and t - burst[-1][0] >= gap:
                want.append((cell, burst[0][0], burst[-1][0], len(burst), sum(x[1] for x in burst)))
                burst = []
            burst.append((t, v))
        want.append((cell, burst[0][0], burst[-1][0], len(burst), sum(x[1] for x in burst)))
    got = timeline.sessions(frame(spark, rows), ["cell_id"], "ts", gap, {"total": F.col("value")}).collect()
    seconds = lambda t: int((t - START).total_seconds())
    assert sorted(map(str, ((r.cell_id, seconds(r.start), seconds(r.end), r.n, r.total) for r in got))) == sorted(map(str, want))


def test_sessions_meet_the_stream(spark, tmp_path):
    """Closed sessions are those the streaming job lets out, also when the alarms of a hot cell come in several triggers."""
    rows = [(c, t, v) for c, t, v in random_rows(300, 5) if t is not None and t >= 0 and c is not None]
    alarms = frame(spark, sorted(rows, key=lambda r: r[1])).select("cell_id", F.col("ts").cast("timestamp").alias("raised_time"))
    ordered = alarms.orderBy("raised_time").collect()
    for k in range(3):
        part = ordered[k * len(ordered) // 3 : (k + 1) * len(ordered) // 3]
        spark.createDataFrame(part, "cell_id string, raised_time timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("cell_id string, raised_time timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = jobs.run_available(jobs.alarm_sessions(stream, "6 hours", "1 hour")).select("cell_id", "start", "alarms")
    mark = F.lit(max(r.raised_time for r in ordered) - timedelta(hours=1))
    done = timeline.closed(timeline.alarm_sessions(alarms), 6 * 3600, mark).select("cell_id", "start", "alarms")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, done.collect()))


def test_edges_of_sessions(spark):
    rows = frame(spark, [("a", 0, 1), ("a", 3599, 1), ("a", 7199, 1), ("b", 5, 1)])
    got = timeline.alarm_sessions(rows, 3600, time="ts").collect()
    assert sorted((r.cell_id, r.alarms) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
    assert timeline.alarm_sessions(rows.filter("false"), 3600, time="ts").collect() == []
    with pytest.raises(ValueError):
        timeline.sessions(rows, ["cell_id"], "ts", 0)


@pytest.mark.parametrize("panes", [1, 2, 3, 7, 24])
def test_sliding(spark, panes):
    rows = random_rows(300, panes)
    want = {}
    for c, t, v in rows:
        for j in range(panes if t is not None else 0):
            key = (c, (t // 3600 - j) * 3600)
            n, total = want.get(key, (0, 0))
            want[key] = (n + 1, total + v)
    got = timeline.sliding_sums(frame(spark, rows), ["cell_id"], "ts", panes * 3600, 3600, {"n": F.lit(1), "total": F.col("value")})
    plan = got._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Generate" not in plan
    assert {(r.cell_id, int((r.start - START).total_seconds())): (r.n, r.total) for r in got.collect()} == want
    with pytest.raises(ValueError):
        timeline.sliding_sums(frame(spark, rows), ["cell_id"], "ts", 5000, 3600, {"n": F.lit(1)})


@pytest.mark.parametrize("span, slot", [(1, 3600), (3600, 60), (100_000, 3600)])
def test_range_sums(spark, span, slot):
    rows = random_rows(400, span)
    df = frame(spark, rows).withColumn("amount", F.col("value").cast("decimal(10,2)"))
    got = timeline.range_sums(df, ["cell_id"], "ts", span, {"n": F.lit(1), "total": F.col("amount")}, slot)
    assert got.columns == [*df.columns, "n", "total"]
    for r in got.collect():
        c, t, _ = rows[r.id]
        inside = [v for c2, t2, v in rows if c2 == c and t is not None and t2 is not None and t - span < t2 <= t]
        assert (r.n, r.total) == ((len(inside), Decimal(sum(inside))) if t is not None else (None, None))
