"""Streaming jobs over several triggers, with late rows, against their batch twins."""

from pyspark.sql import functions as F

from signalbook.streaming import jobs

RUN = "run_id long, agent_id long, created_at timestamp, success boolean"


def files_stream(spark, folder, schema, batches):
    """A stream that reads one file per trigger, in order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, ", ".join(c.replace("timestamp", "string") for c in schema.split(", ")))
        for c in schema.split(", "):
            if c.endswith(" timestamp"):
                name = c.split()[0]
                df = df.withColumn(name, F.to_timestamp(name))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_late_rows_are_dropped(spark, tmp_path):
    s = files_stream(spark, tmp_path, "ts timestamp, cell_id string, value double", [
        [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0)],
        [("2024-01-01 05:10:00", "a", 4.0)],  # the watermark of the first file applies from here on
        [("2024-01-01 00:20:00", "a", 9.0), ("2024-01-01 05:20:00", "a", 3.0)],  # the first is too late
        [("2024-01-01 09:00:00", "a", 1.0)],
    ])
    rows = jobs.run_available(jobs.kpi_hourly(s)).orderBy("hour_ts").collect()
    assert [(r.n, r.mean_value) for r in rows] == [(1, 1.0), (3, 3.0)]


def test_usage_is_sticky_over_triggers(spark, tmp_path):
    s = files_stream(spark, tmp_path, RUN, [
        [(1, 7, "2024-01-01 00:00:00", True), (2, 7, "2024-01-01 00:01:00", True)],
        [(3, 7, "2024-01-01 00:02:00", False), (4, 7, "2024-01-01 00:03:00", False), (5, 7, "2024-01-01 00:04:00", False)],
        [(6, 8, "2024-01-01 00:00:00", False)],
    ])
    rows = jobs.run_available(jobs.usage_state(s), "update").collect()
    best = {r.agent_id: max((x.uses, x.wins, x.promoted_at_run) for x in rows if x.agent_id == r.agent_id) for r in rows}
    assert best == {7: (5, 2, 2), 8: (1, 0, 0)}


def test_dedup_over_triggers(spark, tmp_path):
    s = files_stream(spark, tmp_path, "ts timestamp, question string", [
        [("2024-01-01 00:00:00", "A?")], [("2024-01-01 00:10:00", " a? "), ("2024-01-01 00:11:00", "b")],
    ])
    assert sorted(r.question.strip().lower() for r in jobs.run_available(jobs.dedup_stream(s)).collect()) == ["a?", "b"]


def test_sessions(spark, tmp_path):
    s = files_stream(spark, tmp_path, "raised_time timestamp, cell_id string", [
        [("2024-01-01 00:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-01 12:00:00", "a")], [("2024-01-03 00:00:00", "b")],
    ])
    rows = jobs.run_available(jobs.alarm_sessions(s)).orderBy("start").collect()
    assert [r.alarms for r in rows] == [2, 1]


def test_changes_meet_alarms_by_slot(spark, tmp_path):
    """Pairs up to the ends of the range and over slots, each once; a busy cell's rows meet by cell and slot, not by cell alone."""
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    changes, alarms = [(i, m) for i, m in enumerate(range(0, 900, 45))], [(i, m) for i, m in enumerate(range(0, 1000, 30))]
    rows = [(0, i, "hot", at(m)) for i, m in changes] + [(1, i, "hot", at(m)) for i, m in alarms] + [(0, 90, None, at(5)), (1, 91, None, at(5)), (0, 92, "hot", None)]
    s = files_stream(spark, tmp_path, "kind int, id long, cell_id string, at timestamp", [rows[::2], rows[1::2]])
    for within, minutes in (("1 hour", 60), ("1 day", 1440), ("90 seconds", 1)):
        live = jobs.correlate_stream(
            s.filter("kind = 0").select(F.col("id").alias("change_id"), "cell_id", F.lit("p").alias("param"), F.col("at").alias("time")),
            s.filter("kind = 1").select(F.col("id").alias("alarm_id"), "cell_id", F.col("at").alias("raised_time")), within, "2 days")
        got = sorted(map(tuple, jobs.run_available(live).collect()))
        assert got == sorted((a, "hot", c, "p") for a, am in alarms for c, cm in changes if 0 <= am - cm <= minutes)
        assert "_slot" in live._jdf.queryExecution().analyzed().toString()
