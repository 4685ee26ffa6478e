"""Streaming queries over the events file, run until its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbook.plans import network as net
from signalbook.plans.catalog import query, table
from signalbook.plans.network import NET_SQL, TS
from signalbook.streaming import jobs, stateful


def stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    cell = net._cell(F.col("user_id"))
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "cell_id": cell, "k": F.get_json_object("props", "$.k").cast("int")})


def _alarms(spark, sf):
    return stream(spark, sf).filter("event_type = 'error'").select(
        F.col("event_id").alias("alarm_id"), "cell_id", F.col("ts").alias("raised_time"))


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("t1_kpi_hourly", f"""WITH {NET_SQL} SELECT cell_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_ts, count(*) AS n, round(avg(value), 6) AS mean_value FROM ev
  GROUP BY cell_id, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= date_trunc('milliseconds', {_MARK})""")
def hourly(spark, sf):
    out = jobs.run_available(jobs.kpi_hourly(stream(spark, sf)))
    return out.select("cell_id", _ts("hour_ts").alias("hour_ts"), "n", F.round("mean_value", 6).alias("mean_value"))


@query("t2_degradation_sliding", f"""WITH {NET_SQL}, x AS (SELECT cell_id, value > 60 AS bad, date_trunc('hour', ts) - to_hours(o::INT) AS s FROM ev, range(3) t(o)),
  g AS (SELECT cell_id, s, count(*) AS n, count_if(bad)::BIGINT AS degraded FROM x GROUP BY ALL)
  SELECT cell_id, {TS.format('s')} AS start, n, degraded FROM g WHERE degraded / n >= 0.5 AND s + INTERVAL 3 HOUR <= date_trunc('milliseconds', {_MARK})""")
def sliding(spark, sf):
    s = stream(spark, sf).withColumn("status", F.when(F.col("value") > 60, "DEGRADED").otherwise("NORMAL"))
    return jobs.run_available(jobs.degradation_sliding(s)).select("cell_id", _ts("start").alias("start"), "n", "degraded")


@query("t3_alarm_sessions", f"""WITH {NET_SQL}, e AS (SELECT cell_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ev WHERE event_type = 'error' WINDOW w AS (PARTITION BY cell_id ORDER BY ts, event_id)),
  s AS (SELECT cell_id, ts, sum(new) OVER (PARTITION BY cell_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e), g AS (SELECT cell_id, min(ts) AS a, max(ts) AS b, count(*) AS alarms FROM s GROUP BY cell_id, sid)
  SELECT cell_id, {TS.format('a')} AS start, alarms FROM g WHERE b + INTERVAL 6 HOUR <= date_trunc('milliseconds', (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'error'))""")
def sessions(spark, sf):
    return jobs.run_available(jobs.alarm_sessions(_alarms(spark, sf))).select("cell_id", _ts("start").alias("start"), "alarms")


@query("t4_usage_state", """WITH r AS (SELECT user_id AS agent_id, row_number() OVER w AS uses, sum((event_type <> 'error')::INT) OVER w AS wins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT agent_id, max(uses) AS uses, max(wins)::BIGINT AS wins, coalesce(min(CASE WHEN uses >= 2 AND wins / uses >= 0.6 THEN uses END), 0) AS promoted_at_run FROM r GROUP BY agent_id""")
def usage(spark, sf):
    runs = stream(spark, sf).select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("agent_id"), F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("success"))
    out = jobs.run_available(jobs.usage_state(runs), "update")
    latest = out.groupBy("agent_id").agg(F.max(F.struct("uses", "wins", "promoted_at_run")).alias("s"))
    return latest.select("agent_id", "s.uses", "s.wins", "s.promoted_at_run")


@query("t5_dedup_stream", """SELECT DISTINCT lower(event_type || ' ' || user_id) AS key FROM events""")
def dedup(spark, sf):
    s = stream(spark, sf).withColumn("question", F.concat_ws(" ", F.upper("event_type"), F.col("user_id").cast("string")))
    return jobs.run_available(jobs.dedup_stream(s.select("ts", "question"), "60 days")).select(F.lower("question").alias("key"))


@query("t6_correlate_stream", f"""WITH {NET_SQL} SELECT a.event_id AS alarm_id, a.cell_id, c.change_id, c.param FROM ev a JOIN changes c ON a.cell_id = c.cell_id AND a.ts >= c.time AND a.ts <= c.time + INTERVAL 6 HOUR WHERE a.event_type = 'error'""")
def correlate(spark, sf):
    names = F.array(*[F.lit(p) for p, _, _ in net.rules.CONFIG_BASELINE])
    changes = stream(spark, sf).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("change_id"), "cell_id", F.get(names, F.col("k") % 12).alias("param"), F.col("ts").alias("time"))
    return jobs.run_available(jobs.correlate_stream(changes, _alarms(spark, sf), "6 hours"))


@query("t4_usage_in_order", f"""WITH r AS (SELECT user_id AS agent_id, row_number() OVER w AS uses, sum((event_type <> 'error')::INT) OVER w AS wins FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= date_trunc('milliseconds', {_MARK}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT agent_id, max(uses) AS uses, max(wins)::BIGINT AS wins, coalesce(min(CASE WHEN uses >= 2 AND wins / uses >= 0.6 THEN uses END), 0) AS promoted_at_run FROM r GROUP BY agent_id""")
def usage_ordered(spark, sf):
    """Usage in event order, up to the last hour that the watermark has closed."""
    runs = stream(spark, sf).select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("agent_id"), F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("success"))
    out = jobs.run_available(stateful.usage_in_order(runs))
    latest = out.groupBy("agent_id").agg(F.max(F.struct("uses", "wins", "promoted_at_run")).alias("s"))
    return latest.select("agent_id", "s.uses", "s.wins", "s.promoted_at_run")


@query("t6_last_change", f"""WITH {NET_SQL}, mark AS (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 1 HOUR) AS m FROM events WHERE event_type IN ('error', 'purchase')),
  a AS (SELECT event_id AS alarm_id, cell_id, ts FROM ev, mark WHERE event_type = 'error' AND time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= m),
  x AS (SELECT alarm_id, a.cell_id, change_id, param, date_diff('microsecond', time, ts) // 1000000 AS age_seconds FROM a LEFT JOIN changes c
    ON a.cell_id = c.cell_id AND c.time <= a.ts AND c.time >= a.ts - INTERVAL 6 HOUR
    QUALIFY row_number() OVER (PARTITION BY alarm_id ORDER BY time DESC NULLS LAST, change_id DESC) = 1)
  SELECT * FROM x""")
def last_change(spark, sf):
    """Every alarm of a closed slot with the last change of its cell in the six hours before."""
    names = F.array(*[F.lit(p) for p, _, _ in net.rules.CONFIG_BASELINE])
    changes = stream(spark, sf).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("change_id"), "cell_id", F.get(names, F.col("k") % 12).alias("param"), F.col("ts").alias("time"))
    return jobs.run_available(stateful.last_change_stream(changes, _alarms(spark, sf)))
