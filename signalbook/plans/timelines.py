"""Queries of the batch twins of the streaming jobs and of ranges over event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbook.operators import sketches, timeline
from signalbook.plans import network as net
from signalbook.plans.catalog import query
from signalbook.plans.network import NET_SQL, TS


def _shown(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _errors(spark, sf):
    return net.events(spark, sf).filter("event_type = 'error'").select("cell_id", F.col("ts").alias("raised_time"))


SESSIONS_SQL = """e AS (SELECT cell_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ev
    WHERE event_type = 'error' WINDOW w AS (PARTITION BY cell_id ORDER BY ts, event_id)),
  s AS (SELECT cell_id, ts, sum(new) OVER (PARTITION BY cell_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)"""


@query("t3_sessions_batch", f"""WITH {NET_SQL}, {SESSIONS_SQL}
  SELECT cell_id, {TS.format('min(ts)')} AS start, {TS.format('max(ts)')} AS "end", count(*) AS alarms FROM s GROUP BY cell_id, sid""")
def sessions(spark, sf):
    return timeline.alarm_sessions(_errors(spark, sf)).select("cell_id", _shown("start").alias("start"), _shown("end").alias("end"), "alarms")


@query("t2_sliding_batch", f"""WITH {NET_SQL}, x AS (SELECT cell_id, value > 60 AS bad, date_trunc('hour', ts) - to_hours(o::INT) AS s FROM ev, range(3) t(o)),
  g AS (SELECT cell_id, s, count(*) AS n, count_if(bad)::BIGINT AS degraded FROM x GROUP BY ALL)
  SELECT cell_id, {TS.format('s')} AS start, {TS.format('s + INTERVAL 3 HOUR')} AS "end", n, degraded FROM g WHERE degraded / n >= 0.5""")
def sliding(spark, sf):
    samples = net.events(spark, sf).select("cell_id", "ts", F.when(F.col("value") > 60, "DEGRADED").otherwise("NORMAL").alias("status"))
    found = timeline.sliding_degradation(samples)
    return found.select("cell_id", _shown("start").alias("start"), _shown("end").alias("end"), "n", "degraded")


@query("w10_recent_load", f"""WITH {NET_SQL}
  SELECT event_id, count(*) OVER w AS events_before, sum((event_type = 'error')::INT) OVER w::BIGINT AS errors_before,
    CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) OVER w AS DOUBLE) AS value_before
  FROM ev WINDOW w AS (PARTITION BY cell_id ORDER BY epoch_us(ts) RANGE BETWEEN 10799999999 PRECEDING AND CURRENT ROW)""")
def recent_load(spark, sf):
    """Events, errors and values of a cell in the three hours up to each event."""
    e = net.events(spark, sf).withColumn("amount", F.round("value", 2).cast("decimal(18,2)"))
    found = timeline.range_sums(e, ["cell_id"], "ts", 3 * 3600, {
        "events_before": F.lit(1), "errors_before": (F.col("event_type") == "error").cast("int"), "value_before": F.col("amount")})
    return found.select("event_id", "events_before", "errors_before", F.col("value_before").cast("double").alias("value_before"))


@query("g16_quantile_states", f"""WITH {NET_SQL}
  SELECT cell_id, count(*) AS n, min(value) AS least, max(value) AS most, true AS median_in_bound, true AS p90_in_bound FROM ev GROUP BY cell_id""")
def quantile_states(spark, sf):
    """Hourly states merged per cell; whether the ranks of the quantiles are inside three times the stated error."""
    e = net.events(spark, sf).withColumn("hour_ts", F.date_trunc("hour", "ts"))
    hourly = sketches.quantile_states(e, "value", ["cell_id", "hour_ts"], 200)
    found = sketches.quantiles(sketches.merge_states(hourly, ["cell_id"], 200), {"median": 0.5, "p90": 0.9}, 200)
    # The true ranks: shares of the values below, and at or below.
    ranks = [F.count_if(F.col("value") < F.col(q)).alias(f"{q}_low") for q in ("median", "p90")] + [F.count_if(F.col("value") <= F.col(q)).alias(f"{q}_high") for q in ("median", "p90")]
    checked = e.select("cell_id", "value").join(found, "cell_id").groupBy("cell_id", "n", "least", "most", "rank_error").agg(*ranks)
    inside = {q: (F.col(f"{q}_low") <= (s + 3 * F.col("rank_error")) * F.col("n") + 1) & (F.col(f"{q}_high") >= (s - 3 * F.col("rank_error")) * F.col("n") - 1)
              for q, s in (("median", 0.5), ("p90", 0.9))}
    return checked.select("cell_id", "n", "least", "most", *[c.alias(f"{q}_in_bound") for q, c in inside.items()])
