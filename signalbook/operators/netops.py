"""Topology, key figures, alarms, configuration and their correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.network import is_degraded, normalize_ids
from signalbook.operators.scans import running


# --- topology --------------------------------------------------------------------------------
def expand_sectors(sites: DataFrame, n: int = 3) -> DataFrame:
    """One row per sector with id ``site-Sn`` and azimuth every 120 degrees."""
    rows = sites.withColumn("sector", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.withColumns({
        "cell_id": F.concat("site_id", F.lit("-S"), F.col("sector").cast("string")),
        "azimuth": (F.col("sector") - 1) * 120,
    })


def cells(df: DataFrame, site: str | None = None, region: str | None = None) -> DataFrame:
    if site:
        df = df.filter(F.col("site_id") == site)
    return df.filter(F.lower("region") == region.lower()) if region else df


def resolve_cells(requests: DataFrame, all_cells: DataFrame) -> DataFrame:
    """Cells of every request (req_id, cell_id, site_id, region): by cell, else site, else region.

    A request without any id gets one row with cell ``*``, meaning every cell. Unknown ids give one
    row with ``error`` set.
    """
    ids = all_cells.select(F.explode(F.array(
        F.struct(F.col("cell_id").alias("cell"), F.lit(True).alias("is_cell")),
        F.struct(F.col("site_id").alias("cell"), F.lit(False).alias("is_cell")))).alias("x")).select("x.*")
    known = ids.groupBy(F.col("cell").alias("_cell")).agg(F.bool_or("is_cell").alias("_known_cell"), F.lit(True).alias("_known"))
    trimmed = requests.withColumn("_cell", F.trim("cell_id"))
    looked = trimmed.join(known, "_cell", "left")
    fixed = normalize_ids(
        F.col("cell_id"), F.col("site_id"), F.coalesce("_known_cell", F.lit(False)),
        F.coalesce(F.col("_known") & ~F.col("_known_cell"), F.lit(False)))
    wanted = looked.withColumn("_id", fixed).select(
        "req_id",
        F.when(F.col("_id.cell_id").isNotNull(), "cell").when(F.col("_id.site_id").isNotNull(), "site")
        .when(F.coalesce("region", F.lit("")) != "", "region").otherwise("all").alias("level"),
        F.coalesce("_id.cell_id", "_id.site_id", F.col("region")).alias("asked"),
    ).withColumn("value", F.when(F.col("level") == "region", F.lower("asked")).otherwise(F.col("asked")))
    scopes = all_cells.select("cell_id", F.explode(F.array(
        F.struct(F.lit("cell").alias("level"), F.col("cell_id").alias("value")),
        F.struct(F.lit("site").alias("level"), F.col("site_id").alias("value")),
        F.struct(F.lit("region").alias("level"), F.lower("region").alias("value")))).alias("s")).select("cell_id", "s.*")
    hits = wanted.join(scopes, ["level", "value"], "left")
    label = F.when(F.col("level") == "region", "region").otherwise(F.concat("level", F.lit("_id")))
    error = F.when(
        (F.col("level") != "all") & F.col("cell_id").isNull(),
        F.concat(F.lit("Unknown "), label, F.lit(": '"), "asked", F.lit("'")))
    return hits.select(
        "req_id", "level", F.when(F.col("level") == "all", "*").otherwise(F.col("cell_id")).alias("cell_id"), error.alias("error"))


# --- key figures -----------------------------------------------------------------------------
def flag_anomalies(kpi: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Anomaly type and severity of samples whose hour lies in [start_hour, end_hour] of their cell.
    Intervals that end before they start flag nothing.

    An interval covers at most 24 hours of day, so it is unrolled into hours: the range join becomes
    an equi-join on (cell, hour) with at most one partner per row.
    """
    hours = anomalies.filter("start_hour <= end_hour").withColumn("hour", F.explode(F.sequence("start_hour", "end_hour")))
    one = hours.groupBy("cell_id", "hour").agg(F.min(F.struct("severity", "type")).alias("_a"))
    return kpi.join(one, ["cell_id", "hour"], "left").select(
        *kpi.columns, F.col("_a.type").alias("anomaly"), F.col("_a.severity").alias("anomaly_severity"))


def kpi_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(is_degraded(F.col("status"))).alias("degraded"))


def kpi_hourly(kpi: DataFrame, metric: str = "value") -> DataFrame:
    """Mean and count of a metric per cell and hour; partial sums make hot cells cheap."""
    return kpi.groupBy("cell_id", F.date_trunc("hour", "ts").alias("hour_ts")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean_value"))


def kpi_trend(kpi: DataFrame, all_cells: DataFrame, now: Column, hours: int = 24, metric: str = "value") -> DataFrame:
    """The last ``hours`` hours of every cell in order, gaps included, with the change per hour."""
    end = F.date_trunc("hour", now)
    start = end - F.make_interval(hours=F.lit(hours - 1))
    spine = all_cells.select("cell_id").withColumn("hour_ts", F.explode(F.sequence(start, end, F.expr("interval 1 hour"))))
    recent = kpi_hourly(kpi.filter((F.col("ts") >= start) & (F.col("ts") < end + F.make_interval(hours=F.lit(1)))), metric)
    filled = spine.join(recent, ["cell_id", "hour_ts"], "left")
    w = W.partitionBy("cell_id").orderBy("hour_ts")  # at most ``hours`` rows
    return filled.select(
        "cell_id", "hour_ts", F.hour("hour_ts").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"), "mean_value",
        (F.col("mean_value") - F.lag("mean_value").over(w)).alias("change"))


def impact(df: DataFrame, by: list[str]) -> DataFrame:
    """Degraded cells and sites, users on them and samples beyond a limit, per group."""
    bad = is_degraded(F.col("status"))
    beyond = (F.col("erab_drop_rate_pct") > 2) | (F.col("rrc_setup_success_pct") < 95) | (F.col("sinr_avg_db") < 5)
    # One row per cell first, so that the distinct counts work on cells instead of samples.
    cells = df.groupBy(*dict.fromkeys([*by, "cell_id", "site_id"])).agg(
        F.count_if(bad).alias("_bad"),
        F.sum(F.when(bad, F.col("connected_ues")).otherwise(0)).alias("_users"),
        F.count_if(bad & beyond).alias("_beyond"))
    hit = F.col("_bad") > 0
    return cells.groupBy(*by).agg(
        F.count_distinct(F.when(hit, F.col("cell_id"))).alias("cells_affected"),
        F.sum("_users").cast("long").alias("users_affected"),
        F.sum("_beyond").alias("kpis_beyond"),
        F.count_distinct(F.when(hit, F.col("site_id"))).alias("sites_affected"))


# --- alarms ----------------------------------------------------------------------------------
def alarms(df: DataFrame, cell=None, site=None, severity=None, status=None) -> DataFrame:
    if cell:
        df = df.filter(F.col("affected_element") == cell)
    if site:
        df = df.filter(F.col("site_id") == site)
    for column, value in (("severity", severity), ("status", status)):
        if value:
            df = df.filter(F.lower(column) == value.lower())
    return df


def alarms_in_region(df: DataFrame, sites: DataFrame, region: str) -> DataFrame:
    return df.join(sites.filter(F.lower("region") == region.lower()).select("site_id"), "site_id", "left_semi")


def alarm_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ACTIVE").alias("active"))


def inventory(sites: DataFrame, all_cells: DataFrame, alarm_rows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row of totals, each a scalar subquery."""
    count = F.count(F.lit(1))
    return all_cells.agg(count.alias("cells")).select(
        "cells", sites.agg(count).scalar().alias("sites"),
        alarm_rows.agg(F.count_if(F.col("status") == "ACTIVE")).scalar().alias("active_alarms"),
        anomalies.agg(F.count_distinct("cell_id")).scalar().alias("anomalous_cells"))


# --- configuration ---------------------------------------------------------------------------
def baseline(spark) -> DataFrame:
    return spark.createDataFrame(rules.CONFIG_BASELINE, "param string, value string, standard string")


def overrides(changes: DataFrame, key: str = "cell_id") -> DataFrame:
    """Latest new value per key and parameter."""
    return changes.groupBy(key, "param").agg(F.max_by("new", F.struct("time", "change_id")).alias("override"))


def config_view(all_cells: DataFrame, base: list[tuple], changes: DataFrame) -> DataFrame:
    """Every parameter of every cell with baseline, standard and latest override, in long form."""
    rows = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(v).alias("value"), F.lit(s).alias("standard")) for p, v, s in base])
    view = all_cells.select("cell_id", F.inline(rows))
    return view.join(overrides(changes), ["cell_id", "param"], "left")


def override_map(changes: DataFrame) -> DataFrame:
    """Overrides of a cell as one map; its size is bounded by the number of parameters."""
    entry = F.struct("param", "override")
    return overrides(changes).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(entry)).alias("overrides"))


def changes_for_sites(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """Changes whose cell id is the site or one of its sectors; ``X-1`` does not catch ``X-10``."""
    keyed = changes.withColumn("site_id", F.regexp_replace("cell_id", r"-S\d+$", ""))
    return keyed.join(sites.select("site_id"), "site_id", "left_semi")


NUMBER = r"(-?\d+(?:\.\d+)?)"


def config_deviation(value: Column, standard: Column) -> Column:
    """True outside the ``lo-hi`` / ``lo to hi`` range or the ``a / b`` list; null if not comparable."""

    def number(c, pattern, group):
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("double")

    span = rf"^{NUMBER}(?: to |-){NUMBER}"
    low, high, v = number(standard, span, 1), number(standard, span, 2), number(value, "^" + NUMBER, 1)
    named = standard.contains(" / ")
    return F.when(named, ~F.array_contains(F.split(standard, " / "), value)).otherwise(~v.between(low, high))


# --- correlation -----------------------------------------------------------------------------
def correlate_changes(alarm_rows: DataFrame, changes: DataFrame, within_seconds: int) -> DataFrame:
    """Latest change on the alarm's cell at most ``within_seconds`` before it was raised.

    Both tables are merged into one time line per cell and the last change is carried forward, in
    hour buckets: no pairs of alarms and changes are formed, and a busy cell is spread over its hours.
    """
    line = alarm_rows.select(
        F.col("affected_element").alias("cell"), F.col("raised_time").alias("at"), F.lit(1).alias("kind"), "alarm_id",
        F.lit(None).cast("struct<time:timestamp_ntz,param:string,change_id:bigint>").alias("change"),
        F.col("event_id").alias("seq"),
    ).unionByName(changes.select(
        F.col("cell_id").alias("cell"), F.col("time").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("alarm_id"),
        F.struct("time", "param", "change_id").alias("change"), F.col("change_id").alias("seq")))
    carried = running(line, ["cell"], ["at", "kind", "seq"], F.date_trunc("hour", "at"), lasts={"last_change": F.col("change")})
    age = F.timestamp_diff("MICROSECOND", F.col("last_change.time"), F.col("at"))
    return carried.filter((F.col("kind") == 1) & (age <= within_seconds * 1_000_000)).select(
        "alarm_id", "cell", "last_change.change_id", "last_change.param", age.alias("_age")
    ).withColumn("age_seconds", F.floor(F.col("_age") / 1_000_000).cast("long")).drop("_age")


def correlate_kpi(alarm_rows: DataFrame, kpi: DataFrame, metric: str = "value") -> DataFrame:
    """Alarms with the hourly key figure of their cell; hourly rows make it many-to-one."""
    hourly = kpi_hourly(kpi, metric)
    keyed = alarm_rows.withColumns({"cell_id": F.col("affected_element"), "hour_ts": F.date_trunc("hour", "raised_time")})
    return keyed.join(hourly, ["cell_id", "hour_ts"])
