"""Network-operations queries over topology, key figures, alarms and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions import entities as ent
from signalbook.functions import network as net
from signalbook.functions.text import stable_hash
from signalbook.operators import evidence, netops
from signalbook.operators.scans import running
from signalbook.plans.catalog import query, table
from signalbook.plans.fixtures import sql_text

ANOMALIES = [
    ("SITE-NATION-1-S2", "interference", 8, 22, "major"),
    ("SITE-NATION-5-S1", "backhaul_degradation", 0, 23, "major"),
    ("SITE-NATION-10-S3", "hw_fault", 0, 23, "critical"),
    ("SITE-NATION-17-S1", "congestion", 10, 21, "major"),
]
ALARM_TYPES = ["UL_INTERFERENCE_HIGH", "HIGH_BLER", "S1_LINK_DOWN", "VSWR_HIGH", "CPU_OVERLOAD"]
# metric -> (factor, offset) applied to the event value
METRICS = {
    "dl_throughput_mbps": (1.0, -5.0), "prb_utilization_dl_pct": (0.8, 0.0), "sinr_avg_db": (-0.1, 20.0),
    "connected_ues": (3.0, 0.0), "erab_drop_rate_pct": (0.016, 0.0), "rrc_setup_success_pct": (-0.03, 100.5),
    "ul_interference_dbm": (0.2, -115.0),
}


def sites(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("SITE-"), F.replace("n_name", F.lit("_"), F.lit("-"))).alias("site_id"), F.col("r_name").alias("region"))


def cells(spark, sf):
    return netops.expand_sectors(sites(spark, sf))


def _cell(user):
    k = user % 75
    return F.concat(F.lit("SITE-NATION-"), F.floor(k / 3).cast("string"), F.lit("-S"), (k % 3 + 1).cast("string"))


def events(spark, sf):
    e = table(spark, sf, "events")
    cell = _cell(F.col("user_id"))
    return e.withColumns({
        "cell_id": cell, "site_id": F.regexp_replace(cell, r"-S\d$", ""),
        "k": F.get_json_object("props", "$.k").cast("int")})


def kpi(spark, sf):
    e = events(spark, sf)
    # Only counts are rounded here; the other metrics are compared before presentation rounding.
    metrics = {m: net.clamp_kpi(m, F.col("value") * F.lit(f) + F.lit(o), digits=net.KPI_LIMITS[m][2] == 0) for m, (f, o) in METRICS.items()}
    return e.select("event_id", "cell_id", "site_id", "ts", F.hour("ts").alias("hour"), "value", *[v.alias(m) for m, v in metrics.items()])


def anomalies(spark):
    return spark.createDataFrame(ANOMALIES, "cell_id string, type string, start_hour int, end_hour int, severity string")


def kpi_with_status(spark, sf):
    flagged = netops.flag_anomalies(kpi(spark, sf), anomalies(spark))
    status = net.kpi_status(F.col("erab_drop_rate_pct"), F.col("rrc_setup_success_pct"), F.col("sinr_avg_db"), F.col("anomaly_severity"))
    return flagged.withColumn("status", status)


def alarms(spark, sf):
    """Error events raise alarms; the next other event of the cell clears them."""
    e = events(spark, sf).withColumns({"_back": -F.unix_micros(F.col("ts").cast("timestamp")), "_id": -F.col("event_id")})
    later = F.when(F.col("event_type") != "error", F.col("ts"))
    hour = F.floor(F.col("_back") / 3_600_000_000)
    e = running(e, ["cell_id"], ["_back", "_id"], hour, lasts={"cleared_time": later})
    kinds = F.array(*[F.lit(t) for t in ALARM_TYPES])
    kind = F.get(kinds, F.col("k") % 5)
    return e.filter(F.col("event_type") == "error").select(
        F.concat(F.lit("ALM-"), F.col("event_id").cast("string")).alias("alarm_id"), "event_id", kind.alias("type"),
        F.when(F.col("value") > 100, "Critical").when(F.col("value") > 40, "Major").otherwise("Minor").alias("severity"),
        F.col("cell_id").alias("affected_element"), "site_id", F.col("ts").alias("raised_time"), "cleared_time",
        F.when(F.col("cleared_time").isNull(), "ACTIVE").otherwise("CLEARED").alias("status"),
        F.concat(F.lit("Raised by user "), F.col("user_id").cast("string")).alias("description"))


def changes(spark, sf):
    names = F.array(*[F.lit(p) for p, _, _ in rules.CONFIG_BASELINE])
    olds = F.array(*[F.lit(v) for _, v, _ in rules.CONFIG_BASELINE])
    at = F.col("k") % 12
    return events(spark, sf).filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("change_id"), "cell_id", F.get(names, at).alias("param"), F.get(olds, at).alias("old"),
        F.concat(F.floor("value").cast("string"), F.lit(" units")).alias("new"),
        F.concat(F.lit("user_"), (F.col("user_id") % 4).cast("string")).alias("changed_by"), F.col("ts").alias("time"),
        F.when(F.col("k") % 3 == 0, "test").alias("reason"))


def _list(xs):
    return "[" + ", ".join(sql_text(x) for x in xs) + "]"


def _metric_sql(m):
    f, o = METRICS[m]
    low, high, scale = net.KPI_LIMITS[m]
    x = f"(value * {f}::DOUBLE + {o}::DOUBLE)"
    if high is not None:
        x = f"least({x}, {high}::DOUBLE)"
    if low is not None:
        x = f"greatest({x}, {low}::DOUBLE)"
    return f"round({x}, 0) AS {m}" if scale == 0 else f"{x} AS {m}"


NET_SQL = f"""
sites AS (SELECT 'SITE-' || replace(n_name, '_', '-') AS site_id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
cells AS (SELECT site_id, region, s::INT AS sector, site_id || '-S' || s AS cell_id, ((s - 1) * 120)::INT AS azimuth FROM sites, range(1, 4) t(s)),
ev AS (SELECT *, 'SITE-NATION-' || (user_id % 75) // 3 || '-S' || (user_id % 75 % 3 + 1) AS cell_id, 'SITE-NATION-' || (user_id % 75) // 3 AS site_id,
  CAST(props->>'$.k' AS INT) AS k FROM events),
kpi AS (SELECT event_id, cell_id, site_id, ts, hour(ts)::INT AS hour, value, {', '.join(_metric_sql(m) for m in METRICS)} FROM ev),
anomalies(cell_id, type, start_hour, end_hour, severity) AS (VALUES {', '.join(str(a) for a in ANOMALIES)}),
flagged AS (SELECT kpi.*, a.type AS anomaly, a.severity AS anomaly_severity FROM kpi LEFT JOIN anomalies a ON kpi.cell_id = a.cell_id AND hour BETWEEN start_hour AND end_hour),
st AS (SELECT *, CASE WHEN anomaly_severity = 'major' THEN 'DEGRADED' WHEN anomaly_severity IS NOT NULL THEN 'CRITICAL'
  WHEN erab_drop_rate_pct > 2 OR rrc_setup_success_pct < 95 OR sinr_avg_db < 5 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM flagged),
ev2 AS (SELECT *, min(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY cell_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cleared_time FROM ev),
alarms AS (SELECT 'ALM-' || event_id AS alarm_id, event_id, ({_list(ALARM_TYPES)})[k % 5 + 1] AS type, CASE WHEN value > 100 THEN 'Critical' WHEN value > 40 THEN 'Major' ELSE 'Minor' END AS severity,
  cell_id AS affected_element, site_id, ts AS raised_time, cleared_time, CASE WHEN cleared_time IS NULL THEN 'ACTIVE' ELSE 'CLEARED' END AS status,
  'Raised by user ' || user_id AS description FROM ev2 WHERE event_type = 'error'),
changes AS (SELECT event_id AS change_id, cell_id, ({_list([p for p, _, _ in rules.CONFIG_BASELINE])})[k % 12 + 1] AS param, ({_list([v for _, v, _ in rules.CONFIG_BASELINE])})[k % 12 + 1] AS old,
  floor(value)::BIGINT || ' units' AS new, 'user_' || user_id % 4 AS changed_by, ts AS time, CASE WHEN k % 3 = 0 THEN 'test' END AS reason FROM ev WHERE event_type = 'purchase')"""
W = f"WITH {NET_SQL}"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- topology and key figures -----------------------------------------------------------------
@query("c7_expand_sectors", f"{W} SELECT cell_id, site_id, region, sector, azimuth FROM cells")
def expand(spark, sf):
    return cells(spark, sf).select("cell_id", "site_id", "region", "sector", "azimuth")


@query("b9_cells_of_region", f"{W} SELECT cell_id, count(*) OVER () AS n FROM cells WHERE lower(region) = 'asia'")
def region_cells(spark, sf):
    found = netops.cells(cells(spark, sf), region="Asia")
    return found.select("cell_id", found.agg(F.count(F.lit(1))).scalar().alias("n"))


@query("f27_clamp_kpi", f"{W} SELECT event_id, cell_id, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM kpi")
def clamp(spark, sf):
    return kpi(spark, sf).select("event_id", "cell_id", *[F.round(m, 6).alias(m) for m in METRICS])


@query("c8_flag_anomalies", f"{W} SELECT event_id, hour, anomaly, anomaly_severity FROM flagged")
def flag(spark, sf):
    return netops.flag_anomalies(kpi(spark, sf), anomalies(spark)).select("event_id", "hour", "anomaly", "anomaly_severity")


@query("f28_kpi_status", f"{W} SELECT event_id, status FROM st")
def status(spark, sf):
    return kpi_with_status(spark, sf).select("event_id", "status")


@query("f29_stable_hash", f"{W} SELECT event_id, ('0x' || substr(md5(cell_id || '-' || hour || '-' || day(ts)), 1, 8))::BIGINT AS seed FROM kpi")
def seed(spark, sf):
    return kpi(spark, sf).select("event_id", stable_hash(F.col("cell_id"), F.col("hour"), F.day("ts")).alias("seed"))


@query("f30_diurnal_residual", f"""{W}, h AS (SELECT CAST(ts AS DATE) AS day, hour, count(*) AS n FROM kpi GROUP BY ALL), p AS (SELECT hour, avg(n) AS expected FROM h GROUP BY hour)
  SELECT strftime(day, '%Y-%m-%d') AS day, hour, n, round(expected, 6) AS expected, round(n - expected, 6) AS residual FROM h JOIN p USING (hour)""")
def diurnal(spark, sf):
    """Samples of every hour against the mean of that hour of day."""
    h = kpi(spark, sf).groupBy(F.to_date("ts").alias("day"), "hour").agg(F.count(F.lit(1)).alias("n"))
    expected = h.groupBy("hour").agg(F.avg("n").alias("expected"))  # 24 rows
    return h.join(F.broadcast(expected), "hour").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "hour", "n", F.round("expected", 6).alias("expected"), F.round(F.col("n") - F.col("expected"), 6).alias("residual"))


@query("g16_kpi_summary", f"{W} SELECT region, hour, count(*) AS cells, count_if(status IN ('DEGRADED','CRITICAL'))::BIGINT AS degraded FROM st JOIN sites USING (site_id) GROUP BY ALL")
def summary(spark, sf):
    rows = kpi_with_status(spark, sf).join(sites(spark, sf), "site_id")
    return netops.kpi_summary(rows, ["region", "hour"])


@query("g18_impact", f"""{W} SELECT region, count(DISTINCT CASE WHEN status IN ('DEGRADED','CRITICAL') THEN cell_id END) AS cells_affected,
  sum(CASE WHEN status IN ('DEGRADED','CRITICAL') THEN connected_ues ELSE 0 END)::BIGINT AS users_affected,
  count_if(status IN ('DEGRADED','CRITICAL') AND (erab_drop_rate_pct > 2 OR rrc_setup_success_pct < 95 OR sinr_avg_db < 5))::BIGINT AS kpis_beyond,
  count(DISTINCT CASE WHEN status IN ('DEGRADED','CRITICAL') THEN site_id END) AS sites_affected FROM st JOIN sites USING (site_id) GROUP BY region""")
def impact(spark, sf):
    return netops.impact(kpi_with_status(spark, sf).join(sites(spark, sf), "site_id"), ["region"])


@query("w10_kpi_trend", f"""{W}, nw AS (SELECT date_trunc('hour', max(ts)) AS h FROM kpi),
sp AS (SELECT cell_id, unnest(range(h - INTERVAL 23 HOUR, h + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour_ts FROM cells, nw),
hr AS (SELECT cell_id, date_trunc('hour', ts) AS hour_ts, count(*) AS n, avg(value) AS m FROM kpi GROUP BY ALL),
j AS (SELECT sp.cell_id, sp.hour_ts, coalesce(n, 0) AS n, m FROM sp LEFT JOIN hr USING (cell_id, hour_ts))
  SELECT cell_id, {TS.format('hour_ts')} AS hour_ts, hour(hour_ts)::INT AS hour, n, round(m, 6) AS mean_value, round(m - lag(m) OVER (PARTITION BY cell_id ORDER BY j.hour_ts), 6) AS change FROM j""")
def trend(spark, sf):
    k = kpi(spark, sf)
    out = netops.kpi_trend(k, cells(spark, sf), k.agg(F.max("ts")).scalar(), 24)
    return out.select("cell_id", _ts("hour_ts").alias("hour_ts"), "hour", "n", F.round("mean_value", 6).alias("mean_value"), F.round("change", 6).alias("change"))


# --- alarms ----------------------------------------------------------------------------------
@query("b10_alarm_filters", f"{W} SELECT alarm_id, type, severity, {TS.format('raised_time')} AS raised, {TS.format('cleared_time')} AS cleared FROM alarms WHERE lower(severity) = 'major' AND lower(status) = 'cleared'")
def alarm_filter(spark, sf):
    a = netops.alarms(alarms(spark, sf), severity="MAJOR", status="cleared")
    return a.select("alarm_id", "type", "severity", _ts("raised_time").alias("raised"), _ts("cleared_time").alias("cleared"))


@query("b10_alarm_summary", f"{W} SELECT site_id, severity, count(*) AS total, count_if(status = 'ACTIVE')::BIGINT AS active FROM alarms GROUP BY ALL")
def alarm_sum(spark, sf):
    return netops.alarm_summary(alarms(spark, sf), ["site_id", "severity"])


@query("c5_alarms_in_region", f"{W} SELECT alarm_id, site_id FROM alarms WHERE site_id IN (SELECT site_id FROM sites WHERE lower(region) = 'europe')")
def in_region(spark, sf):
    return netops.alarms_in_region(alarms(spark, sf), sites(spark, sf), "Europe").select("alarm_id", "site_id")


@query("g17_inventory", f"{W} SELECT (SELECT count(*) FROM cells) AS cells, (SELECT count(*) FROM sites) AS sites, (SELECT count(*) FROM alarms WHERE status = 'ACTIVE') AS active_alarms, (SELECT count(DISTINCT cell_id) FROM anomalies) AS anomalous_cells")
def inventory(spark, sf):
    return netops.inventory(sites(spark, sf), cells(spark, sf), alarms(spark, sf), anomalies(spark))


# --- configuration ---------------------------------------------------------------------------
_BASELINE = "bl(param, value, standard) AS (VALUES " + ", ".join(str(b) for b in rules.CONFIG_BASELINE) + ")"
_OVER = "ov AS (SELECT cell_id, param, arg_max(new, (time, change_id)) AS override FROM changes GROUP BY ALL)"


@query("c9_config_view", f"{W}, {_BASELINE}, {_OVER} SELECT cell_id, param, value, standard, override FROM cells, bl LEFT JOIN ov USING (cell_id, param)".replace("FROM cells, bl", "FROM (SELECT * FROM cells, bl) x"))
def config_view(spark, sf):
    return netops.config_view(cells(spark, sf), rules.CONFIG_BASELINE, changes(spark, sf)).select("cell_id", "param", "value", "standard", "override")


@query("c9_override_map", f"{W}, {_OVER} SELECT cell_id, string_agg(param || '=' || override, '; ' ORDER BY param) AS overrides FROM ov GROUP BY cell_id")
def override_map(spark, sf):
    m = netops.override_map(changes(spark, sf))
    shown = F.transform(F.array_sort(F.map_entries("overrides")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select("cell_id", F.array_join(shown, "; ").alias("overrides"))


@query("c10_changes_for_sites", f"{W} SELECT change_id, cell_id FROM changes WHERE regexp_replace(cell_id, '-S[0-9]+$', '') IN (SELECT site_id FROM sites WHERE region = 'AFRICA')")
def site_changes(spark, sf):
    return netops.changes_for_sites(changes(spark, sf), sites(spark, sf).filter("region = 'AFRICA'")).select("change_id", "cell_id")


_N = r"(-?\d+(?:\.\d+)?)"
_SPAN = rf"^{_N}(?: to |-){_N}"


@query("c11_config_deviation", rf"""{W}, {_BASELINE}, j AS (SELECT change_id, changes.param, new, standard FROM changes JOIN bl USING (param))
  SELECT change_id, param, new, standard, CASE WHEN contains(standard, ' / ') THEN NOT list_contains(string_split(standard, ' / '), new)
  ELSE NOT (TRY_CAST(regexp_extract(new, '^{_N}', 1) AS DOUBLE) BETWEEN TRY_CAST(regexp_extract(standard, '{_SPAN}', 1) AS DOUBLE) AND TRY_CAST(regexp_extract(standard, '{_SPAN}', 2) AS DOUBLE)) END AS deviates FROM j""")
def deviation(spark, sf):
    j = changes(spark, sf).join(netops.baseline(spark), "param")
    return j.select("change_id", "param", "new", "standard", netops.config_deviation(F.col("new"), F.col("standard")).alias("deviates"))


# --- correlation -----------------------------------------------------------------------------
@query("c12_correlate_changes", f"""{W}, a AS (SELECT alarm_id, affected_element AS cell, raised_time, change_id, param, time FROM alarms ASOF JOIN changes ON affected_element = cell_id AND raised_time >= time)
  SELECT alarm_id, cell, change_id, param, (epoch_us(raised_time) - epoch_us(time)) // 1000000 AS age_seconds FROM a WHERE epoch_us(raised_time) - epoch_us(time) <= 86400000000""")
def correlate(spark, sf):
    return netops.correlate_changes(alarms(spark, sf), changes(spark, sf), 86400)


@query("c13_correlate_kpi", f"""{W}, hr AS (SELECT cell_id, date_trunc('hour', ts) AS h, count(*) AS n, avg(value) AS m FROM kpi GROUP BY ALL)
  SELECT alarm_id, n, round(m, 6) AS mean_value FROM alarms JOIN hr ON affected_element = cell_id AND date_trunc('hour', raised_time) = h""")
def correlate_kpi(spark, sf):
    return netops.correlate_kpi(alarms(spark, sf), kpi(spark, sf)).select("alarm_id", "n", F.round("mean_value", 6).alias("mean_value"))


_TAGS = """list_filter([CASE WHEN d AND prb_utilization_dl_pct > 80 THEN 'PRB congestion capacity management' END,
  CASE WHEN d AND sinr_avg_db < 5 THEN 'interference management SINR degradation' END, CASE WHEN d AND erab_drop_rate_pct > 1 THEN 'ERAB drop bearer release procedure' END,
  CASE WHEN d AND rrc_setup_success_pct < 95 THEN 'RRC connection setup failure' END, CASE WHEN d AND ul_interference_dbm > -100 THEN 'uplink interference detection mitigation' END,
  CASE WHEN contains(type, 'INTERFERENCE') THEN '3GPP interference management procedure' WHEN contains(type, 'S1') OR contains(type, 'LINK') THEN 'S1 interface failure recovery procedure'
  WHEN contains(type, 'VSWR') THEN 'antenna fault detection VSWR' WHEN contains(type, 'CPU') THEN 'eNodeB overload control' END], lambda x: x IS NOT NULL)"""


@query("f33_issue_tags", f"""{W}, x AS (SELECT event_id, alarm_id, description, status = 'DEGRADED' AS d, type, prb_utilization_dl_pct, sinr_avg_db, erab_drop_rate_pct, rrc_setup_success_pct, ul_interference_dbm
    FROM (SELECT alarm_id, event_id, type, description FROM alarms) JOIN st USING (event_id)), t AS (SELECT alarm_id, description, {_TAGS} AS tags FROM x)
  SELECT alarm_id, CASE WHEN len(tags) = 0 THEN '3GPP procedure for ' || description ELSE array_to_string(tags[1:3], ' ') END AS search FROM t""")
def tags(spark, sf):
    a = alarms(spark, sf).select("alarm_id", "event_id", "type", "description")
    j = a.join(kpi_with_status(spark, sf), "event_id")
    c = F.col
    text = net.issue_tags(c("status"), c("prb_utilization_dl_pct"), c("sinr_avg_db"), c("erab_drop_rate_pct"), c("rrc_setup_success_pct"), c("ul_interference_dbm"), c("type"), c("description"))
    return j.select("alarm_id", text.alias("search"))


# An investigation: the key figures and alarms of a site in an hour.
@query("f33_investigation_tags", f"""{W}, k AS (SELECT site_id, date_trunc('hour', ts) AS h, event_id, NULL AS type, status = 'DEGRADED' AS d, prb_utilization_dl_pct, sinr_avg_db, erab_drop_rate_pct, rrc_setup_success_pct, ul_interference_dbm FROM st),
  x AS (SELECT site_id, h, 0 AS tool, event_id, {_TAGS} AS tags FROM k UNION ALL
    SELECT site_id, date_trunc('hour', raised_time), 1, event_id, {_TAGS} FROM (SELECT *, false AS d, 0 AS prb_utilization_dl_pct, 0 AS sinr_avg_db, 0 AS erab_drop_rate_pct, 0 AS rrc_setup_success_pct, 0 AS ul_interference_dbm FROM alarms)),
  t AS (SELECT site_id, h, list({{'tool': tool, 'e': event_id, 'i': i, 'tag': tags[i]}} ORDER BY tool, event_id, i) AS l FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM x) GROUP BY ALL),
  inv AS (SELECT DISTINCT site_id, h FROM x)
  SELECT site_id || ' ' || {TS.format('h')} AS inv_id, CASE WHEN l IS NULL THEN '3GPP procedure for ' || site_id ELSE array_to_string(list_transform(l[1:3], lambda y: y.tag), ' ') END AS search
  FROM inv LEFT JOIN t USING (site_id, h)""")
def investigation_tags(spark, sf):
    c = F.col
    inv = lambda at: F.concat(c("site_id"), F.lit(" "), _ts(F.date_trunc("hour", at)))
    samples = kpi_with_status(spark, sf).withColumn("inv_id", inv("ts")).withColumnRenamed("event_id", "seq")
    raised = alarms(spark, sf).withColumn("inv_id", inv("raised_time")).withColumnRenamed("event_id", "seq")
    asked = samples.select("inv_id", F.col("site_id").alias("query")).union(raised.select("inv_id", "site_id")).distinct()
    return evidence.investigation_search(asked, samples, raised)


@query("f44_findings_text", f"""{W}, al AS (SELECT '  - [' || severity || '] ' || type || ' on ' || affected_element || ' at ' || {TS.format('raised_time')} || ' — ' || description || ' (' || status || ')' AS line FROM alarms),
ch AS (SELECT '  - ' || param || ': ' || old || ' → ' || new || ' by ' || changed_by || ' at ' || {TS.format('time')} || ' (reason: ' || coalesce(reason, '') || ')' AS line FROM changes),
none AS (SELECT cell_id || '{net.NO_CHANGES}' AS line FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM changes))
  SELECT line FROM al UNION ALL SELECT line FROM ch UNION ALL SELECT line FROM none""")
def findings(spark, sf):
    c = F.col
    a = alarms(spark, sf).select(net.alarm_line(c("severity"), c("type"), c("affected_element"), _ts("raised_time"), c("description"), c("status")).alias("line"))
    ch = changes(spark, sf)
    b = ch.select(net.change_line(c("param"), c("old"), c("new"), c("changed_by"), _ts("time"), c("reason")).alias("line"))
    none = cells(spark, sf).join(ch, "cell_id", "left_anti").select(F.concat("cell_id", F.lit(net.NO_CHANGES)).alias("line"))
    return a.union(b).union(none)


# --- requests --------------------------------------------------------------------------------
# Shapes of identifiers operators type, by customer.
def requests(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    site = F.concat(F.lit("SITE-"), F.replace("n_name", F.lit("_"), F.lit("-")))
    pick = F.col("c_custkey") % 9
    cell = (
        F.when(pick == 0, F.concat(F.lit(" "), site, F.lit("-S2 "))).when(pick == 1, site)
        .when(pick == 2, F.concat(site, F.lit("-S1, "), site, F.lit("-S2"))).when(pick == 3, "CELL-77").when(pick == 4, "   "))
    return c.select(
        F.col("c_custkey").alias("req_id"), cell.alias("cell_id"),
        F.when(pick == 5, site).when(pick == 6, "SITE-X").when(pick == 4, "").alias("site_id"),
        F.when(pick == 7, F.col("r_name")).when(pick == 4, F.lower("r_name")).alias("region"))


_REQ = """rq AS (SELECT c_custkey AS req_id, CASE c_custkey % 9 WHEN 0 THEN ' ' || s || '-S2 ' WHEN 1 THEN s WHEN 2 THEN s || '-S1, ' || s || '-S2' WHEN 3 THEN 'CELL-77' WHEN 4 THEN '   ' END AS cell_id,
  CASE c_custkey % 9 WHEN 5 THEN s WHEN 6 THEN 'SITE-X' WHEN 4 THEN '' END AS site_id, CASE c_custkey % 9 WHEN 7 THEN r_name WHEN 4 THEN lower(r_name) END AS region
  FROM (SELECT c_custkey, 'SITE-' || replace(n_name, '_', '-') AS s, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)),
nz AS (SELECT req_id, nullif(trim(cell_id), '') AS c, site_id, region FROM rq),
ni AS (SELECT req_id, region, CASE WHEN contains(c, ',') OR (c NOT IN (SELECT cell_id FROM cells) AND NOT regexp_matches(c, '-S[123]$') AND c IN (SELECT site_id FROM sites)) THEN NULL ELSE c END AS cell_id,
  nullif(CASE WHEN contains(c, ',') THEN regexp_replace(trim(split_part(c, ',', 1)), '-S[^S]*$', '') WHEN c NOT IN (SELECT cell_id FROM cells) AND NOT regexp_matches(c, '-S[123]$') AND c IN (SELECT site_id FROM sites) THEN c ELSE site_id END, '') AS site_id FROM nz)"""


@query("f26_normalize_ids", f"{W}, {_REQ} SELECT req_id, cell_id, site_id FROM ni")
def normalize(spark, sf):
    all_cells = cells(spark, sf)
    r = requests(spark, sf).withColumn("c", F.trim("cell_id"))
    r = r.join(all_cells.select(F.col("cell_id").alias("c"), F.lit(True).alias("kc")), "c", "left")
    r = r.join(all_cells.select(F.col("site_id").alias("c"), F.lit(True).alias("ks")).distinct(), "c", "left")
    ids = net.normalize_ids(F.col("cell_id"), F.col("site_id"), F.coalesce("kc", F.lit(False)), F.coalesce("ks", F.lit(False)))
    return r.select("req_id", ids.alias("i")).select("req_id", "i.cell_id", "i.site_id")


@query("c6_resolve_cells", f"""{W}, {_REQ}, lv AS (SELECT req_id, CASE WHEN cell_id IS NOT NULL THEN 'cell' WHEN site_id IS NOT NULL THEN 'site' WHEN coalesce(region, '') <> '' THEN 'region' ELSE 'all' END AS level,
  coalesce(cell_id, site_id, region) AS asked FROM ni),
h AS (SELECT lv.*, c.cell_id FROM lv LEFT JOIN cells c ON (level = 'cell' AND c.cell_id = asked) OR (level = 'site' AND c.site_id = asked) OR (level = 'region' AND lower(c.region) = lower(asked)))
  SELECT req_id, level, CASE WHEN level = 'all' THEN '*' ELSE cell_id END AS cell_id,
  CASE WHEN level <> 'all' AND cell_id IS NULL THEN 'Unknown ' || CASE level WHEN 'region' THEN 'region' ELSE level || '_id' END || ': ' || chr(39) || asked || chr(39) END AS error FROM h""")
def resolve(spark, sf):
    return netops.resolve_cells(requests(spark, sf), cells(spark, sf))


QUESTIONS = {
    0: "Check cell SITE-NATION-{}-S1 now", 1: "Compare SITE-NATION-{} and SITE-METRO-001, please.", 2: "cell {} is down",
    3: "issue on 1234{} since noon", 4: "why is it slow", 5: "compare site-nation-{}-s1 with SITE-NATION-{}-S2",
    6: "The alarm at SITE-NATION-{}. Explain and generate a config", 7: "node: {} and cellid 77 then enb-5",
}


def _question():
    out = None
    for i, form in QUESTIONS.items():
        v = F.replace(F.lit(form), F.lit("{}"), F.col("c_nationkey").cast("string"))
        cond = F.col("c_custkey") % 8 == i
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def questions(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("req_id"), _question().alias("q"))


_QSQL = "qs AS (SELECT c_custkey AS req_id, replace(CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {sql_text(f)}" for i, f in QUESTIONS.items()) + " END, '{}', c_nationkey::VARCHAR) AS q FROM customer)"


def _rx(p):
    return "regexp_extract_all(q, " + sql_text("(?i)" + p.replace(r"[\w-]", r"[\w\-]")) + ", 1)"


@query("f31_extract_entities", f"""WITH {_QSQL}, f AS (SELECT req_id, {_rx(rules.CELL_ID)} AS c, {_rx(rules.SITE_ID)} AS s0, {_rx(rules.KEYWORD_NUMBER)} AS n, {_rx(rules.LONG_NUMBER)} AS l FROM qs),
g AS (SELECT req_id, c, CASE WHEN len(c) > 0 OR len(s0) > 0 THEN list_filter(s0, lambda x, i: list_position(s0, x) = i) WHEN len(n) > 0 THEN n ELSE l END AS s FROM f)
  SELECT req_id, CASE WHEN len(c) > 0 THEN c[1] WHEN len(s) = 1 THEN s[1] END AS cell_id, CASE WHEN len(c) > 1 THEN array_to_string(c, ',') END AS cell_ids,
  CASE WHEN len(c) = 0 AND len(s) > 1 THEN s[1] END AS site_id, CASE WHEN len(c) = 0 AND len(s) > 1 THEN array_to_string(s, ',') END AS site_ids FROM g""")
def entities(spark, sf):
    e = questions(spark, sf).select("req_id", ent.extract_entities(F.col("q")).alias("e"))
    return e.select("req_id", "e.cell_id", F.array_join("e.cell_ids", ",").alias("cell_ids"), "e.site_id", F.array_join("e.site_ids", ",").alias("site_ids"))


@query("f34_has_entity", f"WITH {_QSQL} SELECT req_id, regexp_matches(q, {sql_text('(?i)' + rules.HAS_ENTITY)}) AS routed FROM qs")
def has_entity(spark, sf):
    return questions(spark, sf).select("req_id", ent.has_entity(F.col("q")).alias("routed"))


@query("f36_needs_plan", f"WITH {_QSQL} SELECT req_id, contains(lower(q), ' and ') OR contains(lower(q), ' then ') OR (contains(lower(q), 'diagnose') AND contains(lower(q), 'config')) OR (contains(lower(q), 'explain') AND contains(lower(q), 'generate')) AS planned FROM qs")
def needs_plan(spark, sf):
    return questions(spark, sf).select("req_id", ent.needs_plan(F.col("q")).alias("planned"))


_CLASS = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(q), {sql_text(w)})' for w in ws)} THEN '{n}'" for n, ws in rules.SKILL_KEYWORDS) + " ELSE 'general' END"
_CHAIN = "CASE kind " + " ".join(f"WHEN '{n}' THEN '{' > '.join(c)}'" for n, c in rules.SKILL_CHAINS.items()) + " END"


@query("f32_skill_chain", f"WITH {_QSQL}, c AS (SELECT req_id, {_CLASS} AS kind FROM qs UNION ALL SELECT conv_id * 100 + turn, {_CLASS.replace('(q)', '(text)')} FROM conversations) SELECT req_id, kind, {_CHAIN} AS chain FROM c")
def chains(spark, sf):
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("req_id"), F.col("text").alias("q"))
    rows = questions(spark, sf).union(turns)
    return rows.select("req_id", ent.skill_class(F.col("q")).alias("kind"), F.array_join(ent.skill_chain(F.col("q")), " > ").alias("chain"))


@query("f46_site_scope", f"{W} SELECT site_id, (site_id LIKE 'SITE-NATION-1%' OR site_id LIKE 'SITE-URBAN-%') AS allowed FROM sites")
def scope(spark, sf):
    return sites(spark, sf).select("site_id", net.in_scope(F.col("site_id"), ["SITE-NATION-1*", "SITE-URBAN-*"]).alias("allowed"))


# --- evidence: one investigation per user and day --------------------------------------------
def tool_rows(spark, sf):
    e = table(spark, sf, "events")

    def n(kind, extra=None):
        cond = F.col("event_type") == kind
        return F.count_if(cond & extra if extra is not None else cond)

    day = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        n("view").alias("v"), n("view", F.col("value") > 40).alias("vd"), n("error").alias("er"), n("purchase").alias("p"), n("signup").alias("s"))
    zero = F.lit(0).cast("long")

    def row(tool, error, res, deg, al, ch, ov):
        return F.struct(F.lit(tool).alias("tool"), error.alias("error"), res.alias("n_results"), deg.alias("n_degraded"), al.alias("n_alarms"), ch.alias("n_changes"), ov.alias("has_overrides"))

    no = F.lit(False)
    rows = F.array(
        row("kpi_lookup", F.col("user_id") % 7 == 0, F.col("v"), F.col("vd"), zero, zero, no),
        row("alarm_query", no, zero, zero, F.col("er"), zero, no),
        row("config_audit", F.col("user_id") % 14 == 0, zero, zero, zero, F.col("p"), F.col("s") > 0))
    inv = F.concat_ws("_", F.col("user_id").cast("string"), F.col("d").cast("string"))
    return day.select(inv.alias("inv_id"), F.inline(rows))


_DAY = """dy AS (SELECT user_id, user_id || '_' || strftime(ts, '%Y-%m-%d') AS inv_id, count_if(event_type='view')::BIGINT AS v, count_if(event_type='view' AND value > 40)::BIGINT AS vd,
  count_if(event_type='error')::BIGINT AS er, count_if(event_type='purchase')::BIGINT AS p, count_if(event_type='signup')::BIGINT AS s FROM events GROUP BY ALL),
ec AS (SELECT inv_id, CASE WHEN user_id % 7 = 0 THEN 0 ELSE v END AS kpi_cells, CASE WHEN user_id % 7 = 0 THEN 0 ELSE vd END AS kpi_degraded, er AS alarms,
  CASE WHEN user_id % 14 = 0 THEN 0 ELSE p END AS changes, CASE WHEN user_id % 14 = 0 THEN 2 WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS errors,
  (CASE WHEN user_id % 7 <> 0 AND v > 0 THEN 1 ELSE 0 END + CASE WHEN er > 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 14 <> 0 AND (p > 0 OR s > 0) THEN 1 ELSE 0 END) AS tools_with_data FROM dy),
vd AS (SELECT *, CASE WHEN (kpi_cells = 0 AND alarms = 0 AND changes = 0 AND errors = 0) OR (errors > 0 AND tools_with_data = 0) THEN 'NO_DATA' WHEN tools_with_data < 2 THEN 'PARTIAL_DATA' ELSE 'FULL_DATA' END AS verdict FROM ec),
cf AS (SELECT *, CASE WHEN kpi_cells > 0 THEN 30 ELSE 0 END + CASE WHEN alarms > 0 THEN 25 ELSE 0 END + CASE WHEN changes > 0 THEN 20 ELSE 0 END + CASE WHEN kpi_degraded > 0 THEN 15 ELSE 0 END + CASE WHEN tools_with_data >= 3 THEN 10 ELSE 0 END AS confidence FROM vd)"""


@query("g19_evidence_verdict", f"WITH {_DAY} SELECT * FROM vd")
def verdicts(spark, sf):
    return evidence.evidence_verdict(tool_rows(spark, sf))


@query("g26_crosscheck", f"WITH {_DAY} SELECT inv_id, CASE WHEN kpi_degraded > 0 AND alarms = 0 THEN 'KPIs degraded but no alarms — possible monitoring gap' END AS warning FROM vd")
def crosscheck(spark, sf):
    v = evidence.evidence_counts(tool_rows(spark, sf))
    return v.select("inv_id", evidence.crosscheck(F.col("kpi_degraded"), F.col("alarms")).alias("warning"))


def _confidence(spark, sf):
    c = F.col
    v = evidence.evidence_verdict(tool_rows(spark, sf))
    return v.withColumn("confidence", evidence.confidence(c("kpi_cells"), c("alarms"), c("changes"), c("kpi_degraded"), c("tools_with_data")))


@query("g27_confidence", f"WITH {_DAY} SELECT inv_id, verdict, confidence FROM cf")
def confidence(spark, sf):
    return _confidence(spark, sf).select("inv_id", "verdict", "confidence")


@query("f45_escalation", f"""WITH {_DAY}, s AS (SELECT inv_id, confidence / 100 AS c, CASE WHEN alarms > 2 THEN 'critical' ELSE 'major' END AS sev FROM cf)
  SELECT inv_id, CASE WHEN sev = 'critical' THEN 'escalate' WHEN c >= 0.8 THEN 'auto_respond' WHEN c >= 0.6 THEN 'respond_with_caveat' WHEN c >= 0.4 THEN 'escalate' ELSE 'refuse' END AS decision FROM s""")
def escalate(spark, sf):
    severity = F.when(F.col("alarms") > 2, "critical").otherwise("major")
    return _confidence(spark, sf).select("inv_id", net.escalation(F.col("confidence") / 100, severity).alias("decision"))


SKILL_OF = {"view": "triage", "click": "diagnose", "error": "impact_assess", "purchase": "config_check", "signup": "recommend"}


@query("g20_skill_guardrail", f"""WITH sk AS (SELECT user_id || '_' || strftime(ts, '%Y-%m-%d') AS inv_id, event_type, CASE WHEN count(*) > 1 THEN 'completed' ELSE 'no_data' END AS status FROM events GROUP BY ALL),
  g AS (SELECT inv_id, count(*) AS skills, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'no_data')::BIGINT AS no_data, bool_or(event_type = 'signup') AS recommends FROM sk GROUP BY inv_id)
  SELECT *, completed = 0 OR (no_data >= skills - 1 AND recommends) AS suppress FROM g""")
def guardrail(spark, sf):
    inv = F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("inv_id")
    skill = F.create_map(*[F.lit(x) for kv in SKILL_OF.items() for x in kv])[F.col("event_type")].alias("skill")
    rows = table(spark, sf, "events").groupBy(inv, skill).agg(F.when(F.count(F.lit(1)) > 1, "completed").otherwise("no_data").alias("status"))
    return evidence.skill_guardrail(rows)


@query("g21_combine_entities", """SELECT conv_id, turn // 2 AS part, string_agg('**' || role || ':**' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS combined FROM conversations GROUP BY ALL""")
def combine(spark, sf):
    t = table(spark, sf, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 2).cast("long").alias("part"), F.col("turn").alias("pos"), F.col("role").alias("entity"), F.col("text").alias("analysis"))
    return evidence.combine_entities(t, ["conv_id", "part"])


TOOL_OF = {"view": "kpi_lookup", "error": "alarm_query", "purchase": "config_audit"}


def _plan(spark, sf):
    e = events(spark, sf).filter(F.col("event_type").isin(*TOOL_OF))
    tool = F.create_map(*[F.lit(x) for kv in TOOL_OF.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("inv_id"), F.col("event_id").alias("step"), tool.alias("tool"),
        F.when(F.col("k") % 2 == 0, F.col("cell_id")).alias("cell_id"), F.when(F.col("k") % 3 == 0, F.col("site_id")).alias("site_id"), F.lit(None).cast("string").alias("region"))


_REASON = "CASE tool " + " ".join(f"WHEN '{t}' THEN {sql_text(r + rules.AUTO_ADDED)}" for t, r in rules.TOOL_REASONS.items()) + " END"
_PLAN = f"""{NET_SQL}, pl AS (SELECT user_id || '_' || strftime(ts, '%Y-%m-%d') AS inv_id, event_id AS step, CASE event_type WHEN 'view' THEN 'kpi_lookup' WHEN 'error' THEN 'alarm_query' ELSE 'config_audit' END AS tool,
  CASE WHEN k % 2 = 0 THEN cell_id END AS cell_id, CASE WHEN k % 3 = 0 THEN site_id END AS site_id FROM ev WHERE event_type IN ('view','error','purchase')),
kn AS (SELECT inv_id, arg_max(cell_id, step) FILTER (cell_id IS NOT NULL) AS cell_id, arg_max(site_id, step) FILTER (site_id IS NOT NULL) AS site_id FROM pl GROUP BY inv_id),
al AS (SELECT inv_id, step, tool, cell_id, site_id, NULL AS reason FROM pl UNION ALL
  SELECT kn.inv_id, NULL, tool, kn.cell_id, kn.site_id, {_REASON} FROM kn, (VALUES ('kpi_lookup'), ('alarm_query'), ('config_audit')) t(tool) WHERE (inv_id, tool) NOT IN (SELECT (inv_id, tool) FROM pl))"""


@query("u4_complete_plan", f"WITH {_PLAN} SELECT inv_id, step, tool, cell_id, site_id, reason FROM al")
def complete(spark, sf):
    return evidence.complete_plan(_plan(spark, sf)).select("inv_id", "step", "tool", "cell_id", "site_id", "reason")


@query("s8_order_evidence", f"WITH {_PLAN} SELECT inv_id, step, tool, CASE tool WHEN 'kpi_lookup' THEN 0 WHEN 'alarm_query' THEN 1 WHEN 'config_audit' THEN 2 ELSE 99 END AS tool_rank FROM pl")
def order(spark, sf):
    return evidence.order_evidence(_plan(spark, sf)).select("inv_id", "step", "tool", "tool_rank")


# --- model output ----------------------------------------------------------------------------
LABELS = ["view", "click", "error"]


@query("f35_normalize_label", """SELECT event_id, CASE WHEN contains(t, 'view') THEN 'view' WHEN contains(t, 'click') THEN 'click' WHEN contains(t, 'error') THEN 'error' WHEN contains(t, 'follow') THEN 'followup' ELSE 'general' END AS label
  FROM (SELECT event_id, lower(CASE WHEN event_type = 'signup' THEN ' Follow-up. ' ELSE ' ' || upper(event_type) || '. ' END) AS t FROM events)""")
def label(spark, sf):
    raw = F.when(F.col("event_type") == "signup", " Follow-up. ").otherwise(F.concat(F.lit(" "), F.upper("event_type"), F.lit(". ")))
    return table(spark, sf, "events").select("event_id", ent.normalize_label(raw, LABELS).alias("label"))


# Reply shapes around the event's own JSON, by event.
REPLIES = {0: "```json\n[{}]\n```", 1: "Here it is: [{}, {}] done", 2: "[{}", 3: "none", 4: "[]"}


def _replies(spark, sf):
    e = table(spark, sf, "events")
    obj = F.concat(F.lit('{"tool": "kpi_lookup", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    out = None
    for i, form in REPLIES.items():
        v = F.replace(F.lit(form), F.lit("{}"), obj)
        cond = F.col("event_id") % 5 == i
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return e.select("event_id", out.alias("raw"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("f37_json_array", """SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, (props->>'$.k')::INT AS k FROM events, range(2) WHERE event_id % 5 = 1""")
def json_array(spark, sf):
    rows = _replies(spark, sf).select("event_id", F.explode(ent.json_array(F.col("raw"), "struct<tool:string,k:int>")).alias("x"))
    return rows.select("event_id", "x.k")


@query("f38_valid_plan", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS known_steps, 0 AS other_steps FROM events""")
def valid_plan(spark, sf):
    steps = ent.json_array(F.col("raw"), "struct<tool:string,k:int>")
    return _replies(spark, sf).select(
        "event_id", F.size(ent.valid_steps(steps, rules.TOOLS)).alias("known_steps"), F.size(ent.valid_steps(steps, ["other"])).alias("other_steps"))


@query("f41_json_object", """SELECT event_id, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN event_type END AS domain FROM events""")
def json_object(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    tail = F.when(F.col("k") % 2 == 0, F.lit(', "description": "d", "keywords": ["a"]} ok')).otherwise(F.lit("} ok"))
    raw = F.concat(F.lit('Reply: {"name": "n", "domain": "'), "event_type", F.lit('"'), tail)
    obj = ent.json_object(raw, "domain string, name string", ["domain", "name", "description", "keywords"])
    return e.select("event_id", obj["domain"].alias("domain"))
