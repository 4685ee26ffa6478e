"""Evidence quality of investigations from their tool and skill rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions import network as net


def evidence_counts(df: DataFrame, key: str = "inv_id") -> DataFrame:
    """Per investigation: counts over its tool rows (tool, error, n_results, n_degraded, n_alarms,
    n_changes, has_overrides). Rows with an error carry no data."""
    ok = ~F.col("error")

    def total(tool, col):
        return F.sum(F.when(ok & (F.col("tool") == tool), F.col(col)).otherwise(0)).cast("long")

    with_data = ok & (
        ((F.col("tool") == "kpi_lookup") & (F.col("n_results") > 0))
        | ((F.col("tool") == "alarm_query") & (F.col("n_alarms") > 0))
        | ((F.col("tool") == "config_audit") & ((F.col("n_changes") > 0) | F.col("has_overrides")))
    )
    return df.groupBy(key).agg(
        total("kpi_lookup", "n_results").alias("kpi_cells"), total("kpi_lookup", "n_degraded").alias("kpi_degraded"),
        total("alarm_query", "n_alarms").alias("alarms"), total("config_audit", "n_changes").alias("changes"),
        F.count_if("error").alias("errors"), F.count_if(with_data).alias("tools_with_data"))


def evidence_verdict(df: DataFrame, key: str = "inv_id") -> DataFrame:
    c = F.col
    nothing = (c("kpi_cells") == 0) & (c("alarms") == 0) & (c("changes") == 0) & (c("errors") == 0)
    failed = (c("errors") > 0) & (c("tools_with_data") == 0)
    verdict = F.when(nothing | failed, "NO_DATA").when(c("tools_with_data") < 2, "PARTIAL_DATA").otherwise("FULL_DATA")
    return evidence_counts(df, key).withColumn("verdict", verdict)


def crosscheck(kpi_degraded: Column, alarms: Column) -> Column:
    return F.when((kpi_degraded > 0) & (alarms == 0), "KPIs degraded but no alarms — possible monitoring gap")


def confidence(kpi_cells, alarms, changes, degraded, tools_with_data) -> Column:
    def points(flag, n):
        return F.when(flag, n).otherwise(0)

    return (points(kpi_cells > 0, 30) + points(alarms > 0, 25) + points(changes > 0, 20)
            + points(degraded > 0, 15) + points(tools_with_data >= 3, 10))


def has_meaningful_data(df: DataFrame) -> Column:
    return ~F.col("error") & ((F.col("n_results") > 0) | (F.col("n_alarms") > 0) | (F.col("n_changes") > 0))


def skill_guardrail(df: DataFrame, key: str = "inv_id") -> DataFrame:
    """Suppress the answer when no skill completed, or all but one gave no data and one of the
    skills is ``recommend``."""
    done, empty = F.col("status") == "completed", F.col("status") == "no_data"
    agg = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("skills"), F.count_if(done).alias("completed"), F.count_if(empty).alias("no_data"),
        F.bool_or(F.col("skill") == "recommend").alias("recommends"))
    stop = (F.col("completed") == 0) | ((F.col("no_data") >= F.col("skills") - 1) & F.col("recommends"))
    return agg.withColumn("suppress", stop)


def combine_entities(df: DataFrame, keys: list[str]) -> DataFrame:
    """Analyses of the compared entities as one text in entity order. A comparison names a handful
    of entities, so a group stays small."""
    part = F.concat(F.lit("**"), "entity", F.lit(":**\n"), F.coalesce("analysis", F.lit("No data")))
    merged = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("_p"))
    return merged.select(*keys, F.array_join(F.transform("_p", lambda p: p["part"]), "\n\n").alias("combined"))


def complete_plan(plan: DataFrame, required: list[str] | None = None, key: str = "inv_id") -> DataFrame:
    """Plan rows plus one row per missing required tool, carrying the last identifiers of the plan."""
    required = rules.TOOLS if required is None else required
    known = plan.groupBy(key).agg(
        F.collect_set("tool").alias("_tools"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step"))).alias(c) for c in ("cell_id", "site_id", "region")])
    missing = F.array_except(F.array(*[F.lit(t) for t in required]).cast("array<string>"), "_tools")
    reason = None
    for tool, text in rules.TOOL_REASONS.items():
        reason = F.when(F.col("tool") == tool, text + rules.AUTO_ADDED) if reason is None else reason.when(F.col("tool") == tool, text + rules.AUTO_ADDED)
    added = known.withColumn("tool", F.explode(missing)).select(
        key, F.lit(None).cast(plan.schema["step"].dataType).alias("step"), "tool", "cell_id", "site_id", "region", reason.alias("reason"))
    return order_evidence(plan.select(key, "step", "tool", "cell_id", "site_id", "region", F.lit(None).cast("string").alias("reason")).union(added))


def order_evidence(df: DataFrame) -> DataFrame:
    """Rank column: key figures, alarms, configuration, then anything else."""
    rank = F.lit(99)
    for i, tool in reversed(list(enumerate(rules.TOOLS))):
        rank = F.when(F.col("tool") == tool, i).otherwise(rank)
    return df.withColumn("tool_rank", rank)


def first_in_order(rows: DataFrame, key: str, order: list[str], value: str, first: int, distinct: bool = False) -> DataFrame:
    """``key`` and ``values``: the first values of each key along ``order``, nulls left out; with ``distinct`` each value at its
    first place only.

    Every task keeps ``first`` rows of a key before anything moves and again after, so a key with very many rows is never
    gathered. Ties in ``order`` go to the smaller value.
    """
    place = F.struct(*order)
    found = rows.filter(F.col(value).isNotNull()).select(key, place.alias("_place"), F.col(value).alias("_value"))
    if distinct:
        found = found.groupBy(key, "_value").agg(F.min("_place").alias("_place"))
    # The limit on the rank is applied below the shuffle too.
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_place", "_value"))).filter(F.col("_rank") <= first)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_value"))), lambda x: x["_value"]).alias("values"))


def investigation_search(investigations: DataFrame, samples: DataFrame, alarm_rows: DataFrame, first: int = 3, distinct: bool = False) -> DataFrame:
    """inv_id, search: the search text of every investigation (inv_id, query) from all its key figures and alarms.

    ``samples``: inv_id, seq, status and the five figures; ``alarm_rows``: inv_id, seq, type. Phrases come in the order figures, then
    alarms, each by seq, and the first of them count, repeated ones too unless ``distinct``. Without any the query follows the generic phrase. Rows of unknown
    investigations are left out.
    """
    c = F.col
    tags = net.degraded_tags(
        c("status"), c("prb_utilization_dl_pct"), c("sinr_avg_db"), c("erab_drop_rate_pct"), c("rrc_setup_success_pct"), c("ul_interference_dbm"))
    both = samples.select("inv_id", F.lit(0).alias("tool"), "seq", F.posexplode(tags).alias("nr", "tag")).unionByName(
        alarm_rows.select("inv_id", F.lit(1).alias("tool"), "seq", F.posexplode(net.alarm_tags(c("type"))).alias("nr", "tag")))
    found = first_in_order(both, "inv_id", ["tool", "seq", "nr"], "tag", first, distinct)
    return investigations.join(found, "inv_id", "left").select("inv_id", net.search_text(c("values"), c("query"), first).alias("search"))
