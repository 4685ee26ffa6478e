"""Key-figure status, clamping, tags and text for network operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbook import rules


# Lower bound, upper bound and digits per metric (None = unbounded).
KPI_LIMITS = {
    "dl_throughput_mbps": (0, None, 1), "ul_throughput_mbps": (0, None, 1),
    "prb_utilization_dl_pct": (0, 100, 1), "prb_utilization_ul_pct": (0, 100, 1),
    "sinr_avg_db": (None, None, 1), "rsrp_avg_dbm": (None, None, 1),
    "connected_ues": (0, None, 0), "active_ues": (0, None, 0),
    "erab_drop_rate_pct": (0, None, 2), "rrc_setup_success_pct": (0, 100, 1),
    "ho_success_rate_pct": (0, 100, 1), "bler_dl_pct": (0, None, 1), "ul_interference_dbm": (None, None, 1),
}


def clamp_kpi(name: str, c: Column, digits: bool = True) -> Column:
    """Metric forced into its range and rounded to its digits."""
    low, high, scale = KPI_LIMITS[name]
    if high is not None:
        c = F.least(c, F.lit(float(high)))
    if low is not None:
        c = F.greatest(c, F.lit(float(low)))
    return F.round(c, scale) if digits else c


def kpi_status(drop: Column, rrc: Column, sinr: Column, anomaly: Column) -> Column:
    """DEGRADED / CRITICAL under an anomaly (major / other), else WARNING by limits, else NORMAL."""
    return (
        F.when(anomaly == "major", "DEGRADED").when(anomaly.isNotNull(), "CRITICAL")
        .when((drop > 2.0) | (rrc < 95) | (sinr < 5), "WARNING").otherwise("NORMAL")
    )


def is_degraded(status: Column) -> Column:
    return status.isin("DEGRADED", "CRITICAL")


def degraded_tags(status: Column, prb: Column, sinr: Column, drop: Column, rrc: Column, ul: Column) -> Column:
    """Search phrases for a key-figure row, in order; none unless it is degraded. A missing figure gives no phrase."""
    bad = status == "DEGRADED"
    found = F.array(
        F.when(bad & (prb > 80), rules.ISSUE_PHRASES["prb"]), F.when(bad & (sinr < 5), rules.ISSUE_PHRASES["sinr"]),
        F.when(bad & (drop > 1), rules.ISSUE_PHRASES["drop"]), F.when(bad & (rrc < 95), rules.ISSUE_PHRASES["rrc"]),
        F.when(bad & (ul > -100), rules.ISSUE_PHRASES["ul"]))
    return F.filter(found, lambda t: t.isNotNull())


def alarm_tags(alarm_type: Column) -> Column:
    """The search phrase for an alarm, by the first part of its type that is known; at most one."""
    phrase = F.lit(None).cast("string")
    for parts, text in reversed(rules.ALARM_PHRASES):
        hit = alarm_type.contains(parts[0])
        for part in parts[1:]:
            hit = hit | alarm_type.contains(part)
        phrase = F.when(hit, text).otherwise(phrase)
    return F.filter(F.array(phrase), lambda t: t.isNotNull())


def search_text(tags: Column, query: Column, first: int = 3) -> Column:
    """The first phrases joined, or a generic phrase for the question."""
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, F.concat(F.lit(rules.GENERIC_PHRASE), query)).otherwise(
        F.array_join(F.slice(tags, 1, first), " "))


def issue_tags(status: Column, prb: Column, sinr: Column, drop: Column, rrc: Column, ul: Column, alarm_type: Column, query: Column) -> Column:
    """First three search phrases for a degraded sample and an alarm, or a generic phrase."""
    return search_text(F.concat(degraded_tags(status, prb, sinr, drop, rrc, ul), alarm_tags(alarm_type)), query)


def alarm_line(severity, kind, element, raised, description, status) -> Column:
    return F.format_string("  - [%s] %s on %s at %s — %s (%s)", severity, kind, element, raised, description, status)


def change_line(param, old, new, by, when, reason) -> Column:
    shown = [F.coalesce(c, F.lit("?")) for c in (param, old, new, by, when)]
    return F.format_string("  - %s: %s → %s by %s at %s (reason: %s)", *shown, F.coalesce(reason, F.lit("")))


NO_ALARMS = "  No alarms found in this time window."
NO_CHANGES = "  No configuration changes found in this time window."


def escalation(confidence: Column, severity: Column) -> Column:
    return (
        F.when(severity == "critical", "escalate").when(confidence >= 0.8, "auto_respond")
        .when(confidence >= 0.6, "respond_with_caveat").when(confidence >= 0.4, "escalate")
        .otherwise("refuse")
    )


def in_scope(site: Column, globs: list[str]) -> Column:
    """True when the site matches any pattern with ``*`` for any text."""
    out = F.lit(False)
    for g in globs:
        out = out | site.like(g.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
    return out


def normalize_ids(cell: Column, site: Column, known_cell: Column, known_site: Column) -> Column:
    """(cell_id, site_id) after trimming, taking the site of a comma list, and reading a site given
    as a cell. ``known_*`` tell whether the trimmed cell text is a cell or site of the network."""
    c = F.nullif(F.trim(cell), F.lit(""))
    first = F.trim(F.split(c, ",")[0])
    listed = F.coalesce(c.contains(","), F.lit(False))
    is_site = ~listed & ~known_cell & ~c.rlike("-S[123]$") & known_site
    drop_cell = listed | F.coalesce(is_site, F.lit(False))
    new_site = F.when(listed, F.regexp_replace(first, "-S(?!.*-S).*$", "")).when(is_site, c).otherwise(site)
    return F.struct(F.when(~drop_cell, c).alias("cell_id"), F.nullif(new_site, F.lit("")).alias("site_id"))
