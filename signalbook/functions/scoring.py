"""Rubric scores of free-text answers.

A rubric is given as columns: expected domain (null = not asked) and arrays of words that must or
must not occur.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbook.functions.text import bind, contains_any, strip, words

SEVERITY_WORDS = ["severity", "critical", "major"]
CAUSE_WORDS = ["cause", "reason", "probable"]
RESOLUTION_WORDS = ["resolution", "step", "action", "check"]


def _hits(low: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))


def _n(keywords: Column) -> Column:
    return F.greatest(F.coalesce(F.size(keywords), F.lit(0)), F.lit(0))


def _half(flag: Column) -> Column:
    return F.when(flag, 0.5).otherwise(0.0)


def score_incident(answer: Column, domain: Column, must: Column, must_not: Column) -> Column:
    """Share of expected points; forbidden words cost half a point each and may make it negative."""

    def score(low):
        extra = (
            _half(contains_any(low, SEVERITY_WORDS)) + _half(contains_any(low, CAUSE_WORDS))
            + _half(contains_any(low, RESOLUTION_WORDS))
        )
        right = F.when(F.contains(low, F.lower(domain)), 1).otherwise(0)
        wrong = F.coalesce(_hits(low, must_not), F.lit(0))
        points = right + F.coalesce(_hits(low, must), F.lit(0)) - F.lit(0.5) * wrong + extra
        best = F.when(domain.isNotNull(), 1).otherwise(0) + _n(must) + extra
        return F.least(points / F.greatest(best, F.lit(1.0)), F.lit(1.0))

    return bind(F.lower(answer), score)


score_kpi = score_incident  # key figures are scored by the same words


def _clamped(points: Column, best: Column) -> Column:
    return F.least(F.greatest(points / F.greatest(best, F.lit(1)), F.lit(0.0)), F.lit(1.0))


def repeats_lines(answer: Column) -> Column:
    """More than ten lines of which less than half are distinct and non-blank."""

    def check(lines):
        distinct = F.array_distinct(F.filter(F.transform(lines, strip), lambda x: x != ""))
        return (F.size(lines) > 10) & (F.size(distinct) / F.size(lines) < 0.5)

    return bind(F.split(answer, "\n"), check)


def score_config(answer: Column, must: Column) -> Column:
    yaml_like = F.contains(answer, F.lit(":")) & F.contains(answer, F.lit("\n"))
    points = (
        F.when(yaml_like, 1).otherwise(0) + F.coalesce(_hits(F.lower(answer), must), F.lit(0))
        - F.when(repeats_lines(answer), 1).otherwise(0)
    )
    return _clamped(points, _n(must) + 1)


def dumps_table(answer: Column) -> Column:
    bars = F.length(answer) - F.length(F.replace(answer, F.lit("|"), F.lit("")))
    rules = (F.length(answer) - F.length(F.replace(answer, F.lit("+--"), F.lit("")))) / 3
    return (bars > 20) | (rules > 5)


def repeats_words(answer: Column) -> Column:
    """More than fifty words of which less than 30 percent are distinct."""
    return bind(
        words(F.lower(answer)), lambda w: (F.size(w) > 50) & (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)) < 0.3)
    )


def score_knowledge(answer: Column, must: Column) -> Column:
    points = (
        F.coalesce(_hits(F.lower(answer), must), F.lit(0))
        - F.when(dumps_table(answer), 1).otherwise(0) - F.when(repeats_words(answer), 1).otherwise(0)
    )
    return _clamped(points, _n(must))


def score_routing(actual: Column, expected: Column) -> Column:
    return F.when(F.coalesce(actual == F.coalesce(expected, F.lit("")), F.lit(False)), 1.0).otherwise(0.0)


def score_details(answer: Column, domain: Column, must: Column, must_not: Column) -> Column:
    """Map of every check to its outcome as text."""
    low = F.lower(answer)

    def entry(key, value):
        return F.struct(key.alias("key"), value.alias("value"))

    hits = F.transform(must, lambda k: entry(F.concat(F.lit("contains_"), k), F.contains(low, F.lower(k)).cast("string")))
    wrong = F.transform(
        F.filter(must_not, lambda k: F.contains(low, F.lower(k))),
        lambda k: entry(F.concat(F.lit("wrongly_contains_"), k), F.lit("true")),
    )
    right = F.when(F.contains(low, F.lower(domain)), F.lit("correct")).otherwise(F.concat(F.lit("wrong (expected "), domain, F.lit(")")))
    flags = F.filter(
        F.array(
            F.when(domain.isNotNull(), entry(F.lit("domain"), right)),
            F.when(contains_any(low, SEVERITY_WORDS), entry(F.lit("has_severity"), F.lit("true"))),
            F.when(contains_any(low, CAUSE_WORDS), entry(F.lit("has_causes"), F.lit("true"))),
            F.when(contains_any(low, RESOLUTION_WORDS), entry(F.lit("has_resolution"), F.lit("true"))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.map_from_entries(F.concat(flags, hits, wrong))
