"""Answer-quality flags, topic coverage and the quality-gate verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.text import contains_any, count_matches, matches
from signalbook.operators.dedup import exact_dups
from signalbook.operators.profile import length_profile
from signalbook.operators.similarity import near_dups
from signalbook.session import materialize


def marker_count(c: Column, markers: list[str]) -> Column:
    """Number of patterns that occur at least once."""
    return sum((matches(c, m).cast("int") for m in markers), F.lit(0))


def shallow_count(c: Column, markers=None) -> Column:
    return marker_count(c, rules.SHALLOW_MARKERS if markers is None else markers)


def is_shallow(c: Column, markers=None) -> Column:
    return shallow_count(c, markers) >= 2


def specificity(c: Column, markers=None) -> Column:
    return marker_count(c, rules.SPECIFICITY_MARKERS if markers is None else markers)


def first_topic(question: Column, answer: Column, topics: dict[str, list[str]]) -> Column:
    """First topic in table order with a keyword in question or answer; null if none."""
    if not topics:
        return F.lit(None).cast("string")

    def pick(text: Column) -> Column:
        out = None
        for name, keywords in topics.items():
            hit = contains_any(text, keywords)
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out

    # Bound by the lambda, the text is lower-cased once; as a plain expression it would be anew for every keyword.
    text = F.concat(F.lower(question), F.lit(" "), F.lower(answer))
    return F.get(F.transform(F.array(text), pick), F.lit(0))


def topic_coverage(df: DataFrame, question: str, answer: str, topics=None) -> DataFrame:
    """Rows and share per topic, topics without rows included, plus ``unclassified``."""
    topics = rules.KPI_TOPICS if topics is None else topics
    tagged = df.select(F.coalesce(first_topic(F.col(question), F.col(answer), topics), F.lit("unclassified")).alias("topic"))
    # One pass of conditional counts gives the zeros for free: the topic list is a small rule table.
    names = list(topics) + ["unclassified"]
    counts = tagged.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("topic") == t).alias(f"t{i}") for i, t in enumerate(names)]
    )
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"t{i}").alias("n")) for i, t in enumerate(names)])
    return counts.select("total", F.inline(rows)).select(
        "topic", "n", F.round(F.col("n") / F.greatest("total", F.lit(1)), 6).alias("share")
    )


def style_flags(c: Column) -> dict[str, Column]:
    low = F.lower(c)
    return {
        "probability_pct": matches(low, rules.STYLE_PROBABILITY),
        "generic_rca": matches(low, rules.STYLE_RANKED_CAUSES),
        "too_short": F.length(c) < 100,
        "too_long": F.length(c) > 2000,
        "no_first_check": ~matches(low, rules.STYLE_FIRST_CHECK),
        "cli_heavy": count_matches(c, rules.STYLE_CODE_SPAN) > 4,
    }


def style_report(df: DataFrame, answer: str, alert_pct: float = 10.0) -> DataFrame:
    """Count, percentage and alert per style rule."""
    flags = style_flags(F.col(answer))
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(v).alias(k) for k, v in flags.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in flags])
    pct = F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).otherwise(0.0)
    return counts.select("total", F.inline(rows)).select(
        "issue", "n", F.round(pct, 6).alias("pct"), (pct > alert_pct).alias("alert")
    )


def gate_metrics(
    valid: DataFrame, parse_errors: Column | None = None, topics=None, row="row_id", question="question",
    answer="answer", threshold: float = 0.85, window: int = 200,
) -> DataFrame:
    """One row with every number of the quality report over validated records."""
    topics = rules.KPI_TOPICS if topics is None else topics
    a = F.col(answer)
    names = list(topics)
    per_row = valid.select(
        is_shallow(a).alias("shallow"), specificity(a).alias("spec"),
        first_topic(F.col(question), a, topics).alias("topic"),
    )
    base = per_row.agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.count_if("shallow").alias("n_shallow"),
        F.avg("spec").alias("avg_spec"),
        F.count_if(F.col("topic").isNull()).alias("unclassified"),
        *[F.count_if(F.col("topic") == t).alias(f"_t{i}") for i, t in enumerate(names)],
    )
    counts = F.array(*[F.col(f"_t{i}") for i in range(len(names))])
    base = base.select(
        "n_valid", "n_shallow", "avg_spec", "unclassified",
        F.array_max(counts).alias("max_topic"), F.array_min(counts).alias("min_topic"),
        (parse_errors if parse_errors is not None else F.lit(0)).cast("long").alias("parse_errors"),
    )
    exact = materialize(exact_dups(valid, row, question))
    near = materialize(near_dups(valid, threshold, window, row, question))
    removed = exact.select("dup_row").union(near.select("row_i")).agg(
        F.count_distinct("dup_row").alias("n_removed")
    )
    parts = [exact.agg(F.count(F.lit(1)).alias("n_exact")), near.agg(F.count(F.lit(1)).alias("n_near")), removed]
    lengths = length_profile(valid.select(F.length(answer).alias("len")), "len").select(
        "min_len", "median", "mean_len", "max_len"
    )
    out = base.withColumn("_one", F.lit(1))
    for part in [*parts, lengths]:  # one row each
        out = out.join(part.withColumn("_one", F.lit(1)), "_one", "left")
    return out.drop("_one").withColumn("n_clean", F.col("n_valid") - F.col("n_removed"))


def quality_verdict(metrics: DataFrame) -> DataFrame:
    """Issue list of the gate and PASS / ISSUES from the one-row metrics."""
    n = F.col("n_valid")

    def text(col, tail):
        return F.concat(F.col(col).cast("string"), F.lit(tail))

    issues = F.array(
        F.when(F.col("parse_errors") > 0, text("parse_errors", " parse errors")),
        F.when(F.col("n_exact") > n * F.lit(0.02), text("n_exact", " exact duplicates (>2%)")),
        F.when(F.col("n_near") > n * F.lit(0.05), text("n_near", " near-duplicates (>5%)")),
        F.when(F.col("n_shallow") > n * F.lit(0.05), text("n_shallow", " shallow answers (>5%)")),
        F.when(F.col("avg_spec") < 2.0, F.lit("low domain specificity")),
        F.when(F.try_divide("min_topic", "max_topic") < 0.1, F.lit("severe topic imbalance")),
    )
    found = F.filter(issues, lambda i: i.isNotNull())
    return metrics.withColumn("issues", F.array_join(found, "; ")).withColumn(
        "verdict", F.when(F.size(found) == 0, "PASS").otherwise("ISSUES")
    )
