"""Roll-ups and comparisons of stored evaluation results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbook.functions.text import seeded_order

OVERALL = "OVERALL"


def _rolled(df: DataFrame, by: str, *aggs) -> DataFrame:
    """Aggregates per value of ``by`` and over all rows (labelled OVERALL)."""
    out = df.rollup(by).agg(F.grouping(by).alias("_all"), *aggs)
    return out.withColumn(by, F.when(F.col("_all") == 1, OVERALL).otherwise(F.col(by))).drop("_all")


def accuracy(df: DataFrame, predicted="predicted", answer="answer", by="subject", elapsed="elapsed") -> DataFrame:
    right = F.col(predicted) == F.col(answer)
    return _rolled(
        df, by,
        F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total"),
        (F.count_if(right) / F.count(F.lit(1))).alias("accuracy"),
        F.count_if(F.col(predicted) == -1).alias("unparsed"), F.avg(elapsed).alias("avg_elapsed"),
    )


def accuracy_matrix(df: DataFrame, models: list[str], by="subject", model="model") -> DataFrame:
    """Accuracy per subject and model, and the change of every model against the first."""
    right = (F.col("predicted") == F.col("answer")).cast("double")
    aggs = [F.avg(F.when(F.col(model) == m, right)).alias(f"acc_{m}") for m in models]
    wide = _rolled(df, by, *aggs)
    return wide.withColumns({f"delta_{m}": F.col(f"acc_{m}") - F.col(f"acc_{models[0]}") for m in models[1:]})


def rubric_summary(df: DataFrame, by="category", score="score", elapsed="elapsed") -> DataFrame:
    return _rolled(
        df, by, F.sum(score).alias("sum_score"), F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("avg_score"), F.avg(elapsed).alias("avg_elapsed"),
    )


def concept_summary(df: DataFrame, by="subject") -> DataFrame:
    """From ``coverage`` (see ``concept_coverage``) and ``concepts`` per row."""
    return _rolled(
        df, by, F.avg("coverage.score").alias("avg_score"), F.count(F.lit(1)).alias("n"),
        F.avg(F.size("coverage.found")).alias("avg_found"), F.avg(F.size("concepts")).alias("avg_concepts"),
    )


def diff_results(a: DataFrame, b: DataFrame, key="id", score="score", eps: float = 0.05) -> DataFrame:
    """Per question: old and new score, change, and gains / regressions / no_change; only_old and only_new for
    questions of one run, null for those without a score in a run that has them."""
    both = a.select(key, F.col(score).alias("old"), F.lit(True).alias("_a")).join(
        b.select(key, F.col(score).alias("new"), F.lit(True).alias("_b")), key, "full_outer")
    delta = F.col("new") - F.col("old")
    kind = (
        F.when(F.col("_b").isNull(), "only_old").when(F.col("_a").isNull(), "only_new")
        .when(delta >= eps, "gains").when(delta <= -eps, "regressions").when(delta.isNotNull(), "no_change"))
    return both.withColumns({"delta": delta, "kind": kind}).drop("_a", "_b")


def shared_regressions(diffs: list[DataFrame], key="id") -> DataFrame:
    """Questions that regress in every comparison."""
    lost = [d.filter(F.col("kind") == "regressions").select(key) for d in diffs]
    return reduce(lambda x, y: x.join(y, key, "left_semi"), lost)


def worst(df: DataFrame, k: int = 10, score="score", row="row_id") -> DataFrame:
    return df.orderBy(F.asc(score), F.asc(row)).limit(k)


def best(df: DataFrame, k: int = 5, score="score", row="row_id") -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(row)).limit(k)


def hardest_subjects(acc: DataFrame, k: int = 3, by="subject") -> DataFrame:
    return acc.filter(F.col(by) != OVERALL).orderBy("accuracy", by).limit(k)


def stratified_sample(df: DataFrame, k: int, seed: int, by="subject", row="row_id") -> DataFrame:
    """At most ``k`` rows per group in reproducible random order; the rank limit prunes every
    partition to ``k`` rows per group before the shuffle."""
    w = W.partitionBy(by).orderBy(seeded_order(row, seed))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def first_n(df: DataFrame, n: int, by: str = "row_id") -> DataFrame:
    return df.orderBy(by).limit(n)


def subject_filter(df: DataFrame, subject: str | None) -> DataFrame:
    return df if subject is None else df.filter(F.lower("subject") == subject.lower())
