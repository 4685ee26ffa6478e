"""Counts, length profiles and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbook import rules


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    label = F.coalesce(F.col(category), F.lit("unknown")).alias("category")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def zero_filled(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Union of the names on both sides with missing values as zero."""
    old = a.select(key, F.col(value).alias("old"))
    new = b.select(key, F.col(value).alias("new"))
    return old.join(new, key, "full_outer").select(
        key, F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new")
    )


def category_delta(a: DataFrame, b: DataFrame, category: str = "category") -> DataFrame:
    both = zero_filled(category_counts(a, category), category_counts(b, category), "category", "n")
    return both.withColumn("delta", F.col("new") - F.col("old"))


def length_profile(df: DataFrame, length: str, keys: list[str] | None = None) -> DataFrame:
    """min, p10, median, p90, max by rank n//10, n//2 and int(0.9 n), and the integer mean.

    Rows are never sorted: equal lengths are counted first and the ranks are looked up in the
    running count over the (bounded) distinct lengths.
    """
    keys = keys or []
    counts = df.groupBy(*keys, F.col(length).cast("long").alias("_len")).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys)
    run = counts.select(
        *keys, "_len", "_c",
        F.sum("_c").over(w.orderBy("_len").rowsBetween(W.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_c").over(w).alias("_n"),
    )

    def pick(rank, name):
        return F.min(F.when(F.col("_upto") > rank, F.col("_len"))).alias(name)

    n = F.col("_n")
    return run.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.min("_len").alias("min_len"),
        pick(F.floor(n / 10), "p10"),
        pick(F.floor(n / 2), "median"),
        pick(F.floor(n * F.lit(0.9)), "p90"),
        F.max("_len").alias("max_len"),
        F.floor(F.sum(F.col("_len") * F.col("_c")) / F.max("_n")).cast("long").alias("mean_len"),
    )


def length_buckets(df: DataFrame, length: str, keys: list[str] | None = None, buckets=None) -> DataFrame:
    """Row count of every half-open length bucket, zeros included; longer rows are in none."""
    keys = keys or []
    buckets = rules.LENGTH_BUCKETS if buckets is None else buckets
    c = F.col(length)
    if not buckets:
        return df.select(*keys, F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("n")).limit(0)
    counted = df.groupBy(*keys).agg(
        *[F.count_if((c >= lo) & (c < hi)).alias(f"_{i}") for i, (lo, hi) in enumerate(buckets)]
    )
    pairs = F.array(*[
        F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.col(f"_{i}").alias("n"))
        for i, (lo, hi) in enumerate(buckets)
    ])
    return counted.select(*keys, F.inline(pairs))
