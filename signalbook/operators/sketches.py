"""Quantiles that can be stored per period and merged later.

An exact profile (``profile.length_profile``) needs all counts at hand. For streams and for reports that grow by a day at a time,
each group keeps a KLL sketch of a few kilobytes instead; sketches of periods, tasks or sources merge into one with the same
error. Results carry the bound of the rank error that goes with their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 400  # larger sketches have smaller errors


def rank_error(size: int = SIZE) -> float:
    """How far, as a share of all values, a quantile's rank may be off (with 99 % confidence); groups of fewer than ``size``
    values are exact."""
    return 2.296 / size**0.9723


def quantile_states(df: DataFrame, value: str, keys: list[str], size: int = SIZE) -> DataFrame:
    """keys, n, least, most, sketch: one mergeable state per group; nulls and NaN are left out, groups of nothing else have no
    state. Streams are grouped by a window in ``keys`` and keep one state per window."""
    if not 8 <= size <= 65535:
        raise ValueError("the size of a sketch is 8 to 65535")
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, size).alias("sketch"))


def quantile_stream(stream: DataFrame, value: str, keys: list[str], time: str, slot: str = "1 hour", delay: str = "1 hour", size: int = SIZE) -> DataFrame:
    """keys, start, n, least, most, sketch for every closed time slot of a stream, to be stored and merged."""
    timed = stream.withWatermark(time, delay).withColumn("_slot", F.window(time, slot))
    found = quantile_states(timed, value, ["_slot", *keys], size)
    return found.select(*keys, F.col("_slot.start").alias("start"), "n", "least", "most", "sketch")


def merge_states(states: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """The states of all rows of a group as one; partial merges happen before the shuffle."""
    return states.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def quantiles(states: DataFrame, shares: dict[str, float], size: int = SIZE) -> DataFrame:
    """The states without their sketches, a column for each of ``shares`` (name -> share of the values at or below) and ``rank_error``."""
    for share in shares.values():
        if not 0 <= share <= 1:
            raise ValueError("shares are between 0 and 1")
    kept = [c for c in states.columns if c != "sketch"]
    error = F.when(F.col("n") < size, 0.0).otherwise(rank_error(size))
    return states.select(
        *kept, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias(k) for k, s in shares.items()], error.alias("rank_error"))
