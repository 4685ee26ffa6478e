"""Running computations over long ordered groups, in two levels.

A plain window puts a whole group into one task. Here every group is cut into buckets along its
order: each bucket is summarized with a partial aggregate, the (small) summaries are scanned, and
the carried-in value is joined back to the rows of its bucket. A group holding a third of all rows
is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values to ``df``.

    ``sums``: inclusive running integer sums. ``lasts``: last non-null value of strictly earlier
    rows. ``totals``: integer sums over the whole group. ``bucket`` must never decrease along
    ``order`` and should hold a bounded number of rows.
    """
    sums, lasts, totals = sums or {}, lasts or {}, totals or {}
    part = keys + ["_bucket"]
    rows = df.withColumn("_bucket", bucket)
    position = F.struct(*[F.col(c) for c in order])
    aggs = [F.sum(v).alias(f"_s_{k}") for k, v in sums.items()]
    aggs += [F.sum(v).alias(f"_t_{k}") for k, v in totals.items()]
    aggs += [
        F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_l_{k}") for k, v in lasts.items()
    ]
    summary = rows.groupBy(*part).agg(*aggs)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *part,
        *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(W.partitionBy(*keys)).alias(k) for k in totals],
        *[F.last(f"_l_{k}", ignorenulls=True).over(earlier).alias(f"_l_{k}") for k in lasts],
    )
    inside = W.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    joined = rows.join(carried, part)
    out = {k: F.sum(v).over(upto) + F.col(f"_s_{k}") for k, v in sums.items()}
    out |= {
        k: F.coalesce(F.last(v, ignorenulls=True).over(before), F.col(f"_l_{k}"))
        for k, v in lasts.items()
    }
    drop = ["_bucket"] + [f"_s_{k}" for k in sums] + [f"_l_{k}" for k in lasts]
    return joined.withColumns(out).drop(*drop) if out else joined.drop(*drop)


def span_bucket(col: str, rows: int = 65536) -> Column:
    """Bucket of a unique integer key: at most ``rows`` rows each, whatever the distribution.

    Meant for row numbers as the readers assign them; very sparse ids give many small buckets, so
    number such rows first.
    """
    return F.floor(F.col(col) / F.lit(rows)).cast("long")


def hex_bucket(col: str) -> Column:
    """Bucket of an md5 order column: at most 65,536 evenly filled buckets."""
    return F.substring(F.col(col), 1, 4)


def positions(
    df: DataFrame, order: list[str], bucket: Column, keys: list[str] | None = None,
    out: str = "pos", total: str | None = None,
) -> DataFrame:
    """Zero-based position along ``order`` within ``keys``, and optionally the group size."""
    ranked = running(
        df, keys or [], order, bucket,
        sums={out: F.lit(1)}, totals={total: F.lit(1)} if total else None,
    )
    return ranked.withColumn(out, (F.col(out) - 1).cast("long"))


def with_halo(df: DataFrame, keys: list[str], pos: str, before: int, rows: int = 4096) -> DataFrame:
    """Cut groups into blocks of ``rows`` positions and repeat the last ``before`` rows of each
    block at the head of the next, so that bounded look-back windows fit inside one block.

    Adds ``_block`` and ``_halo`` (true for repeated rows, to be dropped after the window).
    """
    own = F.floor(F.col(pos) / rows).cast("long")
    tail = F.col(pos) % rows >= rows - before
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_halo", F.col("_block") != own)
