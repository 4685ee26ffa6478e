"""Helpers shared by the operators: tables cut from their lineage, joins with a checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.session import materialize, shuffles_dropped

__all__ = ["bounded_batches", "join_checked", "materialize", "shuffles_dropped"]

# Rows of a batch between the JVM and Python: texts may be long, and both sides hold whole batches.
ROWS_PER_BATCH = 1000

# Rows and bytes up to which a side may be broadcast, far below what an executor's memory holds.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join with a materialized ``right`` side: broadcast if it is counted and found small, else shuffled,
    where adaptive execution splits hot keys of ``left``."""
    columns = [F.length(F.to_json(F.struct(*right.columns)))]
    with shuffles_dropped(right.sparkSession):
        rows, size = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(columns[0]), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right.hint("merge"), keys, how)


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of few enough rows for long texts; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name, "0") or 0)
    if not 0 < rows <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))
    return spark
