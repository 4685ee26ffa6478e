"""Registry of runnable queries and their independent SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Tables whose rows are worked on with costly expressions, and their keys.
ROW_KEYS = {
    "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "events": ["event_id"],
    "orders": ["o_orderkey"], "embeddings": ["vec_id"], "pages": ["page_id"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, *ROW_KEYS[name]) if name in ROW_KEYS else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute an input that splits into fewer parts than there are cores.

    Inputs of many splits, as all large ones are, stay as they are and cause no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
