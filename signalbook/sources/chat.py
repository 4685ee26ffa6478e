"""Line-delimited JSON sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.operators.scans import positions

CHAT_SCHEMA = "messages array<struct<role:string,content:string>>, category string, subcategory string, source string"
MCQ_SCHEMA = "question string, choices array<string>, answer int, subject string, explanation string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): non-blank lines numbered in file order, whatever the partitioning.

    File, block offset and the order inside the block place a line; a block is one bucket.
    """
    lines = spark.read.text(path).select(
        "value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line")).filter(F.trim("value") != "")
    return positions(lines, ["_block", "_line"], F.col("_block"), out="row_id").select("row_id", "value")


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Chat records with ``parse_ok``; broken lines stay as rows so that they can be counted.

    ``issue`` marks JSON values that are not objects.
    """
    return parse_chat(read_lines(spark, path))


def parse_chat(lines: DataFrame) -> DataFrame:
    """Chat records of numbered JSON lines (row_id, value), one row per line."""
    parsed = lines.select(
        "row_id", F.try_parse_json("value").alias("v"),
        F.from_json("value", CHAT_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    return parsed.select(
        "row_id", F.col("v").isNotNull().alias("parse_ok"),
        F.when(F.col("v").isNotNull() & ~is_object, "not a dict").alias("issue"), "r.*")


def read_mcq(spark: SparkSession, path: str, subject: str | None = None) -> DataFrame:
    df = spark.read.schema(MCQ_SCHEMA).json(path)
    return df if subject is None else df.filter(F.lower("subject") == subject.lower())


def write_chat(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; absent fields are left out and non-ASCII text is kept."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def chat_lines(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``value``: the other columns as one JSON object, as ``write_chat`` stores them."""
    fields = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


def report_document(metrics: DataFrame) -> DataFrame:
    """value: one-row metrics as a JSON document."""
    return metrics.select(F.to_json(F.struct("*")).alias("value"))


def write_report(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One-row metrics as a single JSON document."""
    report_document(metrics).coalesce(1).write.mode(mode).text(path)


def rows_to_append(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``stored`` does not hold, one row per key."""
    return df.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def append_new(df: DataFrame, target: str, key: str) -> None:
    """Append the rows whose key the Parquet table at ``target`` does not hold yet, one row per key."""
    try:
        rows = rows_to_append(df, df.sparkSession.read.parquet(target), key)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rows = df.dropDuplicates([key])
    rows.write.mode("append").parquet(target)


def union_sources(sources: dict[str, DataFrame | None]) -> DataFrame:
    """Union of the inputs that exist, columns filled with null where absent, tagged by name."""
    out = None
    for name, df in sources.items():
        if df is None:
            continue
        tagged = df.withColumn("source_name", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source exists")
    return out


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
