"""Specification files, file inventory and scenario tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.operators.scans import positions, span_bucket


def path_metadata(relative: Column) -> dict[str, Column]:
    """release, series, spec, filename and source from a relative path; ``unknown`` where absent."""
    parts = F.split(relative, "/")
    filename = F.element_at(parts, -1)
    return {
        "release": F.get(parts, F.lit(0)),
        "series": F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")),
        "spec": F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""),
        "filename": filename,
        "source": relative,
    }


def read_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files below ``folder`` with the metadata of their path."""
    files = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder))
    # Paths come URL-encoded; a plus sign stands for itself there.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    relative = F.substring(path, F.locate(root, path) + len(root), F.length(path))
    return files.select(F.col("value").alias("text"), relative.alias("_rel")).withColumns(path_metadata(F.col("_rel"))).drop("_rel")


def inventory(df: DataFrame, path: str, size: str) -> DataFrame:
    """Files and bytes per lower-cased extension; the row without an extension (null) holds the totals.

    Files whose name has no extension are under the empty one. An empty table gives no row.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
    return df.select(F.coalesce(ext, F.lit("")).alias("extension"), F.col(size).alias("_size")).rollup("extension").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("_size"), F.lit(0)).cast("long").alias("bytes"))


def file_inventory(spark: SparkSession, folder: str, top: int = 20, totals: bool = False) -> DataFrame:
    """Files and bytes of the ``top`` most frequent extensions, with ``totals`` also of all files (extension null).

    Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    counts = inventory(files, "path", "length")
    every, each = counts.filter(F.col("extension").isNull()), counts.filter(F.col("extension").isNotNull())
    most = each.orderBy(F.desc("files"), "extension").limit(top)
    return every.union(most) if totals else most


def top_dirs(df: DataFrame, path: str) -> DataFrame:
    first = F.split(F.col(path), "/")[0]
    return df.filter(F.contains(F.col(path), F.lit("/"))).select(first.alias("dir")).filter(~F.col("dir").startswith(".")).distinct()


def scenario_bank(df: DataFrame, archetype="archetype", preview="question_preview", row="row_id") -> DataFrame:
    """Scenarios of every archetype in input order, in long form: (archetype, pos, preview, n).

    An archetype may hold any share of the rows, so its list is kept as numbered rows.
    """
    rows = df.select(F.col(archetype).alias("archetype"), F.col(preview).alias("preview"), row)
    return positions(rows, [row], span_bucket(row), keys=["archetype"], total="n").drop(row)


def load_scenarios(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with archetype and question_preview columns as a scenario bank.

    Quoted previews may hold line ends, so a file is read by one task; without them (``multi_line=False``) large files
    are split.
    """
    rows = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return scenario_bank(rows.withColumn("row_id", F.monotonically_increasing_id()))
