"""Boilerplate lines by their frequency on a site.

For every host, the pages that contain a line are divided by the pages of the host; lines above a ratio are
boilerplate and are dropped from all pages of that host. DataFrame functions only.

Lines are counted by a 128-bit hash, a page counting once however often it has the line. Counting is
partial before the shuffle, by (host, line), so a host with a third of all pages is spread over its lines. The lines to drop meet
the pages by (host, line) as well: a host's boilerplate is never put together in one row.

Copies of a whole page are no evidence of boilerplate: a line counts once per distinct text of the host, over the distinct texts of the host,
so copies keep what only they have and stay for deduplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.llm.frames import join_checked, materialize

SMALL_PAGES, SMALL_RATIO = 3, 0.8


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line as two longs."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def _texts(pages: DataFrame, text: str, host: str) -> DataFrame:
    """The distinct texts of every host: host (null apart from empty), 128 bits of the text, and its lines."""
    own = F.coalesce(F.col(text), F.lit(""))
    rows = pages.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host"),
        F.xxhash64(own).alias("text_a"), F.xxhash64(F.lit("text"), own).alias("text_b"),
        F.transform(F.split(own, "\n"), lambda x: F.when(F.trim(x) != "", line_key(x))).alias("keys"))
    # Copies have the same lines, so one array of each text moves, not its lines.
    return rows.groupBy("host", "no_host", "text_a", "text_b").agg(F.first("keys").alias("keys"))


def _frequent(texts: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    totals = texts.groupBy("host", "no_host").agg(F.count(F.lit(1)).alias("host_pages"))
    found = F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))
    keys = texts.select("host", "no_host", F.explode(found).alias("key"))
    counts = keys.groupBy("host", "no_host", "key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min(min_pages, SMALL_PAGES))
    many = (F.col("pages") >= min_pages) & (F.col("pages") > ratio * F.col("host_pages"))
    nearly_all = (F.col("pages") >= SMALL_PAGES) & (F.col("pages") >= SMALL_RATIO * F.col("host_pages"))
    return counts.join(totals, ["host", "no_host"]).filter(many | nearly_all).select("host", "no_host", "key", "pages", "host_pages")


def site_lines(pages: DataFrame, ratio: float = 0.1, min_pages: int = 5, text: str = "text", host: str = "source") -> DataFrame:
    """host, no_host, key, pages, host_pages of the boilerplate lines.

    A line is one if it is on more than ``ratio`` of a host's distinct pages and on ``min_pages`` of them at least or, on small hosts, on 80 % of them
    and on three at least. Empty lines are never boilerplate. Pages without a host form one host of their own.
    """
    return _frequent(_texts(pages, text, host), ratio, min_pages)


def drop_site_lines(pages: DataFrame, ratio: float = 0.1, min_pages: int = 5, text: str = "text", host: str = "source") -> DataFrame:
    """``pages`` with the boilerplate lines of their host removed from ``text``; all columns and rows stay.

    Adds ``_lines_dropped`` (a column of that name is replaced; names that begin with ``__line_`` are not allowed). A page that loses nothing keeps its text as it is, null included; a
    page of nothing but boilerplate becomes the empty text. Repeated rows and copies are one page where lines are counted, and each
    loses the lines.
    """
    if taken := [c for c in pages.columns if c.startswith("__line_")]:
        raise ValueError(f"columns {taken} are named as this operator's own")
    texts = materialize(_texts(pages, text, host))
    bad = materialize(_frequent(texts, ratio, min_pages).select("host", "no_host", "key"))
    numbered = texts.select("host", "no_host", "text_a", "text_b", F.posexplode("keys").alias("at", "key")).filter("key is not null")
    # The numbers of the lines to drop, for the texts that lose some.
    lost = join_checked(numbered, bad, ["host", "no_host", "key"], "left_semi").groupBy("host", "no_host", "text_a", "text_b").agg(F.collect_set("at").alias("at"))
    lost = materialize(lost.toDF("__line_host", "__line_no_host", "__line_a", "__line_b", "__line_at"))
    own = F.coalesce(F.col(text), F.lit(""))
    marked = join_checked(
        pages.withColumns({
            "__line_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "__line_no_host": F.col(host).isNull(),
            "__line_a": F.xxhash64(own), "__line_b": F.xxhash64(F.lit("text"), own)}),
        lost, ["__line_host", "__line_no_host", "__line_a", "__line_b"])
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("__line_at"), i))
    dropped = F.coalesce(F.size("__line_at"), F.lit(0))
    return (
        marked.withColumn("_lines_dropped", F.when(F.col("__line_at").isNotNull(), dropped).otherwise(0).cast("long"))
        .withColumn(text, F.when(F.col("__line_at").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)))
        .drop("__line_host", "__line_no_host", "__line_a", "__line_b", "__line_at")
    )
