"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.frames import materialize, shuffles_dropped


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node with a link to a smaller one.

    ``links``: columns a, b, in any order and with repeats. Stars are enlarged and contracted in turn until
    nothing changes, which takes a logarithmic number of rounds; each round works on the links only, with
    partial aggregation, and its result is written so that lineage stays short. Roots are not listed.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct())
    before = None
    while True:
        with shuffles_dropped(edges.sparkSession):
            state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(small.union(least).distinct())
