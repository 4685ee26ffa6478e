"""Queries with rule tables of thousands of rows, made from the first words of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbook.operators import patterns
from signalbook.plans.catalog import query, table
from signalbook.session import materialize

# Five pairs of words from the start of every document; their label is the first letter, the longest comes first.
RULES_SQL = r"""
ws AS (SELECT list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
rules AS (SELECT DISTINCT w[2 * i + 1] || ' ' || w[2 * i + 2] AS rule_id FROM ws, range(5) r(i) WHERE len(w) >= 2 * i + 2),
hits AS (SELECT doc_id, rule_id FROM documents JOIN rules ON contains(lower(text), rule_id))"""


def rule_table(spark, sf):
    # Ten words need no more than eleven cuts, one of them after white space at the start.
    w = F.filter(F.split(F.lower("text"), r"\s+", 12), lambda x: x != "")
    words = table(spark, sf, "documents").select(w.alias("w"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.array_join(F.slice("w", 2 * i + 1, 2), " "))).alias("rule_id"))
    whole = pairs.filter(F.col("rule_id").contains(" ")).distinct()
    return whole.select(
        "rule_id", F.col("rule_id").alias("pattern"), F.substring("rule_id", 1, 1).alias("label"), (-F.length("rule_id")).alias("priority"))


def _found(spark, sf, *keep):
    d, rules = table(spark, sf, "documents"), materialize(rule_table(spark, sf))
    return d, rules, patterns.rule_matches(d, rules, "doc_id", "text", keep=keep)


@query("f6_rule_labels", f"""WITH {RULES_SQL}, best AS (SELECT doc_id, min({{'p': -length(rule_id), 'l': left(rule_id, 1)}}) AS b FROM hits GROUP BY doc_id)
  SELECT doc_id, b.l AS label FROM documents LEFT JOIN best USING (doc_id)""")
def rule_labels(spark, sf):
    """Every document with the label of its first rule."""
    d, rules, found = _found(spark, sf, "label", "priority")
    return patterns.first_label(d.select("doc_id"), found, rules, "doc_id").select("doc_id", "label")


@query("g8_rule_coverage", f"""WITH {RULES_SQL}, n AS (SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id)
  SELECT rule_id, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM documents), 6) AS share FROM rules LEFT JOIN n USING (rule_id)""")
def rule_coverage(spark, sf):
    """Documents with each rule, and their share."""
    d, rules, found = _found(spark, sf)
    repeated = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return patterns.rule_coverage(found, rules, d.count(), key="doc_id", repeated=repeated)
