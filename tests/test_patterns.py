"""Rule tables as DataFrames against plain search; empty tables everywhere."""

import random

import pytest
from pyspark.sql import functions as F

from signalbook.functions import cleaning
from signalbook.operators import evidence, mix, patterns, profile, quality

RULES = "rule_id long, pattern string, label string, priority int"


def places(text, pattern, whole):
    text, pattern, n = text.lower(), pattern.lower(), 0
    word = lambda c: c.isalnum() or c == "_"
    for i in range(len(text) - len(pattern) + 1):
        if text.startswith(pattern, i):
            end = i + len(pattern)
            inside = i and word(text[i - 1]) and word(text[i]) or end < len(text) and word(text[end - 1]) and word(text[end])
            n += not (whole and inside)
    return n


@pytest.mark.parametrize("whole, part_bytes", [(False, 1 << 20), (True, 1 << 20), (False, 2000)])
def test_rule_matches(spark, whole, part_bytes):
    """Five thousand rules in one pass, or in several passes of a few rules each."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abÉ ") for _ in range(rng.randrange(1, 6)))
    count = 5000 if part_bytes > 2000 else 120
    rules = [(i, word(), rng.choice("xyz"), rng.randrange(9)) for i in range(count)] + [(1, "A", "x", 0), (1, "A", "x", 0), (2, None, "y", 0), (3, "", "y", 0)]
    texts = [(i, " ".join(word() for _ in range(6))) for i in range(40)] + [(90, None), (91, ""), (5, "a")]
    df, table = spark.createDataFrame(texts, "row_id long, text string"), spark.createDataFrame(rules, RULES)
    got = patterns.rule_matches(df.withColumn("n", F.lit(1)), table, whole_words=whole, part_bytes=part_bytes)
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan
    want = []
    listed = {(r, p.lower()) for r, p, *_ in rules if p}
    for key, text in texts:
        sums = {}
        for r, p in listed:
            if text and (n := places(text, p, whole)):
                sums[r] = sums.get(r, 0) + n
        want += [(key, r, n) for r, n in sums.items()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_labels_and_coverage(spark):
    rules = spark.createDataFrame([(1, "alarm", "ops", 2), (2, "cell", "ran", 1), (3, "mme", "core", 1), (4, "none", "x", 0)], RULES)
    df = spark.createDataFrame([(1, "Alarm on a CELL and MME"), (2, "an alarm"), (3, "nothing"), (4, None)], "row_id long, text string")
    found = patterns.rule_matches(df, rules)
    assert {r.row_id: r.label for r in patterns.first_label(df, found, rules).collect()} == {1: "core", 2: "ops", 3: None, 4: None}
    assert sorted(map(tuple, patterns.rule_coverage(found, rules, 4).collect())) == [(1, 2, 0.5), (2, 1, 0.25), (3, 1, 0.25), (4, 0, 0.0)]
    assert patterns.rule_matches(df, rules.filter("false")).collect() == []


def test_empty_tables_have_no_entries(spark):
    df = spark.createDataFrame([("what if the prb load is 45%?", "Hope this helps!")], "q string, a string")
    q, a = F.col("q"), F.col("a")
    row = df.select(
        quality.shallow_count(a, []).alias("shallow"), quality.specificity(a, []).alias("specific"), quality.first_topic(q, a, {}).alias("topic"),
        cleaning.infer_domain(q, a, F.lit("ran"), {}).alias("domain"), cleaning.has_domain_tag(F.lit("[] x"), []).alias("tag"),
        cleaning.strip_trailing_followups(a, [], []).alias("kept")).first()
    assert tuple(row) == (0, 0, None, None, False, "Hope this helps!")
    assert [(r.topic, r.n) for r in quality.topic_coverage(df, "q", "a", {}).collect()] == [("unclassified", 1)]
    assert profile.length_buckets(df.withColumn("len", F.length("q")), "len", None, []).collect() == []
    bank = spark.createDataFrame([("x", "y", 0)], "archetype string, preview string, pos int")
    assert mix.seeds_for(bank, {}).collect() == []
    plan = spark.createDataFrame([("i", 1, "kpi_lookup", "c", "s", "r")], "inv_id string, step int, tool string, cell_id string, site_id string, region string")
    assert evidence.complete_plan(plan, []).count() == 1


def test_topics_lower_the_text_once(spark):
    """However many keywords there are, question and answer are lower-cased once each."""
    topics = {f"t{i}": [f"word{i}x", f"term{i}x"] for i in range(30)}
    rows = [("A WORD7X here", "none"), ("none", "Term3x and WORD7x"), ("x", "y"), (None, "word1x"), ("term29", "X")]
    df = spark.createDataFrame(rows, "q string, a string")
    out = df.repartition(2).select("q", "a", quality.first_topic(F.col("q"), F.col("a"), topics).alias("topic"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    assert {(r.q, r.a): r.topic for r in out.collect()} == dict(zip(rows, ["t7", "t3", None, None, None]))


def test_rules_are_derived_once_for_all_parts(spark):
    """Many parts of a table that a job derives do not run that job many times."""
    seen = spark.sparkContext.accumulator(0)

    def derive(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    made = [(i, f"word{i}x", "a", 0) for i in range(200)]
    table = spark.createDataFrame(made, RULES).repartition(2).mapInPandas(derive, RULES)
    df = spark.createDataFrame([(1, "word3x WORD199X"), (2, "word0x")], "row_id long, text string")
    got = patterns.rule_matches(df, table, part_bytes=2000)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 1), (1, 199, 1), (2, 0, 1)]
    assert seen.value == 200


@pytest.mark.parametrize("whole, part_bytes, block_chars", [(False, 1 << 20, 1 << 17), (True, 1500, 40), (False, 1500, 40)])
def test_rules_in_parts_and_texts_in_pieces(spark, whole, part_bytes, block_chars):
    """Parts by length and texts longer than a block give the same rows, each (row, rule) once; letters of all widths, and zero."""
    rng = random.Random(2)
    word = lambda most: "".join(rng.choice("ab é界😀\0") for _ in range(rng.randrange(1, most)))
    rules = [(rng.randrange(60), word(rng.choice([3, 6, 24])), rng.choice("xyz"), rng.randrange(9)) for _ in range(90)]
    texts = [(i, "".join(word(9) for _ in range(rng.choice([1, 8, 60]))) + rules[i][1]) for i in range(30)] + [(7, "again a"), (None, "a b"), (31, "")]
    df, table = spark.createDataFrame(texts, "row_id long, text string"), spark.createDataFrame(rules, RULES)
    got = patterns.rule_matches(df.repartition(2), table, whole_words=whole, part_bytes=part_bytes, block_chars=block_chars)
    want = []
    listed = {(r, p.lower()) for r, p, *_ in rules}
    for key, text in texts:
        sums = {}
        for r, p in listed:
            if n := places(text, p, whole):
                sums[r] = sums.get(r, 0) + n
        want += [(key, r, n) for r, n in sums.items()]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(want)


def test_patterns_of_one_hash_are_told_apart(spark):
    """The hash of these two strings is the same for any base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    table = spark.createDataFrame([(1, one, "x", 0), (2, other, "y", 0)], RULES)
    df = spark.createDataFrame([(1, "c" + one + "c"), (2, other), (3, one[:-1])], "row_id long, text string")
    assert sorted(map(tuple, patterns.rule_matches(df, table).collect())) == [(1, 1, 1), (2, 2, 1)]


def test_kept_labels_are_those_of_a_join(spark):
    """All values that a rule is listed with count, also beside an empty pattern; null rules have no label."""
    rules = spark.createDataFrame([(1, "cell", "b", 2), (1, "", "a", 1), (1, None, "z", 1), (1, "mme", "c", 3), (2, None, "q", 0), (None, "cell", "n", 0)], RULES)
    df = spark.createDataFrame([(1, "a cell"), (1, "an MME"), (2, "mme cell"), (3, "none"), (None, "cell")], "row_id long, text string")
    plain, kept = (patterns.rule_matches(df, rules, keep=keep) for keep in ((), ("label", "priority")))
    assert plain.count() == 7 and kept.count() == 4 * 4 + 3
    labels = [sorted(map(str, patterns.first_label(df, found, rules).collect())) for found in (plain, kept)]
    assert labels[0] == labels[1] and sum("label='a'" in x for x in labels[1]) == 3


def test_rule_queries_do_not_move_matches(spark, tmp_path):
    """Matches are counted and labelled where they are found; keys that come twice still count once."""
    from signalbook.plans import rule_tables

    rng = random.Random(4)
    texts = ["  " * (i % 2) + " ".join(rng.choice(["Ab", "ba", "cab", "d"]) for _ in range(rng.choice([1, 9, 11, 30]))) + "\n" for i in range(40)]
    docs = [(i % 37, t) for i, t in enumerate(texts)] + [(None, "ab ba"), (None, "d ab ba"), (50, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [(t or "").lower().split() for _, t in docs]
    rules = {f"{w[i]} {w[i + 1]}" for w in words for i in range(0, 10, 2) if len(w) >= i + 2}
    coverage = rule_tables.rule_coverage(spark, str(tmp_path))
    assert {r.rule_id: r.n for r in coverage.collect()} == {x: len({k for k, t in docs if t and x in t.lower()}) for x in rules}
    labels = rule_tables.rule_labels(spark, str(tmp_path))
    best = {}
    for k, t in docs:
        if k is not None and t:
            best[k] = min([best.get(k, (0, None)), *[(-len(x), x[0]) for x in rules if x in t.lower()]], key=lambda b: (b[0], b[1] or ""))
    assert {r.doc_id: r.label for r in labels.collect()} == {k: best.get(k, (0, None))[1] for k, _ in docs}
    for plan in (x._jdf.queryExecution().sparkPlan().toString() + x._jdf.queryExecution().executedPlan().toString() for x in (coverage, labels)):
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(rule_id" in line and "doc_id" in line]
