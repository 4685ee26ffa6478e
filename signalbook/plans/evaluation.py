"""Evaluation queries: answer extraction, rubric scores, roll-ups and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions import answers as ans
from signalbook.functions import scoring
from signalbook.operators import evals
from signalbook.plans.catalog import query, table
from signalbook.plans.fixtures import ANSWERS_SQL, answers, sql_text, strip_sql

# --- stored multiple-choice responses over orders --------------------------------------------
FORMS = {0: "Answer: {}", 1: "{}", 2: "  Option {} is right", 3: "I think (C)", 4: "It is {} or B", 5: "no idea"}


def _response(modulus):
    d = (F.col("o_custkey") % modulus).cast("string")
    out = None
    for i, form in FORMS.items():
        text = F.format_string(form.replace("{}", "%s"), d) if "{}" in form else F.lit(form)
        cond = F.col("o_orderkey") % 6 == i
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def mcq(spark, sf):
    """row_id, subject, answer, choices, response of two models, elapsed."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("subject"),
        (F.col("o_orderkey") % 5).cast("int").alias("answer"),
        F.array(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("string"), F.lit("None"), F.lit("All")).alias("choices"),
        _response(7).alias("response"), _response(5).alias("response_b"),
        (F.col("o_totalprice") / 100000).alias("elapsed"),
    )


def _response_sql(m):
    return "CASE o_orderkey % 6 " + " ".join(
        f"WHEN {i} THEN replace({sql_text(f)}, '{{}}', (o_custkey % {m})::VARCHAR)" for i, f in FORMS.items()) + " END"


MCQ_SQL = f"""mcq AS (SELECT o_orderkey AS row_id, o_orderpriority AS subject, (o_orderkey % 5)::INT AS answer,
  [o_orderpriority, o_orderstatus, o_custkey::VARCHAR, 'None', 'All'] AS choices, {_response_sql(7)} AS response, {_response_sql(5)} AS response_b,
  o_totalprice / 100000 AS elapsed FROM orders)"""


def _in_range(expr):
    return f"CASE WHEN {expr} < 5 THEN {expr} END"


def _num(x, pat, grp=1):
    return f"TRY_CAST(nullif(regexp_extract({x}, '{pat}', {grp}), '') AS INT)"


def _extract_sql(col, letter=True):
    t = strip_sql(col)
    steps = [_in_range(_num(t, r"^(\d)")), _in_range(_num(t, r"(?i)(?:answer|option|choice)[:\s]+(\d)")), _in_range(_num(f"{t}[1:50]", r"\b(\d)\b"))]
    let = rf"ascii(nullif(regexp_extract({t}[1:50], '\b([A-E])\b', 1), '')) - 65"
    if letter:
        steps.append(_in_range(let))
    return f"coalesce({', '.join(steps)}, -1)::INT"


_LOOSE = "coalesce(" + _num(strip_sql("response") + "[1:50]", r"\b([0-9])\b") + ", " + rf"ascii(nullif(regexp_extract({strip_sql('response')}[1:50], '\b([A-E])\b', 1), '')) - 65, -1)::INT"


@query("f15_mcq_prompt", f"""WITH {MCQ_SQL}, l AS (SELECT *, list_transform(range(5), lambda i: '  ' || i || ') ' || choices[i + 1] || chr(10)) AS a,
  list_transform(range(5), lambda i: '  ' || i || ': ' || choices[i + 1] || chr(10)) AS b FROM mcq)
  SELECT row_id, subject || '?' || chr(10) || chr(10) || array_to_string(a, '') || chr(10) || 'Respond with ONLY the number of the correct answer (e.g., 0, 1, 2, 3, or 4). Do not explain.' AS prompt,
  subject || '?' || chr(10) || chr(10) || 'Choices:' || chr(10) || array_to_string(b, '') || chr(10) || 'Answer with ONLY the number of the correct choice (0, 1, 2, etc.).' AS labelled FROM l""")
def prompts(spark, sf):
    q = F.concat("subject", F.lit("?"))
    return mcq(spark, sf).select(
        "row_id", ans.mcq_prompt(q, F.col("choices")).alias("prompt"), ans.mcq_prompt_labelled(q, F.col("choices")).alias("labelled"))


@query("f16_extract_answer", f"WITH {MCQ_SQL} SELECT row_id, {_extract_sql('response')} AS predicted FROM mcq")
def extract(spark, sf):
    return mcq(spark, sf).select("row_id", ans.extract_answer(F.col("response"), F.size("choices")).alias("predicted"))


@query("f17_extract_digit", f"WITH {MCQ_SQL} SELECT row_id, {_extract_sql('response', False)} AS predicted FROM mcq")
def extract_digit(spark, sf):
    return mcq(spark, sf).select("row_id", ans.extract_digit(F.col("response"), F.size("choices")).alias("predicted"))


@query("f18_extract_loose", f"WITH {MCQ_SQL} SELECT row_id, {_LOOSE} AS predicted FROM mcq")
def extract_loose(spark, sf):
    return mcq(spark, sf).select("row_id", ans.extract_loose(F.col("response")).alias("predicted"))


@query("a11_mcq_subject", f"WITH {MCQ_SQL} SELECT row_id, answer FROM mcq WHERE lower(subject) = '2-high'")
def by_subject(spark, sf):
    return evals.subject_filter(mcq(spark, sf), "2-High").select("row_id", "answer")


_PRED = f"{MCQ_SQL}, pr AS (SELECT *, {_extract_sql('response')} AS predicted FROM mcq)"
_ACC = f"""{_PRED}, acc AS (SELECT coalesce(subject, 'OVERALL') AS subject, count_if(predicted = answer)::BIGINT AS correct, count(*) AS total,
  count_if(predicted = answer) / count(*) AS accuracy, count_if(predicted = -1)::BIGINT AS unparsed, avg(elapsed) AS avg_elapsed FROM pr GROUP BY ROLLUP(subject))"""


def _predicted(spark, sf):
    return mcq(spark, sf).withColumn("predicted", ans.extract_answer(F.col("response"), F.size("choices")))


@query("g12_accuracy", f"WITH {_ACC} SELECT subject, correct, total, round(accuracy, 6) AS accuracy, unparsed, round(avg_elapsed, 6) AS avg_elapsed FROM acc")
def accuracy(spark, sf):
    acc = evals.accuracy(_predicted(spark, sf))
    return acc.withColumns({"accuracy": F.round("accuracy", 6), "avg_elapsed": F.round("avg_elapsed", 6)})


@query("g13_accuracy_matrix", f"""WITH {MCQ_SQL}, x AS (SELECT subject, {_extract_sql('response')} = answer AS a, {_extract_sql('response_b')} = answer AS b FROM mcq)
  SELECT coalesce(subject, 'OVERALL') AS subject, round(avg(a::INT), 6) AS acc_a, round(avg(b::INT), 6) AS acc_b, round(avg(b::INT) - avg(a::INT), 6) AS delta_b FROM x GROUP BY ROLLUP(subject)""")
def matrix(spark, sf):
    base = mcq(spark, sf)
    rows = base.select("subject", "answer", "choices", F.inline(F.array(
        F.struct(F.lit("a").alias("model"), F.col("response").alias("text")), F.struct(F.lit("b").alias("model"), F.col("response_b").alias("text")))))
    rows = rows.withColumn("predicted", ans.extract_answer(F.col("text"), F.size("choices")))
    out = evals.accuracy_matrix(rows, ["a", "b"])
    return out.select("subject", *[F.round(c, 6).alias(c) for c in ("acc_a", "acc_b", "delta_b")])


@query("s2_hardest_subjects", f"WITH {_ACC} SELECT subject, round(accuracy, 6) AS accuracy FROM acc WHERE subject <> 'OVERALL' ORDER BY acc.accuracy, subject LIMIT 3")
def hardest(spark, sf):
    return evals.hardest_subjects(evals.accuracy(_predicted(spark, sf))).select("subject", F.round("accuracy", 6).alias("accuracy"))


@query("w11_stratified_sample", f"WITH {MCQ_SQL} SELECT row_id, subject FROM mcq QUALIFY row_number() OVER (PARTITION BY subject ORDER BY md5(row_id || '-42')) <= 200")
def stratified(spark, sf):
    return evals.stratified_sample(mcq(spark, sf), 200, 42).select("row_id", "subject")


@query("s9_first_n", f"WITH {MCQ_SQL} SELECT row_id, subject FROM mcq ORDER BY row_id LIMIT 500")
def first_n(spark, sf):
    return evals.first_n(mcq(spark, sf), 500).select("row_id", "subject")


# --- concept coverage: every document answers one held-out item -------------------------------
def _concepts(spark, sf):
    stop = F.instr("text", ".")
    choice, rest = F.substring("text", F.lit(1), stop), F.substring("text", stop + 1, F.length("text"))
    items = table(spark, sf, "benchmark").select("item_id", ans.key_concepts(choice, rest).alias("concepts"))
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("subject"), F.col("text").alias("answer"), (F.col("doc_id") % items.agg(F.count(F.lit(1))).scalar()).alias("item_id"))
    return d.join(items, "item_id").withColumn("coverage", ans.concept_coverage(F.col("answer"), F.col("concepts")))


_STOP = "[" + ", ".join(sql_text(w) for w in rules.CONCEPT_STOPWORDS) + "]"
_TERM = r"'[a-z0-9][\p{L}\p{N}_\-]*[a-z0-9]|[a-z0-9]'"
_USE = "length({0}) >= 3 AND NOT list_contains(" + _STOP + ", {0})"
_CONC = f"""it AS (SELECT item_id, text[1:strpos(text, '.')] AS choice, text[strpos(text, '.') + 1:] AS explanation FROM benchmark),
tk AS (SELECT item_id, regexp_extract_all(lower(choice || ' ' || explanation), {_TERM}) AS w, regexp_extract_all(lower(choice), {_TERM}) AS cw FROM it),
bg AS (SELECT item_id, list_filter(w, lambda x: {_USE.format('x')}) AS s,
  list_transform(list_filter(range(1, len(cw)), lambda i: {_USE.format('cw[i]')} AND {_USE.format('cw[i + 1]')}), lambda i: cw[i] || ' ' || cw[i + 1]) AS b FROM tk),
al AS (SELECT item_id, list_concat(s, b) AS a FROM bg),
dd AS (SELECT item_id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:15] AS concepts FROM al),
cv AS (SELECT doc_id AS row_id, lang AS subject, concepts, list_filter(concepts, lambda c: contains(lower(d.text), c)) AS found FROM documents d JOIN dd ON d.doc_id % (SELECT count(*) FROM benchmark) = dd.item_id),
cs AS (SELECT *, CASE WHEN len(concepts) = 0 THEN 0.0 ELSE len(found) / len(concepts) END AS score FROM cv)"""


@query("f19_key_concepts", f"WITH {_CONC} SELECT row_id, array_to_string(concepts, '|') AS concepts FROM cv")
def key_concepts(spark, sf):
    return _concepts(spark, sf).select("row_id", F.array_join("concepts", "|").alias("concepts"))


@query("f20_concept_coverage", f"""WITH {_CONC} SELECT row_id, round(score, 6) AS score, array_to_string(found, '|') AS found,
  array_to_string(list_filter(concepts, lambda c: NOT list_contains(found, c)), '|') AS missing FROM cs""")
def coverage(spark, sf):
    return _concepts(spark, sf).select(
        "row_id", F.round("coverage.score", 6).alias("score"), F.array_join("coverage.found", "|").alias("found"),
        F.array_join("coverage.missing", "|").alias("missing"))


@query("g15_concept_summary", f"""WITH {_CONC} SELECT coalesce(subject, 'OVERALL') AS subject, round(avg(score), 6) AS avg_score, count(*) AS n,
  round(avg(len(found)), 6) AS avg_found, round(avg(len(concepts)), 6) AS avg_concepts FROM cs GROUP BY ROLLUP(subject)""")
def concept_summary(spark, sf):
    out = evals.concept_summary(_concepts(spark, sf))
    return out.select("subject", "n", *[F.round(c, 6).alias(c) for c in ("avg_score", "avg_found", "avg_concepts")])


# --- rubric scores over the answers -----------------------------------------------------------
# lang, category, expected domain, must contain, must not contain
RUBRIC = [
    ("en", "incident", "AMF", ["RSRP", "handover", "the", "root cause"], ["billing", "vendor"]),
    ("fr", "config", None, ["show", "les", "latency"], []),
    ("de", "knowledge", None, ["der", "und", "paging"], []),
    ("es", "kpi", "RAN", ["zzz"], ["los", "de", "la", "manual"]),
]


def _scored(spark, sf, every: bool = False):
    """Answers with the scorer of their language, or with every scorer."""
    r = spark.createDataFrame(RUBRIC, "lang string, category string, domain string, must array<string>, must_not array<string>")
    a, must = F.col("answer"), F.col("must")
    score = (
        F.when(F.col("category").isin("incident", "kpi"), scoring.score_incident(a, F.col("domain"), must, F.col("must_not")))
        .when(F.col("category") == "config", scoring.score_config(a, must))
        .otherwise(scoring.score_knowledge(a, must))
    )
    own = answers(spark, sf)
    langs = [x[0] for x in RUBRIC]
    # Answers in no or another language are held against the first rubric.
    key = F.explode(F.array(*[F.lit(x) for x in langs])) if every else F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(langs[0])
    rows = own.withColumn("_rubric", key).join(F.broadcast(r.withColumnRenamed("lang", "_rubric")), "_rubric")  # a fixed table of four rows
    return rows.withColumns({"score": score, "elapsed": F.length("answer") / 1000})


_LANGS = ", ".join(f"'{x[0]}'" for x in RUBRIC)


def _rubric_sql(pairs=f"answers a JOIN rb ON rb.lang = CASE WHEN a.lang IN ({_LANGS}) THEN a.lang ELSE '{RUBRIC[0][0]}' END"):
    def arr(xs):
        return "[" + ", ".join(sql_text(x) for x in xs) + "]::VARCHAR[]"
    rows = ", ".join(f"('{lg}', '{c}', {sql_text(d) if d else 'NULL'}, {arr(m)}, {arr(n)})" for lg, c, d, m, n in RUBRIC)

    def anyof(ws):
        return "(" + " OR ".join(f"contains(lo, '{w}')" for w in ws) + ")"
    extra = " + ".join(f"CASE WHEN {anyof(ws)} THEN 0.5::DOUBLE ELSE 0 END" for ws in (
        ["severity", "critical", "major"], ["cause", "reason", "probable"], ["resolution", "step", "action", "check"]))
    st = strip_sql("x")
    return f"""{ANSWERS_SQL}, rb(lang, category, domain, must, must_not) AS (VALUES {rows}),
r0 AS (SELECT a.*, category, domain, must, must_not, lower(answer) AS lo, string_split(answer, chr(10)) AS ln,
  list_filter(regexp_split_to_array(lower(answer), '\\s+'), lambda w: w <> '') AS wd FROM {pairs}),
r1 AS (SELECT *, len(list_filter(must, lambda k: contains(lo, lower(k)))) AS hit, len(list_filter(must_not, lambda k: contains(lo, lower(k)))) AS bad, {extra} AS ex,
  len(list_distinct(list_filter(list_transform(ln, lambda x: {st}), lambda x: x <> ''))) AS ul FROM r0),
sc AS (SELECT row_id, lang, category, length(answer) / 1000 AS elapsed, CASE
  WHEN category IN ('incident', 'kpi') THEN least((CASE WHEN contains(lo, lower(domain)) THEN 1 ELSE 0 END + hit - 0.5::DOUBLE * bad + ex) / greatest(1 + len(must) + ex, 1), 1)
  WHEN category = 'config' THEN least(greatest((CASE WHEN contains(answer, ':') AND contains(answer, chr(10)) THEN 1 ELSE 0 END + hit - CASE WHEN len(ln) > 10 AND ul / len(ln) < 0.5 THEN 1 ELSE 0 END) / (len(must) + 1), 0), 1)
  ELSE least(greatest((hit - CASE WHEN length(answer) - length(replace(answer, '|', '')) > 20 OR (length(answer) - length(replace(answer, '+--', ''))) / 3 > 5 THEN 1 ELSE 0 END
    - CASE WHEN len(wd) > 50 AND len(list_distinct(wd)) / len(wd) < 0.3 THEN 1 ELSE 0 END) / greatest(len(must), 1), 0), 1) END AS score FROM r1)"""


_SCORED = _rubric_sql()
_EVERY = _rubric_sql("(SELECT x.* EXCLUDE (lang), rb.lang FROM answers x, rb) a JOIN rb USING (lang)")
for _name, _cats in {"f21_score_incident": "'incident', 'kpi'", "f22_score_config": "'config'", "f23_score_knowledge": "'knowledge'"}.items():
    def _one(spark, sf, cats=_cats):
        return _scored(spark, sf, every=True).filter(f"category IN ({cats})").select("row_id", "category", F.round("score", 6).alias("score"))
    query(_name, f"WITH {_EVERY} SELECT row_id, category, round(score, 6) AS score FROM sc WHERE category IN ({_cats})")(_one)


@query("f24_score_routing", f"WITH {MCQ_SQL} SELECT row_id, CASE WHEN {_extract_sql('response')}::VARCHAR = answer::VARCHAR THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM mcq")
def routing(spark, sf):
    p = _predicted(spark, sf)
    return p.select("row_id", scoring.score_routing(F.col("predicted").cast("string"), F.col("answer").cast("string")).alias("score"))


def _flag_sql(name, ws):
    hit = " OR ".join(f"contains(lo, '{w}')" for w in ws)
    return f"SELECT row_id, '{name}', 'true' FROM r0 WHERE {hit}"


@query("f25_score_details", f"""WITH {_SCORED} SELECT row_id, 'domain' AS "check", CASE WHEN contains(lo, lower(domain)) THEN 'correct' ELSE 'wrong (expected ' || domain || ')' END AS outcome FROM r0 WHERE domain IS NOT NULL
  UNION ALL SELECT row_id, 'contains_' || k, contains(lo, lower(k))::VARCHAR FROM (SELECT row_id, lo, unnest(must) AS k FROM r0)
  UNION ALL SELECT row_id, 'wrongly_contains_' || k, 'true' FROM (SELECT row_id, lo, unnest(must_not) AS k FROM r0) WHERE contains(lo, lower(k))
  UNION ALL {_flag_sql('has_severity', scoring.SEVERITY_WORDS)} UNION ALL {_flag_sql('has_causes', scoring.CAUSE_WORDS)} UNION ALL {_flag_sql('has_resolution', scoring.RESOLUTION_WORDS)}""")
def details(spark, sf):
    d = scoring.score_details(F.col("answer"), F.col("domain"), F.col("must"), F.col("must_not"))
    return _scored(spark, sf).select("row_id", F.explode(d).alias("check", "outcome"))


@query("g14_rubric_summary", f"""WITH {_SCORED} SELECT coalesce(category, 'OVERALL') AS category, round(sum(score), 4) AS sum_score, count(*) AS n,
  round(avg(score), 6) AS avg_score, round(avg(elapsed), 6) AS avg_elapsed FROM sc GROUP BY ROLLUP(category)""")
def rubric_summary(spark, sf):
    out = evals.rubric_summary(_scored(spark, sf))
    return out.select("category", "n", F.round("sum_score", 4).alias("sum_score"), F.round("avg_score", 6).alias("avg_score"), F.round("avg_elapsed", 6).alias("avg_elapsed"))


@query("s1_worst_and_best", f"""WITH {_SCORED}, w AS (SELECT 'worst' AS part, row_id, score FROM sc ORDER BY score, row_id LIMIT 10), b AS (SELECT 'best' AS part, row_id, score FROM sc ORDER BY score DESC, row_id LIMIT 5)
  SELECT part, row_id, round(score, 6) AS score FROM w UNION ALL SELECT part, row_id, round(score, 6) FROM b""")
def worst_best(spark, sf):
    s = _scored(spark, sf).select("row_id", "score")
    parts = evals.worst(s).withColumn("part", F.lit("worst")).union(evals.best(s).withColumn("part", F.lit("best")))
    return parts.select("part", "row_id", F.round("score", 6).alias("score"))


# --- comparison of three model runs -----------------------------------------------------------
def _run(spark, sf, run):
    """Scores of a run by id: run 1 covers all documents, runs 2 and 3 the labelled ones."""
    if run == 1:
        return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 21) / 20).alias("score"))
    mark = "quality" if run == 2 else "toxic"
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), ((F.col(mark) * 10 + F.col("doc_id") % 11) / 20).alias("score"))


def _run_sql(run):
    if run == 1:
        return "SELECT doc_id AS id, (n_chars % 21) / 20 AS score FROM documents"
    return f"SELECT doc_id AS id, ({'quality' if run == 2 else 'toxic'} * 10 + doc_id % 11) / 20 AS score FROM labels"


def _diff_sql(a, b, name):
    return f"""{name} AS (SELECT coalesce(x.id, y.id) AS id, x.score AS old, y.score AS new, y.score - x.score AS delta,
  CASE WHEN y.id IS NULL THEN 'only_old' WHEN x.id IS NULL THEN 'only_new' WHEN y.score - x.score >= 0.05 THEN 'gains' WHEN y.score - x.score <= -0.05 THEN 'regressions' ELSE 'no_change' END AS kind
  FROM ({_run_sql(a)}) x FULL JOIN ({_run_sql(b)}) y ON x.id = y.id)"""


@query("c18_diff_results", f"WITH {_diff_sql(1, 2, 'd')} SELECT id, old, new, round(delta, 6) AS delta, kind FROM d")
def diff(spark, sf):
    return evals.diff_results(_run(spark, sf, 1), _run(spark, sf, 2)).withColumn("delta", F.round("delta", 6))


@query("c19_shared_regressions", f"WITH {_diff_sql(1, 2, 'd')}, {_diff_sql(1, 3, 'e')} SELECT id FROM d WHERE kind = 'regressions' AND id IN (SELECT id FROM e WHERE kind = 'regressions')")
def shared(spark, sf):
    a = _run(spark, sf, 1)
    return evals.shared_regressions([evals.diff_results(a, _run(spark, sf, 2)), evals.diff_results(a, _run(spark, sf, 3))])


@query("u5_zero_filled", f"WITH x AS ({_run_sql(1)}), y AS ({_run_sql(2)}) SELECT coalesce(x.id, y.id) AS id, coalesce(x.score, 0) AS old, coalesce(y.score, 0) AS new FROM x FULL JOIN y ON x.id = y.id")
def zero_fill(spark, sf):
    from signalbook.operators.profile import zero_filled

    return zero_filled(_run(spark, sf, 1), _run(spark, sf, 2), "id", "score")
