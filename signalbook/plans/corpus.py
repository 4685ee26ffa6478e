"""Chat-corpus queries: validation, cleaning, tagging, quality gate, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions import cleaning, text
from signalbook.operators import chat as chat_ops
from signalbook.operators import dedup, profile, quality, similarity
from signalbook.plans.catalog import query, table
from signalbook.plans.fixtures import (
    ANSWERS_SQL, CHAT_SQL, SOURCES_SQL, answers, chat, new_and_base, sql_text, strip_sql, turns,
)

# A small domain rule table over words that occur in the tables.
WORD_DOMAINS = {"RAN": ["the", "of", "and"], "Core": ["de", "la", "le"], "Transport": ["der", "die", "und"], "IMS": ["el", "los", "en"]}
WORD_RULES = {d: [rf"\b(?:{'|'.join(ws)})\b"] for d, ws in WORD_DOMAINS.items()}


# --- validation and turns --------------------------------------------------------------------
_ISSUE = """CASE WHEN len(messages) <> 3 THEN 'messages length=' || len(messages)
  WHEN list_transform(messages, lambda m: m.role) <> ['system','user','assistant']
    THEN 'wrong roles: [' || array_to_string(list_transform(messages, lambda m: chr(39) || m.role || chr(39)), ', ') || ']'
  WHEN len(list_filter(messages, lambda m: m.content = '')) > 0 THEN 'empty content' END"""


@query("b1_validate_chat", f"WITH {CHAT_SQL} SELECT row_id, {_ISSUE} AS issue FROM chat")
def validate(spark, sf):
    return chat_ops.validate_chat(chat(spark, sf)).select("row_id", "issue")


@query("b2_validate_roles", f"""WITH {CHAT_SQL} SELECT row_id,
  list_contains(list_transform(messages, lambda m: m.role), 'user')
  AND list_contains(list_transform(messages, lambda m: m.role), 'assistant') AS roles_ok FROM chat""")
def roles(spark, sf):
    return chat_ops.validate_roles(chat(spark, sf)).select("row_id", "roles_ok")


_Q = f"""coalesce({strip_sql("list_filter(messages, lambda m: m.role = 'user')[1].content")}, '')"""


@query("b3_question", f"WITH {CHAT_SQL} SELECT row_id, {_Q} AS question FROM chat")
def question(spark, sf):
    return chat(spark, sf).select("row_id", chat_ops.question(F.col("messages")).alias("question"))


_LAST_USER = "coalesce(list_filter(messages, lambda m: m.role = 'user')[-1].content, '')"
_LAST_ASST = "list_filter(messages, lambda m: m.role = 'assistant')[-1].content"


@query("b4_last_turns", f"""WITH {CHAT_SQL} SELECT row_id, {_LAST_USER} AS last_user, {_LAST_ASST} AS last_assistant,
  list_max(list_transform(range(len(messages)), lambda i: CASE WHEN messages[i + 1].role = 'assistant' THEN i END))
    AS assistant_index FROM chat""")
def last_turns(spark, sf):
    m = F.col("messages")
    return chat(spark, sf).select(
        "row_id", chat_ops.last_user(m).alias("last_user"), chat_ops.last_assistant(m).alias("last_assistant"),
        chat_ops.last_assistant_index(m).cast("long").alias("assistant_index"),
    )


@query("b5_to_chat", """SELECT doc_id AS row_id, 'You answer.' || '|' || source || '|' || text AS chat,
  CASE WHEN lang = 'en' THEN lang ELSE 'general' END AS category FROM documents""")
def to_chat(spark, sf):
    pairs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("instruction"), F.col("text").alias("response"),
        F.when(F.col("lang") == "en", F.col("lang")).alias("category"),
    )
    made = chat_ops.to_chat(pairs, "You answer.")
    joined = F.array_join(F.transform("messages", lambda m: m["content"]), "|")
    return made.select("row_id", joined.alias("chat"), "category")


@query("a3_messages_only", f"""WITH {CHAT_SQL} SELECT array_to_string(list_transform(messages, lambda m: m.role || ': ' || m.content), chr(10))
  AS shown FROM chat""")
def messages_only(spark, sf):
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return chat_ops.to_messages_only(chat(spark, sf)).select(F.array_join(shown, "\n").alias("shown"))


@query("b8_accept_pairs", f"""WITH {CHAT_SQL}, p AS (SELECT row_id, {_LAST_USER} AS question, {_LAST_ASST} AS answer FROM chat)
  SELECT row_id, question, answer FROM p WHERE answer IS NOT NULL AND length(answer) > 100""")
def accept(spark, sf):
    m = F.col("messages")
    pairs = chat(spark, sf).select(
        "row_id", chat_ops.last_user(m).alias("question"), chat_ops.last_assistant(m).alias("answer"))
    return chat_ops.accept_pairs(pairs)


@query("b12_keep_category", f"WITH {CHAT_SQL} SELECT row_id FROM chat WHERE category = 'core'")
def keep_core(spark, sf):
    return chat_ops.keep_category(chat(spark, sf), "core").select("row_id")


# --- cleaning --------------------------------------------------------------------------------
_ASKS = sql_text("(?i)" + text.any_of(*rules.TRAILING_FOLLOWUPS))
_FILL = sql_text("(?i)^" + text.any_of(*rules.FILLERS))
_REST = sql_text("(?i)" + text.any_of(*rules.RESTATEMENTS))


def _rstrip(x):
    return rf"regexp_replace({x}, '\s+$', '')"


def _cut_tail(src, col, out):
    """CTE: ``out`` adds t1, the text of ``col`` without trailing follow-ups."""
    line = strip_sql("l[i]")
    return f"""{out}_l AS (SELECT *, string_split({_rstrip(col)}, chr(10)) AS l FROM {src}),
{out}_k AS (SELECT *, list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN {line} <> ''
  AND NOT regexp_matches({line}, {_ASKS}) AND NOT regexp_matches({line}, {_FILL}) THEN i END)) AS k FROM {out}_l),
{out} AS (SELECT * EXCLUDE (l, k), CASE WHEN k < len(l) THEN {_rstrip("array_to_string(l[1:k], chr(10))")} ELSE {col} END AS t1 FROM {out}_k)"""


def _cut_head(src, user, col, out):
    words = r"list_distinct(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]{{4,}}'))"
    return rf"""{out}_c AS (SELECT *, CASE WHEN strpos({col}[2:], chr(10)) > 0 THEN strpos({col}[2:], chr(10))
  WHEN regexp_matches({col}[1:300], '[.!]\s') THEN length(regexp_extract({col}[1:300], '(?s)^.*?[.!]\s')) END AS cut FROM {src}),
{out}_h AS (SELECT *, lower({strip_sql(f"{col}[1:cut]")}) AS head, regexp_replace({col}[cut + 1:], '^\s+', '') AS rest FROM {out}_c),
{out}_w AS (SELECT *, {words.format(f"lower({strip_sql(user)})")} AS uw, {words.format("head")} AS hw FROM {out}_h),
{out} AS (SELECT * EXCLUDE (cut, head, rest, uw, hw), CASE WHEN cut IS NOT NULL AND len(uw) > 0 AND len(hw) > 0
  AND (len(list_intersect(uw, hw)) / len(uw) >= 0.7 OR regexp_matches(head, {_REST})) AND length(rest) > 50
  THEN rest ELSE {col} END AS t2 FROM {out}_w)"""


def _cut_filler(src, col, out):
    kept = f"list_filter(string_split({col}, chr(10)), lambda x: NOT regexp_matches({strip_sql('x')}, {_FILL}))"
    return f"""{out}_f AS (SELECT *, {kept} AS kept FROM {src}),
{out} AS (SELECT * EXCLUDE (kept), CASE WHEN len(kept) < len(string_split({col}, chr(10)))
  AND {strip_sql("array_to_string(kept, chr(10))")} <> '' THEN {strip_sql("array_to_string(kept, chr(10))")} ELSE {col} END AS t3 FROM {out}_f)"""


def _domain(src, user, col, out):
    """CTE: ``out`` adds dom by the word rules and the category hints."""
    def n(ws):
        return f"len(list_filter(tok, lambda w: w IN ({', '.join(sql_text(w) for w in ws)})))"
    raw = ", ".join(f"{n(ws)} AS n_{d}" for d, ws in WORD_DOMAINS.items())
    lab = "lower(coalesce(category, ''))"
    hint = {"RAN": f"contains({lab}, 'ran')", "Core": f"contains({lab}, 'core')", "Transport": f"contains({lab}, 'transport')",
            "IMS": f"(contains({lab}, 'ims') OR contains({lab}, 'volte'))"}
    score = ", ".join(f"n_{d} + CASE WHEN {h} THEN 5 ELSE 0 END AS s_{d}" for d, h in hint.items())
    top = "greatest(s_RAN, s_Core, s_Transport, s_IMS)"
    first = " ".join(f"WHEN s_{d} = {top} THEN '{d}'" for d in WORD_DOMAINS)
    total = "+".join(f"n_{d}" for d in WORD_DOMAINS)
    drop = ", ".join(["tok"] + [f"n_{d}" for d in WORD_DOMAINS] + [f"s_{d}" for d in WORD_DOMAINS])
    return rf"""{out}_t AS (SELECT *, regexp_extract_all(lower({user} || ' ' || {col}), '[\p{{L}}\p{{N}}_]+') AS tok FROM {src}),
{out}_n AS (SELECT *, {raw} FROM {out}_t), {out}_s AS (SELECT *, {score} FROM {out}_n),
{out} AS (SELECT * EXCLUDE ({drop}), CASE WHEN {total} > 0 AND {top} >= 2 THEN CASE {first} END END AS dom FROM {out}_s)"""


_TURNS = f"p AS (SELECT row_id, category, {_LAST_USER} AS u, {_LAST_ASST} AS a FROM chat)"
_PAIRS = f"{_TURNS}, pa AS (SELECT * FROM p WHERE a IS NOT NULL)"


def _pairs(spark, sf):
    m = F.col("messages")
    return chat(spark, sf).select(
        "row_id", "category", chat_ops.last_user(m).alias("u"), chat_ops.last_assistant(m).alias("a"))


def _answered(spark, sf):
    return _pairs(spark, sf).filter(F.col("a").isNotNull())


@query("f3_strip_trailing_followups", f"WITH {CHAT_SQL}, {_PAIRS}, {_cut_tail('pa', 'a', 'x')} SELECT row_id, t1 AS cleaned FROM x")
def trailing(spark, sf):
    return _answered(spark, sf).select("row_id", cleaning.strip_trailing_followups(F.col("a")).alias("cleaned"))


@query("f4_strip_leading_restatement", f"WITH {CHAT_SQL}, {_PAIRS}, {_cut_head('pa', 'u', 'a', 'x')} SELECT row_id, t2 AS cleaned FROM x")
def leading(spark, sf):
    return _answered(spark, sf).select(
        "row_id", cleaning.strip_leading_restatement(F.col("u"), F.col("a")).alias("cleaned"))


@query("f5_drop_filler_lines", f"WITH {CHAT_SQL}, {_PAIRS}, {_cut_filler('pa', 'a', 'x')} SELECT row_id, t3 AS cleaned FROM x")
def filler(spark, sf):
    return _answered(spark, sf).select("row_id", cleaning.drop_filler_lines(F.col("a")).alias("cleaned"))


@query("f6_infer_domain", f"WITH {CHAT_SQL}, {_PAIRS}, {_domain('pa', 'u', 'a', 'x')} SELECT row_id, dom AS domain FROM x")
def domain(spark, sf):
    return _answered(spark, sf).select(
        "row_id", cleaning.infer_domain(F.col("u"), F.col("a"), F.col("category"), WORD_RULES).alias("domain"))


_HAS_TAG = r"regexp_matches({}, '^\[(RAN|Core|Transport|IMS)\]')"


@query("f7_tag_domain", f"""WITH {CHAT_SQL}, {_PAIRS}, g AS (SELECT row_id, CASE WHEN row_id % 2 = 0 THEN '[Core] ' || a ELSE a END AS t FROM pa)
  SELECT row_id, CASE WHEN {_HAS_TAG.format(strip_sql('t'))} THEN t ELSE '[RAN] ' || t END AS tagged FROM g""")
def tag(spark, sf):
    t = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("[Core] "), "a")).otherwise(F.col("a"))
    return _answered(spark, sf).select("row_id", cleaning.tag_domain(t, F.lit("RAN")).alias("tagged"))


_CLEAN = f"""{_TURNS}, {_cut_tail('p', 'a', 'x1')}, {_cut_head('x1', 'u', 't1', 'x2')}, {_cut_filler('x2', 't2', 'x3')},
{_domain('x3', 'u', 't3', 'x4')},
cl AS (SELECT row_id, category, coalesce({_HAS_TAG.format(strip_sql('t3'))}, false) AS had_tag,
  a, t1, t2, t3, CASE WHEN a IS NOT NULL AND NOT {_HAS_TAG.format(strip_sql('t3'))} THEN dom END AS domain FROM x4),
clean AS (SELECT row_id, category, had_tag, domain, CASE WHEN domain IS NULL THEN t3 ELSE '[' || domain || '] ' || t3 END AS cleaned,
  coalesce(t1 <> a, false) AS followup_cut, coalesce(t2 <> t1, false) AS restatement_cut,
  coalesce(t3 <> t2, false) AS filler_cut, domain IS NOT NULL AS tag_added,
  coalesce((CASE WHEN domain IS NULL THEN t3 ELSE '[' || domain || '] ' || t3 END) <> a, false) AS modified FROM cl)"""


def _clean(spark, sf):
    return cleaning.clean_answers(_pairs(spark, sf), "u", "a", "category", WORD_RULES)


@query("f8_clean_chat", f"WITH {CHAT_SQL}, {_CLEAN} SELECT row_id, had_tag, domain, cleaned, followup_cut, restatement_cut, filler_cut, tag_added, modified FROM clean")
def clean(spark, sf):
    return _clean(spark, sf).select(
        "row_id", "had_tag", "domain", "cleaned", "followup_cut", "restatement_cut", "filler_cut", "tag_added", "modified")


@query("g3_cleaning_report", f"""WITH {CHAT_SQL}, {_CLEAN} SELECT count_if(followup_cut)::BIGINT AS followups, count_if(restatement_cut)::BIGINT AS restatements,
  count_if(filler_cut)::BIGINT AS fillers, count_if(had_tag)::BIGINT AS already_tagged, count_if(tag_added)::BIGINT AS tagged,
  count_if(modified)::BIGINT AS modified, count_if(domain = 'RAN')::BIGINT AS n_ran, count_if(domain = 'Core')::BIGINT AS n_core FROM clean""")
def cleaning_report(spark, sf):
    return _clean(spark, sf).agg(
        F.count_if("followup_cut").alias("followups"), F.count_if("restatement_cut").alias("restatements"),
        F.count_if("filler_cut").alias("fillers"), F.count_if("had_tag").alias("already_tagged"),
        F.count_if("tag_added").alias("tagged"), F.count_if("modified").alias("modified"),
        F.count_if(F.col("domain") == "RAN").alias("n_ran"), F.count_if(F.col("domain") == "Core").alias("n_core"),
    )


@query("f9_sentences", rf"""WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9*\-("\\])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents),
  l AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(p, lambda x: string_split(x, chr(10)))), lambda x: {strip_sql('x')}), lambda x: x <> '') AS s FROM c)
  SELECT doc_id, (i - 1)::INT AS pos, s[i] AS sentence FROM l, unnest(range(1, len(s) + 1)) t(i)""")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(cleaning.sentences(F.col("text"))).alias("pos", "sentence"))


# --- sets ------------------------------------------------------------------------------------
def _tri(x):
    n = f"lower({strip_sql(x)})"
    return f"CASE WHEN length({n}) >= 3 THEN list_distinct(list_transform(range(1, length({n}) - 1), lambda i: {n}[i:i + 2])) ELSE [] END"


@query("f1_char_trigrams", f"""WITH t AS (SELECT conv_id, turn, {_tri('text')} AS g FROM conversations)
  SELECT conv_id, turn, len(g)::BIGINT AS n, array_to_string(list_sort(g), '|') AS grams FROM t""")
def trigrams(spark, sf):
    g = text.char_trigrams(F.col("text"))
    return turns(spark, sf).select(
        "conv_id", "turn", F.size(g).cast("long").alias("n"), F.array_join(F.array_sort(g), "|").alias("grams"))


_JAC = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END"


@query("f2_jaccard", f"""WITH p AS (SELECT u.conv_id, u.turn, {_tri('u.text')} AS a, {_tri('v.text')} AS b
  FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1)
  SELECT conv_id, turn, round(({_JAC})::DOUBLE, 6) AS sim FROM p""")
def jaccard(spark, sf):
    u = turns(spark, sf).select("conv_id", "turn", F.col("text").alias("x"))
    v = turns(spark, sf).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    sim = text.jaccard(text.char_trigrams(F.col("x")), text.char_trigrams(F.col("y")))
    return u.join(v, ["conv_id", "turn"]).select("conv_id", "turn", F.round(sim, 6).alias("sim"))


@query("u3_overlap", r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM conversations)
  SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w))::BIGINT AS both_n, (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::BIGINT AS any_n
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def overlap(spark, sf):
    w = F.array_distinct(text.word_tokens(F.lower("text")))
    a = turns(spark, sf).select("conv_id", "turn", w.alias("x"))
    b = turns(spark, sf).select("conv_id", (F.col("turn") - 1).alias("turn"), w.alias("y"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size(F.array_intersect("x", "y")).cast("long").alias("both_n"),
        F.size(F.array_union("x", "y")).cast("long").alias("any_n"))


# --- quality gate ----------------------------------------------------------------------------
@query("g1_category_counts", "SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1")
def counts(spark, sf):
    return profile.category_counts(table(spark, sf, "documents"), "lang")


@query("g2_category_delta", f"""WITH {SOURCES_SQL}, o AS (SELECT lang, count(*) AS n FROM baseq GROUP BY 1), w AS (SELECT source AS lang, count(*) AS n FROM newq GROUP BY 1
  UNION ALL SELECT lang, count(*) FROM newq GROUP BY 1)
  SELECT coalesce(o.lang, w.lang) AS category, coalesce(o.n, 0) AS old, coalesce(w.n, 0) AS new, coalesce(w.n, 0) - coalesce(o.n, 0) AS delta
  FROM o FULL JOIN w ON o.lang = w.lang""")
def delta(spark, sf):
    new, base = new_and_base(spark, sf)
    twice = new.select(F.explode(F.array("source", "lang")).alias("lang"))
    return profile.category_delta(base, twice, "lang")


_PROFILE = """WITH s AS (SELECT lang, n_chars AS l, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT lang, max(n) AS n, min(l) AS min_len, max(CASE WHEN r = n // 10 THEN l END) AS p10, max(CASE WHEN r = n // 2 THEN l END) AS median,
  max(CASE WHEN r = floor(n * 0.9::DOUBLE) THEN l END) AS p90, max(l) AS max_len, (sum(l) // max(n))::BIGINT AS mean_len FROM s GROUP BY lang"""


@query("g4_length_profile", _PROFILE)
def length_profile(spark, sf):
    return profile.length_profile(table(spark, sf, "documents"), "n_chars", ["lang"])


@query("g5_length_buckets", f"""WITH b(lo, hi) AS (VALUES {', '.join(f'({a}::BIGINT, {b}::BIGINT)' for a, b in rules.LENGTH_BUCKETS)}), l AS (SELECT DISTINCT lang FROM documents)
  SELECT l.lang, b.lo, b.hi, (SELECT count(*) FROM documents d WHERE d.lang = l.lang AND length(d.text) >= b.lo AND length(d.text) < b.hi) AS n FROM l, b""")
def length_buckets(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.length("text").alias("len"))
    return profile.length_buckets(d, "len", ["lang"])


# Word boundaries of the specificity markers, spelled out because this regex dialect's are ASCII only.
_B0, _B1, _W = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]"
_SPECIFIC_SQL = [
    *[_B0 + m.removeprefix(r"\b").removesuffix(r"\b") + _B1 for m in rules.SPECIFICITY_MARKERS[:5]],
    _B0 + r"(?:step \d" + _B1 + r"|(?:check |verify |inspect |monitor )" + _W + ")",
]


def _count_sql(markers):
    return " + ".join(f"regexp_matches(answer, {sql_text('(?i)' + m)})::INT" for m in markers)


@query("g6_shallow_flags", f"""WITH {ANSWERS_SQL}, m AS (SELECT row_id, {_count_sql(rules.SHALLOW_MARKERS)} AS markers FROM answers)
  SELECT row_id, markers, markers >= 2 AS shallow FROM m""")
def shallow(spark, sf):
    a = F.col("answer")
    return answers(spark, sf).select("row_id", quality.shallow_count(a).alias("markers"), quality.is_shallow(a).alias("shallow"))


@query("g7_specificity", f"""WITH {ANSWERS_SQL}, m AS (SELECT lang, {_count_sql(_SPECIFIC_SQL)} AS s FROM answers)
  SELECT lang, round(avg(s), 6) AS avg_spec, count_if(s <= 1)::BIGINT AS low, count_if(s >= 4)::BIGINT AS high FROM m GROUP BY lang""")
def specificity(spark, sf):
    s = answers(spark, sf).select("lang", quality.specificity(F.col("answer")).alias("s"))
    return s.groupBy("lang").agg(
        F.round(F.avg("s"), 6).alias("avg_spec"), F.count_if(F.col("s") <= 1).alias("low"), F.count_if(F.col("s") >= 4).alias("high"))


def _topic_sql(topics):
    x = "(lower(question) || ' ' || lower(answer))"
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({x}, {sql_text(k)})' for k in ks)} THEN {sql_text(t)}" for t, ks in topics.items())
    return f"CASE {whens} ELSE 'unclassified' END"


def _coverage_sql(topics):
    names = ", ".join(f"({sql_text(t)})" for t in [*topics, "unclassified"])
    return f"""WITH {ANSWERS_SQL}, t AS (SELECT {_topic_sql(topics)} AS topic FROM answers), nm(topic) AS (VALUES {names})
  SELECT nm.topic, count(t.topic) AS n, round(count(t.topic) / (SELECT count(*) FROM answers), 6) AS share FROM nm LEFT JOIN t ON t.topic = nm.topic GROUP BY nm.topic"""


@query("g8_topic_coverage_kpi", _coverage_sql(rules.KPI_TOPICS))
def coverage_kpi(spark, sf):
    return quality.topic_coverage(answers(spark, sf), "question", "answer", rules.KPI_TOPICS)


@query("g8_topic_coverage_protocol", _coverage_sql(rules.PROTOCOL_TOPICS))
def coverage_protocol(spark, sf):
    return quality.topic_coverage(answers(spark, sf), "question", "answer", rules.PROTOCOL_TOPICS)


_STYLE = {
    "probability_pct": f"regexp_matches(lower(answer), {sql_text(rules.STYLE_PROBABILITY)})",
    "generic_rca": f"regexp_matches(lower(answer), {sql_text(rules.STYLE_RANKED_CAUSES)})",
    "too_short": "length(answer) < 100",
    "too_long": "length(answer) > 2000",
    "no_first_check": f"NOT regexp_matches(lower(answer), {sql_text(rules.STYLE_FIRST_CHECK)})",
    "cli_heavy": f"len(regexp_extract_all(answer, {sql_text(rules.STYLE_CODE_SPAN)})) > 4",
}


@query("b13_style_flags", f"WITH {ANSWERS_SQL} SELECT row_id, {', '.join(f'{v} AS {k}' for k, v in _STYLE.items())} FROM answers")
def style_flags(spark, sf):
    return answers(spark, sf).select("row_id", *[v.alias(k) for k, v in quality.style_flags(F.col("answer")).items()])


@query("g10_style_report", "WITH " + ANSWERS_SQL + ", n AS (SELECT count(*) AS total FROM answers) " + " UNION ALL ".join(
    f"SELECT '{k}' AS issue, count_if({v})::BIGINT AS n, round(count_if({v}) / max(total) * 100, 6) AS pct, count_if({v}) / max(total) * 100 > 10 AS alert FROM answers, n"
    for k, v in _STYLE.items()))
def style_report(spark, sf):
    return quality.style_report(answers(spark, sf), "answer")


# --- duplicates ------------------------------------------------------------------------------
def _questions(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("question"), "lang", "source")


_KEYED = f"k AS (SELECT doc_id AS row_id, lower({strip_sql('text')}) AS key FROM documents)"
_EXACT = f"{_KEYED}, ex AS (SELECT row_id AS dup_row, first_row FROM (SELECT row_id, min(row_id) OVER (PARTITION BY key) AS first_row FROM k) WHERE row_id > first_row)"


@query("w1_exact_dups", f"WITH {_EXACT} SELECT dup_row, first_row FROM ex")
def exact(spark, sf):
    return dedup.exact_dups(_questions(spark, sf))


@query("w1_dedup_exact", f"WITH {_EXACT} SELECT doc_id AS row_id, source FROM documents WHERE doc_id NOT IN (SELECT dup_row FROM ex)")
def dedup_exact(spark, sf):
    return dedup.dedup_exact(_questions(spark, sf)).select("row_id", "source")


# Similar pairs by counting joined trigrams: shared / (|a| + |b| - shared).
_GRAMS = f"""{_EXACT}, d AS (SELECT row_id, key, row_number() OVER (ORDER BY row_id) AS pos FROM k WHERE true),
g AS (SELECT DISTINCT row_id, pos, key[i:i + 2] AS gram FROM (SELECT row_id, pos, key, unnest(range(1, length(key) - 1)) AS i FROM d WHERE length(key) >= 3)),
sz AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id)"""
_NEAR = f"""{_GRAMS}, sh AS (SELECT a.row_id AS row_i, b.row_id AS row_j, count(*) AS both_n FROM g a JOIN g b ON a.gram = b.gram AND b.pos < a.pos AND b.pos >= a.pos - 200 GROUP BY 1, 2),
near AS (SELECT row_i, row_j, both_n / (x.n + y.n - both_n) AS sim FROM sh JOIN sz x ON x.row_id = row_i JOIN sz y ON y.row_id = row_j
  WHERE both_n / (x.n + y.n - both_n) >= 0.85 AND (row_i, row_j) NOT IN (SELECT (dup_row, first_row) FROM ex))"""


@query("c1_near_dups_window", f"WITH {_NEAR} SELECT row_i, row_j, round(sim, 6) AS sim FROM near")
def near(spark, sf):
    return similarity.near_dups(_questions(spark, sf)).withColumn("sim", F.round("sim", 6))


@query("w2_apply_dups", f"""WITH {_NEAR} SELECT doc_id AS row_id FROM documents
  WHERE doc_id NOT IN (SELECT dup_row FROM ex) AND doc_id NOT IN (SELECT row_i FROM near)""")
def apply_dups(spark, sf):
    q = _questions(spark, sf)
    return dedup.apply_dups(q.select("row_id"), dedup.exact_dups(q), similarity.near_dups(q))


@query("c2_near_dups_all", f"""WITH {_GRAMS}, sh AS (SELECT a.row_id AS row_i, b.row_id AS row_j, count(*) AS both_n FROM g a JOIN g b ON a.gram = b.gram AND b.row_id < a.row_id GROUP BY 1, 2)
  SELECT DISTINCT row_i AS row_id FROM sh JOIN sz x ON x.row_id = row_i JOIN sz y ON y.row_id = row_j WHERE both_n / (x.n + y.n - both_n) >= 0.85""")
def near_all(spark, sf):
    return similarity.near_dups_all(_questions(spark, sf))


@query("c3_dedup_against", f"""WITH {SOURCES_SQL}, {_GRAMS}, gn AS (SELECT g.* FROM g JOIN newq USING (row_id)), gb AS (SELECT g.* FROM g JOIN baseq USING (row_id)),
sh AS (SELECT a.row_id AS row_i, b.row_id AS row_j, count(*) AS both_n FROM gn a JOIN gb b ON a.gram = b.gram GROUP BY 1, 2),
bad AS (SELECT DISTINCT row_i FROM sh JOIN sz x ON x.row_id = row_i JOIN sz y ON y.row_id = row_j WHERE both_n / (x.n + y.n - both_n) >= 0.80)
  SELECT row_id, source FROM newq WHERE row_id NOT IN (SELECT row_i FROM bad)""")
def against(spark, sf):
    new, base = new_and_base(spark, sf)
    return similarity.dedup_against(new, base).select("row_id", "source")


# Beside all questions stands, for every tenth, a held-out item in other case and spacing.
@query("c4_eval_overlap", f"""WITH q AS (SELECT doc_id AS row_id, text AS question FROM documents UNION ALL
    SELECT -1 - doc_id, '  ' || lower(b.text) FROM documents JOIN benchmark b ON b.item_id = (doc_id // 10) % (SELECT count(*) FROM benchmark) WHERE doc_id % 10 = 0)
  SELECT row_id FROM q WHERE lower({strip_sql('question')}) NOT IN (SELECT lower({strip_sql('text')}) FROM benchmark) OR question IS NULL""")
def eval_overlap(spark, sf):
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    planted = d.filter("doc_id % 10 = 0").join(
        b.select(F.col("item_id"), F.col("text").alias("item")), F.floor(F.col("doc_id") / 10) % b.agg(F.count(F.lit(1))).scalar() == F.col("item_id"))
    rows = d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("question")).unionByName(
        planted.select((-1 - F.col("doc_id")).alias("row_id"), F.concat(F.lit("  "), F.lower("item")).alias("question")))
    return similarity.drop_eval_overlap(rows, b).select("row_id")


# Every tenth text gets an item inserted in its middle.
@query("c4_contained_items", f"""WITH n AS (SELECT count(*) AS n FROM benchmark),
q AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN left(d.text, d.n_chars // 2) || ' ' || lower(b.text) || ' ' || substring(d.text, d.n_chars // 2 + 1) ELSE d.text END AS question
  FROM documents d LEFT JOIN benchmark b ON b.item_id = (d.doc_id // 10) % (SELECT n FROM n)),
qw AS (SELECT doc_id, string_split_regex(lower({strip_sql('question')}), '\\s+') AS w FROM q), bw AS (SELECT item_id, string_split_regex(lower({strip_sql('text')}), '\\s+') AS w FROM benchmark),
qg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM qw)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM bw)),
t AS (SELECT item_id, count(*) AS total FROM bg GROUP BY 1), f AS (SELECT doc_id, item_id, count(*) AS found FROM qg JOIN bg USING (g) GROUP BY 1, 2)
  SELECT doc_id AS row_id, item_id, found, total FROM f JOIN t USING (item_id) WHERE found >= 0.5 * total""")
def contained(spark, sf):
    b = table(spark, sf, "benchmark")
    d = table(spark, sf, "documents").join(
        b.select(F.col("item_id"), F.col("text").alias("item")), F.floor(F.col("doc_id") / 10) % b.agg(F.count(F.lit(1))).scalar() == F.col("item_id"), "left")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    planted = F.concat(F.substring("text", F.lit(1), half), F.lit(" "), F.lower("item"), F.lit(" "), F.substring(F.col("text"), half + 1, F.length("text")))
    q = F.when(F.col("doc_id") % 10 == 0, planted).otherwise(F.col("text"))
    return similarity.contained_items(d.select(F.col("doc_id").alias("row_id"), q.alias("question")), b)


@query("u2_except_rows", f"WITH {_EXACT} SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT dup_row FROM ex)")
def except_rows(spark, sf):
    bad = dedup.exact_dups(_questions(spark, sf)).select(F.col("dup_row").alias("doc_id"))
    return dedup.except_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), bad, "doc_id")


_TOPICS = ", ".join(f"count_if(topic = {sql_text(t)}) AS t{i}" for i, t in enumerate(rules.KPI_TOPICS))
_TLIST = ", ".join(f"t{i}" for i in range(len(rules.KPI_TOPICS)))


@query("g9_quality_verdict", f"""WITH {ANSWERS_SQL}, {_NEAR},
s AS (SELECT {_count_sql(rules.SHALLOW_MARKERS)} AS sh, {_count_sql(_SPECIFIC_SQL)} AS sp, {_topic_sql(rules.KPI_TOPICS)} AS topic, length(answer) AS l FROM answers),
m AS (SELECT count(*) AS n_valid, count_if(sh >= 2)::BIGINT AS n_shallow, avg(sp) AS avg_spec, {_TOPICS} FROM s),
v AS (SELECT *, (SELECT count(*) FROM ex) AS n_exact, (SELECT count(*) FROM near) AS n_near, greatest({_TLIST}) AS mx, least({_TLIST}) AS mn,
  (SELECT count(*) FROM (SELECT dup_row FROM ex UNION SELECT row_i FROM near)) AS n_removed FROM m),
i AS (SELECT *, list_filter([CASE WHEN n_exact > n_valid * 0.02 THEN n_exact || ' exact duplicates (>2%)' END, CASE WHEN n_near > n_valid * 0.05 THEN n_near || ' near-duplicates (>5%)' END,
  CASE WHEN n_shallow > n_valid * 0.05 THEN n_shallow || ' shallow answers (>5%)' END, CASE WHEN avg_spec < 2 THEN 'low domain specificity' END,
  CASE WHEN mx > 0 AND mn / mx < 0.1 THEN 'severe topic imbalance' END], lambda x: x IS NOT NULL) AS f FROM v)
  SELECT n_valid, n_exact, n_near, n_valid - n_removed AS n_clean, n_shallow, round(avg_spec, 6) AS avg_spec,
  (SELECT max(l) FROM s) AS max_len, array_to_string(f, '; ') AS issues, CASE WHEN len(f) = 0 THEN 'PASS' ELSE 'ISSUES' END AS verdict FROM i""")
def verdict(spark, sf):
    out = quality.quality_verdict(quality.gate_metrics(answers(spark, sf)))
    return out.select("n_valid", "n_exact", "n_near", "n_clean", "n_shallow", F.round("avg_spec", 6).alias("avg_spec"),
                      "max_len", "issues", "verdict")
