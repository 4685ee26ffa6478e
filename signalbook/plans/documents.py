"""Document, retrieval and mixing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.text import stable_hash
from signalbook.operators import dedup, embedding, mix, similarity
from signalbook.operators import documents as docs
from signalbook.plans.catalog import query, table
from signalbook.plans.corpus import _GRAMS
from signalbook.plans.fixtures import CHAT_SQL, SOURCES_SQL, chat, new_and_base, sql_text, strip_sql
from signalbook.session import shared_folder
from signalbook.sources import chat as chat_io
from signalbook.sources import specs
from signalbook.sources.lines_source import append_lines, read_line_table


# --- sources ---------------------------------------------------------------------------------
def _paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


_PATHS = "ps AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path, string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages)"


@query("a4_path_metadata", rf"""WITH {_PATHS} SELECT page_id, p[1] AS release, coalesce(p[2], 'unknown') AS series, regexp_replace(p[-1], '(.)\.[^.]*$', '\1') AS spec, p[-1] AS filename, path AS source FROM ps""")
def path_metadata(spark, sf):
    p = _paths(spark, sf)
    return p.select("page_id", *[v.alias(k) for k, v in specs.path_metadata(F.col("path")).items()])


@query("a5_file_inventory")
def inventory(spark, sf):
    return specs.file_inventory(spark, sf)


@query("a5_inventory", r"""WITH f AS (SELECT lower(regexp_extract(string_split(url, '/')[-1], '^.+(\.[^.]+)$', 1)) AS extension, length(html) AS size FROM pages)
  SELECT coalesce(extension, '') AS extension, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM f GROUP BY 1
  UNION ALL SELECT NULL, count(*), coalesce(sum(size), 0)::BIGINT FROM f""")
def inventory_rows(spark, sf):
    pages = table(spark, sf, "pages").select("url", F.length("html").alias("size"))
    return specs.inventory(pages, "url", "size")


# Some lines are broken or hold a list, as real files do.
_CHAT_LINE = f"""lines AS (SELECT row_id, messages, category, CASE WHEN row_id % 11 = 3 THEN 'broken' WHEN row_id % 13 = 4 THEN 'list' ELSE 'fine' END AS kind FROM chat)"""


@query("a1_parse_chat", f"""WITH {CHAT_SQL}, {_CHAT_LINE} SELECT row_id, kind <> 'broken' AS parse_ok,
  CASE WHEN kind = 'list' THEN 'not a dict' END AS issue, CASE WHEN kind = 'fine' THEN len(messages) END AS n_messages,
  CASE WHEN kind = 'fine' THEN category END AS category, CASE WHEN kind = 'fine' THEN messages[-1].content END AS last_text FROM lines""")
def parse_lines(spark, sf):
    made = chat_io.chat_lines(chat(spark, sf), "row_id")
    value = F.when(F.col("row_id") % 11 == 3, F.lit('{"messages": [')).when(F.col("row_id") % 13 == 4, F.lit("[1, 2]")).otherwise(F.col("value"))
    parsed = chat_io.parse_chat(made.select("row_id", value.alias("value")))
    return parsed.select(
        "row_id", "parse_ok", "issue", F.size("messages").cast("long").alias("n_messages"), "category",
        F.element_at("messages", -1)["content"].alias("last_text"))


@query("a2_chat_lines", f"""WITH {CHAT_SQL} SELECT row_id, CASE WHEN category IS NULL THEN to_json({{'messages': messages}})
  ELSE to_json({{'category': category, 'messages': messages}}) END::VARCHAR AS value FROM chat""")
def lines_of_chats(spark, sf):
    return chat_io.chat_lines(chat(spark, sf), "row_id")


@query("a9_rows_to_append", f"WITH {SOURCES_SQL} SELECT DISTINCT md5(question) AS key FROM newq WHERE md5(question) NOT IN (SELECT md5(question) FROM baseq WHERE question IS NOT NULL)")
def to_append(spark, sf):
    new, base = (df.select(F.md5("question").alias("key")) for df in new_and_base(spark, sf))
    return chat_io.rows_to_append(new, base, "key")


@query("a10_report", """SELECT '{"rows":' || count(*) || ',"chars":' || sum(n_chars)::BIGINT || ',"languages":' || count(DISTINCT lang) || '}' AS value FROM documents""")
def report(spark, sf):
    metrics = table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("languages"))
    return chat_io.report_document(metrics)


@query("a6_top_dirs", f"WITH {_PATHS} SELECT DISTINCT p[1] AS dir FROM ps WHERE contains(path, '/') AND NOT starts_with(p[1], '.')")
def top_dirs(spark, sf):
    return specs.top_dirs(_paths(spark, sf), "path")


def _bank(spark, sf):
    return specs.scenario_bank(table(spark, sf, "part"), "p_brand", "p_name", "p_partkey")


_BANK = "bank AS (SELECT p_brand AS archetype, p_name AS preview, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


@query("a7_scenario_bank", f"WITH {_BANK} SELECT archetype, pos, preview, n FROM bank")
def bank(spark, sf):
    return _bank(spark, sf).select("archetype", "pos", "preview", "n")


@query("a8_source_counts", f"WITH {SOURCES_SQL} SELECT 'new' AS source_name, count(*) AS n FROM newq UNION ALL SELECT 'base', count(*) FROM baseq UNION ALL SELECT 'pages', count(*) FROM pages")
def source_counts(spark, sf):
    new, base = new_and_base(spark, sf)
    all_rows = chat_io.union_sources({"new": new, "base": base, "missing": None, "pages": table(spark, sf, "pages")})
    return chat_io.source_counts(all_rows)


@query("u1_union_all", f"WITH {SOURCES_SQL} SELECT row_id, lang, NULL AS url FROM newq UNION ALL SELECT row_id, lang, NULL FROM baseq UNION ALL SELECT page_id, NULL, url FROM pages")
def union_all(spark, sf):
    new, base = new_and_base(spark, sf)
    p = table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), "url")
    return chat_io.union_sources({"new": new, "base": base, "pages": p}).select("row_id", "lang", "url")


# --- sections and chunks ----------------------------------------------------------------------
def _specs(spark, sf):
    """Documents whose line ends become headings; every 50th file is a README."""
    heading = F.concat(F.lit("\n### Topic "), F.col("doc_id").cast("string"), F.lit(" #\n"))
    name = F.when(F.col("doc_id") % 50 == 0, "README.md").otherwise(F.concat("source", F.lit(".md")))
    return table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), heading).alias("text"), name.alias("filename"))


_SPECS = "sp AS (SELECT doc_id, replace(text, chr(10), chr(10) || '### Topic ' || doc_id || ' #' || chr(10)) AS text, CASE WHEN doc_id % 50 = 0 THEN 'README.md' ELSE source || '.md' END AS filename FROM documents)"


@query("b6_filter_docs", f"WITH {_SPECS} SELECT doc_id, filename FROM sp WHERE length(text) >= 100 AND filename <> 'README.md'")
def filter_docs(spark, sf):
    return docs.filter_docs(_specs(spark, sf)).select("doc_id", "filename")


_SEC = rf"""{_SPECS}, sm AS (SELECT doc_id, string_split(regexp_replace(text, '\n(#{{2,4}}\s+[^\n]+)\n', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM sp),
su AS (SELECT doc_id, pos, parts[pos + 1] AS part FROM sm, unnest(range(1, len(parts))) t(pos)),
sr AS (SELECT doc_id, pos, regexp_replace(split_part(part, chr(2), 1), '^[# \n]+|[# \n]+$', '', 'g') AS title, split_part(part, chr(2), 2) AS raw FROM su),
sec AS (SELECT doc_id, pos::INT AS pos, title, {strip_sql('raw')}[1:2000] AS content FROM sr WHERE length({strip_sql('raw')}) > 100 AND title <> '' AND NOT regexp_matches(raw, '^#{{2,4}}\s+'))"""


@query("f10_sections", f"WITH {_SEC} SELECT doc_id, pos, title, content FROM sec")
def sections(spark, sf):
    return docs.sections(_specs(spark, sf))


@query("b7_filter_sections", rf"WITH {_SEC} SELECT doc_id, pos FROM sec WHERE length({strip_sql('content')}) > 100 AND len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) >= 30")
def filter_sections(spark, sf):
    return docs.filter_sections(docs.sections(_specs(spark, sf))).select("doc_id", "pos")


def _hash_sql(*cols):
    return "('0x' || substr(md5(" + " || '-' || ".join(cols) + "), 1, 8))::BIGINT"


def _pick_sql(templates, seed):
    return f"([{', '.join(sql_text(t) for t in templates)}])[({seed}) % {len(templates)} + 1]"


@query("f11_section_questions", f"WITH {_SEC} SELECT doc_id, pos, replace({_pick_sql(rules.SECTION_QUESTIONS, _hash_sql('doc_id', 'pos'))}, '{{title}}', title) AS question FROM sec")
def section_questions(spark, sf):
    s = docs.sections(_specs(spark, sf))
    return s.select("doc_id", "pos", docs.question_from_title(F.col("title"), stable_hash("doc_id", "pos")).alias("question"))


@query("f14_intent_prompts", f"SELECT p_partkey, replace({_pick_sql(rules.INTENT_PROMPTS, _hash_sql('p_partkey', '7'))}, '{{intent}}', p_name) AS prompt FROM part")
def intents(spark, sf):
    return table(spark, sf, "part").select("p_partkey", docs.intent_prompts(F.col("p_name"), stable_hash("p_partkey", F.lit(7))).alias("prompt"))


@query("f43_chunk", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ws FROM documents),
  c AS (SELECT doc_id, ws, unnest(range(0, greatest(1, ceil((len(ws) - 50) / 462)::INT)))::INT AS chunk_no FROM w WHERE len(ws) > 0)
  SELECT doc_id, chunk_no, array_to_string(ws[chunk_no * 462 + 1:chunk_no * 462 + 512], ' ') AS chunk FROM c""")
def chunks(spark, sf):
    return docs.chunk(table(spark, sf, "documents"))


# --- templates -------------------------------------------------------------------------------
TEMPLATES = [
    ("Part {p_name} at size {p_size} overheats", "{p_brand} runs above its limit", "Replace {p_name}", "major", "RAN"),
    ("{p_type} link down", "No light on {p_brand}", "Check the fiber of {p_name} and reset {p_brand}", "critical", "Transport"),
    ("Registration failures on {p_brand}", "Overload at {p_retailprice}", "Add capacity", "minor", "Core"),
    ("Voice drops on {unknown_slot}", "Codec of {p_name}", "Restart", "minor", "IMS"),
    ("License of {p_name} expired", "{p_type} is not covered", "Renew {p_type}", "warning", "Core"),
]
SLOTS = ["p_name", "p_size", "p_brand", "p_type"]


def _fill_sql(i):
    expr = f"CASE h % 5 {' '.join(f'WHEN {n} THEN {sql_text(t[i])}' for n, t in enumerate(TEMPLATES))} END"
    for s in SLOTS:
        expr = f"replace({expr}, '{{{s}}}', {s}::VARCHAR)"
    return expr


@query("f12_fill_templates", f"""WITH h AS (SELECT *, {_hash_sql('p_partkey', '0')} AS h FROM part),
  f AS (SELECT p_partkey, (h // 5) % 3 AS s, {_fill_sql(0)} AS a, {_fill_sql(1)} AS d, {_fill_sql(2)} AS r, {_fill_sql(3)} AS severity, {_fill_sql(4)} AS domain FROM h)
  SELECT p_partkey, CASE s WHEN 0 THEN 'Find the cause of this alarm: ' || a WHEN 1 THEN a || chr(10) || 'Cause: ' || d || chr(10) || chr(10) || 'How is it put right?'
   ELSE a || chr(10) || chr(10) || 'Name the cause and how to put it right.' END AS instruction,
  CASE s WHEN 0 THEN d WHEN 1 THEN r ELSE 'Cause: ' || d || chr(10) || chr(10) || 'Remedy: ' || r END AS response,
  CASE s WHEN 0 THEN 'noc_diagnosis' WHEN 1 THEN 'noc_resolution' ELSE 'noc_full' END AS category, severity, domain FROM f WHERE NOT regexp_matches(a || d || r, '\\{{\\w+\\}}')""")
def fill(spark, sf):
    return docs.fill_templates(table(spark, sf, "part"), TEMPLATES, "p_partkey", SLOTS)


@query("f13_fan_out", "SELECT p_partkey, v::INT AS variant FROM part, range(50) t(v)")
def fan_out(spark, sf):
    return docs.fan_out(table(spark, sf, "part").select("p_partkey"), 50)


@query("f13_prompt_variants", "SELECT p_partkey, 0 AS variant, p_name AS instruction FROM part UNION ALL SELECT p_partkey, 1, 'In a few words: ' || p_name FROM part UNION ALL SELECT p_partkey, 2, 'For a written test, please answer: ' || p_name FROM part")
def variants(spark, sf):
    return docs.prompt_variants(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "variant", "instruction")


@query("f13_mcq_forms", """WITH m AS (SELECT p_partkey, p_name AS q, [p_brand, p_type, p_size::VARCHAR] AS c, (p_partkey % 3)::INT AS a FROM part)
  SELECT p_partkey, q || chr(10) || chr(10) || 'Choices:' || chr(10) || '  0: ' || c[1] || chr(10) || '  1: ' || c[2] || chr(10) || '  2: ' || c[3] || chr(10) || chr(10) || 'Reply with the number that fits, then the reason.' AS instruction,
   'Number ' || a || ': ' || c[a + 1] || chr(10) || chr(10) || 'See ' || q AS response, 'mcq_telecom' AS category FROM m
  UNION ALL SELECT p_partkey, q, c[a + 1] || chr(10) || chr(10) || 'See ' || q, 'telecom_knowledge' FROM m""")
def mcq_forms(spark, sf):
    items = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("question"), F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("choices"),
        (F.col("p_partkey") % 3).cast("int").alias("answer"), F.concat(F.lit("See "), "p_name").alias("explanation"))
    return docs.mcq_forms(items).select("p_partkey", "instruction", "response", "category")


# --- vector search: the centroid of every label against all vectors ---------------------------
def _centroids(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    dims = e.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    rows = dims.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
    return rows.select("query_id", F.transform("p", lambda x: x["v"]).alias("embedding"))


_KNN = """dm AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY ALL),
qv AS (SELECT label::BIGINT AS query_id, list(v ORDER BY i) AS q FROM dm GROUP BY label),
ds AS (SELECT query_id, vec_id, {} AS distance FROM qv, embeddings),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM ds QUALIFY rank <= 5)"""
_L2 = "list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - q[i], 2)))"
_COS = "1 - list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i])) / (sqrt(list_sum(list_transform(q, lambda x: x * x))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))))"


@query("c17_knn_l2", f"WITH {_KNN.format(_L2)} SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM nn")
def knn(spark, sf):
    return docs.knn(_centroids(spark, sf), table(spark, sf, "embeddings"), 5).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("c17_knn_cosine", f"WITH {_KNN.format(_COS)} SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM nn")
def knn_cosine(spark, sf):
    hits = docs.knn(_centroids(spark, sf), table(spark, sf, "embeddings"), 5, "cosine")
    return hits.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("f42_assemble_context", f"""WITH {_KNN.format(_L2)}, h AS (SELECT query_id, rank, text[1:500] AS t, lang || '/' || source || '/?' AS l FROM nn JOIN documents ON doc_id = vec_id)
  SELECT query_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, string_agg(l, ', ' ORDER BY rank) AS labels,
  string_agg('[Source ' || rn || ': ' || l || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY rank) AS numbered FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM h) GROUP BY query_id""")
def context(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), "text", F.col("lang").alias("release"), F.col("source").alias("series"), F.lit(None).cast("string").alias("spec"))
    hits = docs.knn(_centroids(spark, sf), table(spark, sf, "embeddings"), 5)
    return docs.assemble_context(hits.join(d, "vec_id"))


# --- samples and splits ----------------------------------------------------------------------
def _rows(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source")


_RANK = "rk AS (SELECT doc_id AS row_id, source, row_number() OVER (ORDER BY md5(doc_id || '-42'), doc_id) - 1 AS split_rank, count(*) OVER () AS n FROM documents)"


@query("s4_sample_k", f"WITH {_RANK} SELECT row_id, source FROM rk WHERE split_rank < 200")
def sample(spark, sf):
    return mix.sample_k(_rows(spark, sf), 200, 42)


@query("s5_split", f"WITH {_RANK} SELECT row_id, source, split_rank, CASE WHEN split_rank < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM rk")
def split(spark, sf):
    return mix.split(_rows(spark, sf))


@query("s7_test_head", f"WITH {_RANK} SELECT row_id, split_rank FROM rk WHERE split_rank >= floor(n * 0.9::DOUBLE) ORDER BY split_rank LIMIT 100")
def test_head(spark, sf):
    return mix.test_head(mix.split(_rows(spark, sf))).select("row_id", "split_rank")


_BASED = f"""{SOURCES_SQL}, nr AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '-42'), row_id) - 1 AS r, count(*) OVER () AS n FROM newq),
pt AS (SELECT row_id, 'base' AS origin, 'train' AS part FROM baseq UNION ALL SELECT row_id, 'new', CASE WHEN r < floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END FROM nr)"""


def _based(spark, sf):
    new, base = new_and_base(spark, sf)
    return mix.split_with_base(base.select("row_id"), new.select("row_id"))


@query("s6_split_with_base", f"WITH {_BASED} SELECT row_id, origin, part FROM pt")
def split_base(spark, sf):
    return _based(spark, sf).select("row_id", "origin", "part")


@query("g25_mix_report", f"WITH {_BASED} SELECT origin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pt GROUP BY origin")
def mix_report(spark, sf):
    return mix.mix_report(_based(spark, sf))


@query("g11_combine_stats", f"""WITH {SOURCES_SQL}, {_GRAMS}, fx AS (SELECT * FROM newq JOIN k USING (row_id) QUALIFY row_number() OVER (PARTITION BY key ORDER BY row_id) = 1),
gn AS (SELECT g.* FROM g JOIN fx USING (row_id)), gb AS (SELECT g.* FROM g JOIN baseq USING (row_id)),
sh AS (SELECT a.row_id AS row_i, b.row_id AS row_j, count(*) AS both_n FROM gn a JOIN gb b ON a.gram = b.gram GROUP BY 1, 2),
bad AS (SELECT DISTINCT row_i FROM sh JOIN sz x ON x.row_id = row_i JOIN sz y ON y.row_id = row_j WHERE both_n / (x.n + y.n - both_n) >= 0.80),
c AS (SELECT (SELECT count(*) FROM baseq) AS base_rows, (SELECT count(*) FROM newq) AS new_raw, (SELECT count(*) FROM fx) AS a, (SELECT count(*) FROM fx WHERE row_id NOT IN (SELECT row_i FROM bad)) AS b)
  SELECT base_rows, new_raw, new_raw - a AS internal_dups, a - b AS cross_dups, b AS new_after_dedup, base_rows + b - floor(b * 0.1::DOUBLE)::BIGINT AS train_total, floor(b * 0.1::DOUBLE)::BIGINT AS val_total, base_rows + b AS grand_total FROM c""")
def combine(spark, sf):
    new, base = new_and_base(spark, sf)
    once = dedup.dedup_exact(new)
    kept = similarity.dedup_against(once, base)
    parts = mix.split_with_base(base.select("row_id"), kept.select("row_id"))
    return mix.combine_stats(base, new, once, parts)


# --- quotas ----------------------------------------------------------------------------------
def _grid(spark, sf):
    """Topics are the nations; targets follow their key."""
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("grid_pos"), F.col("n_nationkey").alias("topic"), (F.col("n_nationkey") % 4 * 20 + 10).cast("long").alias("target"))


_GRID = """gr AS (SELECT n_nationkey AS grid_pos, n_nationkey AS topic, (n_nationkey % 4 * 20 + 10)::BIGINT AS target FROM nation),
qr AS (SELECT *, target - least(greatest((SELECT count(*) FROM supplier) - coalesce(sum(target) OVER (ORDER BY grid_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), target) AS remaining FROM gr)"""


def _quota(spark, sf):
    return mix.quota_remaining(_grid(spark, sf), table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar())


@query("w6_quota_remaining", f"WITH {_GRID} SELECT topic, target, remaining::BIGINT AS remaining FROM qr")
def quota(spark, sf):
    return _quota(spark, sf).select("topic", "target", "remaining")


@query("w7_fill_quota", f"WITH {_GRID}, p AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT c_custkey, topic FROM p JOIN qr ON topic = c_nationkey WHERE pos < remaining")
def fill_quota(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("topic"))
    return mix.fill_quota(rows, _quota(spark, sf), row="c_custkey").select("c_custkey", "topic")


@query("w8_apportion", "SELECT r_name, ((SELECT count(*) FROM documents) // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY r_name) - 1 < (SELECT count(*) FROM documents) % count(*) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM region")
def apportion(spark, sf):
    total = table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    return mix.apportion(table(spark, sf, "region").select("r_name"), total, "r_name")


@query("w9_seed_slices", f"""WITH {_BANK}, b AS (SELECT DISTINCT archetype, n, b AS batch, (b * 15) % greatest(1, n - 15) AS off FROM bank, range(12) t(b))
  SELECT b.archetype, batch, pos - off AS slot, pos, preview FROM b JOIN bank ON bank.archetype = b.archetype AND pos >= off AND pos < off + 15""")
def slices(spark, sf):
    bank = _bank(spark, sf)
    batches = bank.select("archetype").distinct().withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(11))))
    out = mix.seed_slices(bank, batches)
    return out.select("archetype", "batch", F.col("slot").cast("long").alias("slot"), "pos", "preview").withColumn("batch", F.col("batch").cast("long"))


MAPPING = {"first": ["Brand#1", "Brand#2"], "second": ["Brand#2", "Brand#3"], "none": ["Brand#99"]}


@query("c14_seeds_for", "SELECT category, archetype, p_name AS preview FROM part JOIN (VALUES " + ", ".join(f"('{c}', '{a}')" for c, xs in MAPPING.items() for a in xs) + ") m(category, archetype) ON p_brand = archetype")
def seeds(spark, sf):
    return mix.seeds_for(_bank(spark, sf), MAPPING)


def _letters(i):
    return "".join(chr(c) for c in range(97, 123) if c % 8 == i)


_LETTER_N = ", ".join(f"length(regexp_replace(t, '[^{_letters(i)}]', '', 'g'))" for i in range(8))


@query("c17_embed_documents", f"""WITH d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  v AS (SELECT doc_id, t, [{_LETTER_N}] AS n, length(regexp_replace(t, '[^a-z]', '', 'g')) AS total FROM d)
  SELECT doc_id, t IS NOT NULL AS has_vector, {', '.join(f'round(CAST(CAST(n[{i + 1}] / greatest(total, 1) AS FLOAT) AS DOUBLE), 4) AS v{i}' for i in range(8))} FROM v""")
def embed_documents(spark, sf):
    """A vector for every whole document, from a model built in the workers."""
    found = embedding.embed(table(spark, sf, "documents"), lambda: embedding.LetterCounts(8), "letters-8", 8, "doc_id", "text")
    return found.select("doc_id", F.col("embedding").isNotNull().alias("has_vector"), *[F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(f"v{i}") for i in range(8)])


@query("a9_append_batches", """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{"doc_id": ' || doc_id ELSE '{"doc_id": ' || doc_id || ', "n": ' || n_chars || '}' END AS value FROM documents)
  SELECT value, doc_id % 7 = 0 AS broken FROM l""")
def append_batches(spark, sf):
    """Lines of all documents, appended in two batches of which one is repeated, and read back in small splits."""
    whole = F.format_string('{"doc_id": %d, "n": %d}', "doc_id", "n_chars")
    value = F.when(F.col("doc_id") % 7 == 0, F.format_string('{"doc_id": %d', "doc_id")).otherwise(whole)
    rows = table(spark, sf, "documents").select("doc_id", value.alias("value"))
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    for batch, part in (("even", 0), ("odd", 1), ("even", 0)):
        append_lines(rows.filter(F.col("doc_id") % 2 == part), folder, batch)
    return read_line_table(spark, folder, 1 << 16).select("value", "broken")
