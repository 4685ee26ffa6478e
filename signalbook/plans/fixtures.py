"""Adapters that shape the driver tables into the library's inputs, with matching SQL.

Each ``*_SQL`` string is a comma-free list of common table expressions used by the SQL statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.plans.catalog import table

# --- chat records: three consecutive turns of a conversation ---------------------------------
# Phrases the cleaning rules look for are added to the answers, by turn.
ENDINGS = {
    0: "{}\nWould you like to know more?",
    1: "{}\nHope this helps!\n\nLet me know if you need more.",
    2: "Happy to help\n{}",
    3: "You asked about this topic.\n{}",
    4: "{}\n\n",
    5: "The PRB load of the cell and the gNB are high. {}",
    6: "The AMF and SMF log shows it.\nFeel free to ask.\n{}\nAnything else?",
}
CATEGORIES = {0: "ran_ops", 1: "core", 2: "transport_backhaul", 3: "ims_volte"}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, category, messages. A record is at most three turns, whatever the conversation's length."""
    t = turns(spark, sf_dir)
    text, pick = F.col("text"), (F.col("conv_id") + F.col("turn")) % 7
    answer = None
    for i, form in ENDINGS.items():
        head, tail = form.split("{}")
        value = F.concat(F.lit(head), text, F.lit(tail))
        answer = F.when(pick == i, value) if answer is None else answer.when(pick == i, value)
    content = F.when(F.col("role") == "assistant", answer).otherwise(text)
    part = F.floor(F.col("turn") / 3).cast("long")
    entry = F.struct("turn", "role", content.alias("content"))
    rows = t.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("m"))
    label = None
    for i, name in CATEGORIES.items():
        label = F.when(F.col("conv_id") % 5 == i, name) if label is None else label.when(F.col("conv_id") % 5 == i, name)
    return rows.select(
        (F.col("conv_id") * 1_000_000 + F.col("part")).alias("row_id"),
        label.alias("category"),
        F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
    )


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ANSWER_SQL = " ".join(
    f"WHEN {i} THEN {sql_text(f.split('{}')[0])} || text || {sql_text(f.split('{}')[1])}" for i, f in ENDINGS.items()
)
CHAT_SQL = f"""
turns3 AS (SELECT conv_id, turn, turn // 3 AS part, role,
  CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 7 {_ANSWER_SQL} END ELSE text END AS content
  FROM conversations),
chat AS (SELECT conv_id * 1000000 + part AS row_id,
  any_value(CASE conv_id % 5 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in CATEGORIES.items())} END) AS category,
  list({{'role': role, 'content': content}} ORDER BY turn) AS messages
  FROM turns3 GROUP BY conv_id, part)"""

# --- answers: whole documents followed by a phrase the quality rules look for -----------------
PHRASES = {
    0: " Please consult the manual. Hope this helps.",
    1: " Check the RSRP counter and the AMF timer; step 1 is to verify the root cause.",
    2: " There is a 45% probability of it. Root causes (ranked): 1.",
    3: " The first check is `show alarm`, `show cells`, `show links`, `show state` and `show power`.",
    4: " Contact your vendor or contact support; it depends on the specific handover and paging of the AMF.",
    5: " Latency and throughput of the backhaul are low.",
}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, question, answer, lang, source."""
    d = table(spark, sf_dir, "documents")
    tail = F.lit("")
    for i, phrase in PHRASES.items():
        tail = F.when(F.col("doc_id") % 8 == i, phrase).otherwise(tail)
    return d.select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("question"),
        F.concat("text", tail).alias("answer"), "lang", "source",
    )


ANSWERS_SQL = f"""
answers AS (SELECT doc_id AS row_id, text AS question, text || CASE doc_id % 8
  {' '.join(f"WHEN {i} THEN {sql_text(p)}" for i, p in PHRASES.items())} ELSE '' END AS answer, lang, source
  FROM documents)"""

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


# --- source groups of documents -------------------------------------------------------------
def new_and_base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of odd-numbered sources form the new corpus, all others the base (sources with an even number, with none, null);
    together they are the whole table."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("question"), "lang", "source"
    )
    number = F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(0))
    return d.filter(number % 2 == 1), d.filter(number % 2 == 0)


SOURCES_SQL = r"""
newq AS (SELECT doc_id AS row_id, text AS question, lang, source FROM documents
  WHERE coalesce(TRY_CAST(regexp_extract(source, '(\d+)', 1) AS INT), 0) % 2 = 1),
baseq AS (SELECT doc_id AS row_id, text AS question, lang, source FROM documents
  WHERE coalesce(TRY_CAST(regexp_extract(source, '(\d+)', 1) AS INT), 0) % 2 = 0)"""
