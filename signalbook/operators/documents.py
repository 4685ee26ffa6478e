"""Documents to retrieval tables: sections, chunks, templates, vector search, context."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.text import stable_hash, strip, words
from signalbook.operators.scans import positions, span_bucket

HEADING = r"\n(#{2,4}\s+[^\n]+)\n"
HEAD, BODY = "\u0001", "\u0002"


def filter_docs(df: DataFrame, text="text", filename="filename", min_chars: int = 100) -> DataFrame:
    return df.filter((F.length(text) >= min_chars) & (F.col(filename) != "README.md"))


def filter_sections(df: DataFrame, content="content", min_chars: int = 100, min_words: int = 30) -> DataFrame:
    body = F.col(content)
    return df.filter((F.length(strip(body)) > min_chars) & (F.size(words(body)) >= min_words))


def sections(df: DataFrame, key="doc_id", text="text", max_chars: int = 2000, min_chars: int = 100) -> DataFrame:
    """(key, pos, title, content) per heading of level 2-4 whose body is longer than ``min_chars``.

    A heading right after another heading's line end is part of the body and hides its section.
    """
    marked = F.regexp_replace(F.translate(F.col(text), HEAD + BODY, ""), HEADING, f"{HEAD}$1{BODY}")
    parts = df.select(key, F.posexplode(F.split(marked, HEAD)).alias("pos", "part")).filter("pos > 0")
    title = F.regexp_replace(F.split("part", BODY, 2)[0], r"^[# \n]+|[# \n]+$", "")
    raw = F.get(F.split("part", BODY, 2), F.lit(1))
    body = strip(raw)
    kept = parts.select(key, "pos", title.alias("title"), raw.alias("raw"), body.alias("body"))
    return kept.filter((F.length("body") > min_chars) & (F.col("title") != "") & ~F.col("raw").rlike(r"^#{2,4}\s+")).select(
        key, "pos", "title", F.substring("body", 1, max_chars).alias("content"))


def chunk(df: DataFrame, key="doc_id", text="text", size: int = 512, overlap: int = 50) -> DataFrame:
    """Word windows of ``size`` with ``overlap`` words shared by neighbours."""
    step = size - overlap
    tokens = df.select(key, words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    n = F.greatest(F.lit(1), F.ceil((F.size("_w") - overlap) / step).cast("int"))
    return tokens.select(key, "_w", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no")).select(
        key, "chunk_no", F.array_join(F.slice("_w", F.col("chunk_no") * step + 1, size), " ").alias("chunk"))


# --- templates -------------------------------------------------------------------------------
def pick(templates: list[str], seed: Column) -> Column:
    if not templates:
        return F.lit(None).cast("string")
    return F.get(F.array(*[F.lit(t) for t in templates]), (seed % len(templates)).cast("int"))


def fill(template: Column, slots: dict[str, Column]) -> Column:
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def question_from_title(title: Column, seed: Column, templates=None) -> Column:
    return fill(pick(rules.SECTION_QUESTIONS if templates is None else templates, seed), {"title": title})


def intent_prompts(intent: Column, seed: Column, templates=None) -> Column:
    return fill(pick(rules.INTENT_PROMPTS if templates is None else templates, seed), {"intent": intent})


def fill_templates(params: DataFrame, templates: list[tuple[str, str, str, str, str]], key: str, slots: list[str], seed: int = 0) -> DataFrame:
    """One incident question per parameter row: template and question shape follow from its hash.

    Templates are (alarm, diagnosis, resolution, severity, domain); a row whose template still has
    an open slot is dropped.
    """
    fields = ("alarm", "diagnosis", "resolution", "severity", "domain")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, t)]) for t in templates])
    h = stable_hash(key, F.lit(seed))
    rows = params.withColumn("_t", F.get(table, (h % len(templates)).cast("int")))
    values = {s: F.col(s).cast("string") for s in slots}
    for part in ("alarm", "diagnosis", "resolution"):
        rows = rows.withColumn(part, fill(F.col("_t")[part], values))
    alarm, diagnosis, resolution = F.col("alarm"), F.col("diagnosis"), F.col("resolution")
    shape = F.floor(h / len(templates)) % 3
    instruction = (
        F.when(shape == 0, F.concat(F.lit("Find the cause of this alarm: "), alarm))
        .when(shape == 1, F.concat(alarm, F.lit("\nCause: "), diagnosis, F.lit("\n\nHow is it put right?")))
        .otherwise(F.concat(alarm, F.lit("\n\nName the cause and how to put it right."))))
    response = (
        F.when(shape == 0, diagnosis).when(shape == 1, resolution)
        .otherwise(F.concat(F.lit("Cause: "), diagnosis, F.lit("\n\nRemedy: "), resolution)))
    category = F.when(shape == 0, "noc_diagnosis").when(shape == 1, "noc_resolution").otherwise("noc_full")
    complete = ~F.concat("alarm", "diagnosis", "resolution").rlike(r"\{\w+\}")
    return rows.filter(complete).select(
        key, instruction.alias("instruction"), response.alias("response"), category.alias("category"),
        F.col("_t.severity").alias("severity"), F.col("_t.domain").alias("domain"))


def fan_out(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def prompt_variants(df: DataFrame, question: str, templates=None) -> DataFrame:
    forms = [fill(F.lit(t), {"question": F.col(question)}) for t in (rules.PROMPT_VARIANTS if templates is None else templates)]
    return df.select("*", F.posexplode(F.array(*forms).cast("array<string>")).alias("variant", "instruction"))


def mcq_forms(df: DataFrame, question="question", choices="choices", answer="answer", explanation="explanation") -> DataFrame:
    """Closed and open form of every multiple-choice item."""
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("  "), i.cast("string"), F.lit(": "), c)), "\n")
    right = F.get(choices, F.col(answer))
    why = F.concat(F.lit("\n\n"), F.col(explanation))
    closed = F.struct(
        F.concat(question, F.lit("\n\nChoices:\n"), lines, F.lit("\n\nReply with the number that fits, then the reason.")).alias("instruction"),
        F.concat(F.lit("Number "), F.col(answer).cast("string"), F.lit(": "), right, why).alias("response"),
        F.lit("mcq_telecom").alias("category"))
    opened = F.struct(F.col(question).alias("instruction"), F.concat(right, why).alias("response"), F.lit("telecom_knowledge").alias("category"))
    return df.select("*", F.inline(F.array(closed, opened)))


# --- vector search ---------------------------------------------------------------------------
QUERY_BLOCK = 4096  # query vectors held in memory by a task at a time


def knn(queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "l2") -> DataFrame:
    """(query_id, vec_id, distance, rank): exact ``k`` nearest vectors per query.

    Queries are few next to the vectors. Blocks of at most ``QUERY_BLOCK`` of them go to the tasks;
    every batch of vectors keeps only its ``k`` best per query before anything is shuffled, so
    vectors never move. More queries mean more passes, not a larger block. Distance is the squared
    L2 distance or one minus the cosine; ties go to the smaller id. Null vectors take no part on either side; without
    queries the result is empty.
    """
    queries, vectors = (x.filter(F.col("embedding").isNotNull()) for x in (queries, vectors))
    placed = positions(queries.select("query_id", "embedding"), ["query_id"], span_bucket("query_id")).withColumn(
        "block", F.floor(F.col("pos") / QUERY_BLOCK)).drop("pos")
    out = None
    for block in count():
        rows = placed.filter(F.col("block") == block).select("query_id", "embedding").collect()
        if not rows:
            break
        part = _knn_block([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64), vectors, k, metric)
        out = part if out is None else out.unionByName(part)
        if len(rows) < QUERY_BLOCK:
            break
    if out is None:
        out = queries.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
    w = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _knn_block(ids: list, matrix: np.ndarray, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def nearest(batches):
        ids, q = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            v, vec = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["vec_id"].to_numpy()
            rows = []
            for i, x in enumerate(q):
                if metric == "l2":
                    d = ((v - x) ** 2).sum(axis=1)
                else:
                    d = 1 - (v @ x) / (np.linalg.norm(v, axis=1) * np.linalg.norm(x))
                best = np.lexsort((vec, d))[:k] if len(d) <= 4 * k else _smallest(d, vec, k)
                rows += [(ids[i], vec[j], d[j]) for j in best]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "distance"])

    return vectors.select("vec_id", "embedding").mapInPandas(nearest, "query_id long, vec_id long, distance double")


def _smallest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances, ties by id, without sorting everything."""
    limit = np.partition(d, k - 1)[k - 1]
    near = np.flatnonzero(d <= limit)
    return near[np.lexsort((ids[near], d[near]))][:k]


def assemble_context(hits: DataFrame, cap: int = 500, sep: str = "\n\n---\n\n") -> DataFrame:
    """Context and labels per query from its top hits (query_id, rank, text, release, series, spec)."""
    unknown = lambda c: F.coalesce(c, F.lit("?"))
    label = F.concat_ws("/", unknown(F.col("release")), unknown(F.col("series")), unknown(F.col("spec")))
    top = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, cap).alias("t"), label.alias("l")))).alias("h"))
    return top.select(
        "query_id", F.array_join(F.transform("h", lambda x: x["t"]), sep).alias("context"),
        F.array_join(F.transform("h", lambda x: x["l"]), ", ").alias("labels"),
        F.array_join(F.transform("h", lambda x, i: F.concat(
            F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), x["l"], F.lit("]\n"), x["t"])), "\n\n").alias("numbered"))
