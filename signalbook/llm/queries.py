"""Registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.llm import (
    chat_format, exact_dedup, html_extract, language_id, line_dedup, neighbours, ngram_join, packing, phrases, sentencepiece_codec, simhash,
    spelling, token_counts,
)
from signalbook.llm.frames import bounded_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_extract")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_report(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query("op3_line_dedup", """
WITH lines AS (
    SELECT doc_id, text, coalesce(source, '') AS host, source IS NULL AS no_host, i, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM (SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
),
totals AS (
    SELECT coalesce(source, '') AS host, source IS NULL AS no_host, count(DISTINCT coalesce(text, '')) AS host_pages FROM documents GROUP BY ALL
),
counts AS (
    SELECT host, no_host, trim(line) AS line, count(DISTINCT text) AS pages FROM lines WHERE trim(line) <> '' GROUP BY ALL
),
bad AS (
    SELECT host, no_host, line FROM counts JOIN totals USING (host, no_host)
    WHERE (pages >= 5 AND pages > 0.1 * host_pages) OR (pages >= 3 AND pages >= 0.8 * host_pages)
),
marked AS (
    SELECT l.*, b.line IS NOT NULL AS dropped
    FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.no_host = b.no_host AND trim(l.line) = b.line
)
SELECT doc_id, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS lines_dropped,
    CAST(length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS BIGINT) AS n_chars,
    md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS text_md5
FROM marked GROUP BY doc_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the lines on over a tenth of their source's documents dropped."""
    done = line_dedup.drop_site_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return done.select(
        "doc_id", F.col("_lines_dropped").alias("lines_dropped"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


@query("op5_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_owners(_table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=1024, end_id=0)


@query("op9_chat_format")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose turns hold strings that look like control strings."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.render(turns, public_tokenizers.path(BYTE_BPE)))


@query("op10_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


@query("op11_phrases", r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
lists AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) s(size))
),
counts AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
cuts AS (
    SELECT lang, phrase, a, size, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
),
halves AS (
    SELECT c.lang, c.phrase, c.a, c.k, f.a AS l, s.a AS r, (2000000::HUGEINT * c.a) // (f.a::HUGEINT + s.a) AS score
    FROM cuts c JOIN counts f ON f.lang = c.lang AND f.phrase = c.first JOIN counts s ON s.lang = c.lang AND s.phrase = c.rest
),
lowest AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
    SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM candidates, (VALUES (2), (3)) t(m) WHERE m < size)
),
dropped AS (
    SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_parts p USING (lang, phrase) WHERE 100::HUGEINT * p.a >= 80::HUGEINT * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
    CAST(score AS BIGINT) AS score
FROM lowest ANTI JOIN dropped USING (lang, phrase) JOIN totals USING (lang)
QUALIFY rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=30, top=2000, share=80)


@query("op12_spelling", r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, w, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w
          FROM documents)
    WHERE length(w) >= 6 GROUP BY ALL
),
crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)
),
hashed AS (
    SELECT w, c, xor(4294967295, list_reduce(
        [4294967295] || flatten(list_transform(string_split(concat(doc_id, ':', w), ''),
            lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 | (ord(x) >> 6), 128 | (ord(x) & 63)] END)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
    FROM runs, crc_table
),
words AS (
    SELECT w, CAST(sum(c) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, c FROM hashed)
    WHERE length(w) >= 6 GROUP BY w HAVING sum(c) >= 5
),
places AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words),
cut AS (SELECT w, n, substr(w, 1, i - 1) || '*' || substr(w, i + 1) AS one, substr(w, 1, i - 1) || substr(w, i + 1) AS less FROM places),
near AS (
    SELECT a.w, b.w AS v, b.n FROM cut a JOIN cut b ON a.one = b.one AND a.w <> b.w
    UNION SELECT a.w, b.w, b.n FROM cut a JOIN words b ON a.less = b.w
    UNION SELECT b.w, a.w, a.n FROM cut a JOIN words b ON a.less = b.w
),
best AS (
    SELECT w, count(*) AS n_near, max(n) AS top, first(v ORDER BY n DESC, v) AS v FROM near GROUP BY w
),
formed AS (
    SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * words.n THEN v END AS form,
        CASE WHEN top >= 5 * words.n THEN top END AS form_n
    FROM words LEFT JOIN best ON words.w = best.w
),
chain AS (
    SELECT w, w AS at FROM formed
    UNION ALL SELECT chain.w, formed.form FROM chain JOIN formed ON formed.w = chain.at WHERE formed.form IS NOT NULL
),
roots AS (SELECT chain.w, chain.at AS root FROM chain JOIN formed ON formed.w = chain.at WHERE formed.form IS NULL)
SELECT formed.w AS word, form, root, n, n_near, form_n FROM formed JOIN roots ON roots.w = formed.w
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"), shortest=6, least=5, factor=5, slips=199)


@query("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
