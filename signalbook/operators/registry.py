"""Agent registry over run logs: validation, usage, lifecycle, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.entities import keyword_words, split_words
from signalbook.operators.scans import running

# Rows of one word joined in one task; there are at most (rows / HOT_WORD_ROWS) words with more.
HOT_WORD_ROWS = 100_000


def validate_agents(df: DataFrame) -> DataFrame:
    """``valid``: name and domain of at least 3 characters, prompt of 50, three keywords, known tools."""

    def long_enough(c, n):
        return F.coalesce(F.length(c) >= n, F.lit(False))

    tools = F.coalesce(F.size(F.array_except("tools", F.array(*[F.lit(t) for t in rules.TOOLS]))) == 0, F.lit(True))
    ok = (
        long_enough("name", 3) & long_enough("domain", 3) & long_enough("system_prompt", 50)
        & F.coalesce(F.size("keywords") >= 3, F.lit(False)) & tools
    )
    return df.withColumn("valid", ok)


def agent_usage(runs: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("success")
    return runs.groupBy("agent_id").agg(
        n.alias("use_count"), ok.alias("success_count"), F.max("created_at").alias("last_used"), (ok / n).alias("rate"))


def promotions(runs: DataFrame) -> DataFrame:
    """(agent_id, promoted_at_run): first run after which uses and success rate both suffice.

    Later failures never take a promotion back. Runs are scanned in hour buckets per agent.
    """
    counted = running(
        runs, ["agent_id"], ["created_at", "run_id"], F.date_trunc("hour", "created_at"),
        sums={"uses": F.lit(1), "wins": F.col("success").cast("int")})
    enough = (F.col("uses") >= rules.MIN_USES_FOR_PROMOTION) & (F.col("wins") / F.col("uses") >= rules.MIN_SUCCESS_RATE_FOR_PROMOTION)
    return counted.filter(enough).groupBy("agent_id").agg(F.min("uses").alias("promoted_at_run"))


def lifecycle(agents: DataFrame, runs: DataFrame, now: Column, min_age_days: int = 30) -> DataFrame:
    """Final status of every agent with its use counts."""
    usage = agent_usage(runs)
    joined = agents.join(usage, "agent_id", "left").join(promotions(runs), "agent_id", "left")
    uses = F.coalesce("use_count", F.lit(0))
    old = F.col("created_at") < now - F.make_interval(days=F.lit(min_age_days))
    candidate = F.col("status") == "candidate"
    final = (
        F.when(candidate & F.col("promoted_at_run").isNotNull(), "active")
        .when(candidate & (uses == 0) & old, "pruned").otherwise(F.col("status"))
    )
    return joined.withColumns({
        "status": final, "use_count": uses, "success_count": F.coalesce("success_count", F.lit(0))})


def list_agents(df: DataFrame, status: str | None = None) -> DataFrame:
    if status:
        return df.filter(F.col("status") == status).orderBy(F.desc("use_count"), "agent_id")
    return df.filter(F.col("status") != "pruned").orderBy("status", F.desc("use_count"), "agent_id")


def registry_stats(agents: DataFrame, runs: DataFrame) -> DataFrame:
    return agents.agg(
        F.count(F.lit(1)).alias("total_agents"), F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "candidate").alias("candidates"),
    ).withColumn("total_runs", runs.agg(F.count(F.lit(1))).scalar())


def _word_hits(left: DataFrame, right: DataFrame, hot_rows: int = HOT_WORD_ROWS) -> DataFrame:
    """Rows of (q_id, word) and (agent_id, word, ...) that share a word.

    Words of very many rows on the left are dealt over as many salts as their number asks for, and their agents repeated for each;
    words that no agent has are left out before anything is salted.
    """
    counts = left.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = F.broadcast(counts.join(right.select("word").distinct(), "word", "left_semi").select("word", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = left.join(hot, "word", "left").withColumn("_salt", F.pmod(F.xxhash64("q_id"), salts).cast("int")).drop("_salts")
    copies = right.join(hot, "word", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(copies, ["word", "_salt"]).drop("_salt")


def route_by_keywords(queries: DataFrame, agents: DataFrame, text: str = "text") -> DataFrame:
    """(q_id, agent_id, score): best active or candidate agent by word overlap, at least 1.5 points.

    A keyword word counts 1, a name or domain word 0.5, an active agent 1. Ties go to the first by
    status and id.
    """
    q = queries.select("q_id", F.explode(F.array_distinct(split_words(F.col(text)))).alias("word"))
    live = agents.filter(F.col("status").isin("active", "candidate"))

    def weighted(ws, weight):
        return F.transform(F.array_distinct(ws), lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight")))

    name = split_words(F.replace("name", F.lit("Agent"), F.lit("")), 3, r"\s+")
    table = live.select("agent_id", "status", F.inline(F.concat(
        weighted(keyword_words(F.col("keywords")), 1.0), weighted(name, 0.5), weighted(split_words(F.col("domain"), 3, r"[_\s]+"), 0.5))))
    points = _word_hits(q, table).groupBy("q_id", "agent_id", "status").agg(F.sum("weight").alias("overlap"))
    score = F.col("overlap") + F.when(F.col("status") == "active", 1.0).otherwise(0.0)
    first = F.min(F.struct((-score).alias("minus"), "status", "agent_id")).alias("best")
    return points.filter(score >= 1.5).groupBy("q_id").agg(first).select(
        "q_id", F.col("best.agent_id").alias("agent_id"), (-F.col("best.minus")).alias("score"))


def similar_domains(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(q_id, agent_id): first existing agent whose words overlap enough with a new domain.

    Enough is: more than 0.3 of the smaller word set and at least 3 words, or a shared word of the
    domain names.
    """

    def word_sets(df):
        name = F.filter(F.split(F.lower("domain"), r"[_\s]+"), lambda w: w != "")
        every = F.array_union(keyword_words(F.col("keywords")), F.filter(name, lambda w: F.length(w) >= 3))
        return df.select(df.columns[0], every.alias("ws"), F.array_distinct(name).alias("ds"), F.size(every).alias("n")).filter("n > 0")

    a, b = word_sets(new), word_sets(existing.filter(F.col("status") != "pruned"))
    shared = _word_hits(
        a.select("q_id", F.col("n").alias("n_a"), F.explode("ws").alias("word")),
        b.select("agent_id", F.col("n").alias("n_b"), F.explode("ws").alias("word")),
    ).groupBy("q_id", "agent_id", F.least("n_a", "n_b").alias("smaller")).agg(F.count(F.lit(1)).alias("both"))
    by_words = shared.filter((F.col("both") >= 3) & (F.col("both") / F.col("smaller") > 0.3)).select("q_id", "agent_id")
    by_name = _word_hits(a.select("q_id", F.explode("ds").alias("word")), b.select("agent_id", F.explode("ds").alias("word")))
    return by_words.union(by_name.select("q_id", "agent_id")).groupBy("q_id").agg(F.min("agent_id").alias("agent_id"))
