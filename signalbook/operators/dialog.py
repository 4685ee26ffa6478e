"""Conversation memory: recent context, last answers and follow-up routing per turn.

Conversations are cut into blocks along their turns, so one very long conversation is spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbook.functions.entities import is_followup
from signalbook.functions.text import words
from signalbook.operators.scans import positions, running, with_halo

BLOCK = 4096


def _turn_bucket():
    return F.floor(F.col("turn") / BLOCK).cast("long")


def context_at_turn(df: DataFrame, last: int = 6, cut: int = 150) -> DataFrame:
    """``context``: the ``last`` entries before each turn (conv_id, turn, role, text, agent), each cut
    to ``cut`` characters; empty text at the first turn."""
    placed = positions(df, ["turn"], _turn_bucket(), keys=["conv_id"])
    blocks = with_halo(placed, ["conv_id"], "pos", last, BLOCK)
    speaker = F.concat(F.lit("["), F.upper("role"), F.coalesce(F.concat(F.lit(" via "), F.col("agent")), F.lit("")), F.lit("]: "))
    line = F.concat(speaker, F.substring("text", 1, cut))
    w = W.partitionBy("conv_id", "_block").orderBy("pos").rowsBetween(-last, -1)
    out = blocks.withColumn("_lines", F.collect_list(line).over(w)).filter(~F.col("_halo"))
    text = F.concat(F.lit("Recent conversation:\n"), F.array_join("_lines", "\n"))
    return out.withColumn("context", F.when(F.size("_lines") > 0, text).otherwise("")).drop("_lines", "_block", "_halo")


def last_response(df: DataFrame) -> DataFrame:
    """``last_text`` and ``last_category`` of the latest assistant entry before each turn, and
    ``prior``, the number of earlier entries."""
    said = F.when(F.col("role") == "assistant", F.struct("text", "category"))
    out = running(df, ["conv_id"], ["turn"], _turn_bucket(), sums={"_n": F.lit(1)}, lasts={"_last": said})
    return out.select(
        *df.columns, F.col("_last.text").alias("last_text"), F.col("_last.category").alias("last_category"),
        (F.col("_n") - 1).alias("prior"))


def route_turns(df: DataFrame, indicators=None, max_words: int = 8, cut: int = 500) -> DataFrame:
    """Follow-up flag, enriched query and inherited category of every user turn."""
    t = last_response(df).filter(F.col("role") == "user")
    follows = is_followup(F.col("text"), indicators) & (F.col("prior") >= 2) & F.col("last_text").isNotNull()
    enriched = F.concat(
        F.lit("Previous context: "), F.substring("last_text", 1, cut), F.lit("\n\nFollow-up question: "), F.col("text"))
    short = F.size(words(F.col("text"))) <= max_words
    return t.withColumns({
        "followup": follows,
        "query": F.when(follows, enriched).otherwise(F.col("text")),
        "inherited": F.when(follows & short & (F.coalesce("last_category", F.lit("")) != ""), F.col("last_category")),
    })
