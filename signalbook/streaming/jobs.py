"""Structured Streaming forms of the network, agent and dedup operators.

All take a streaming DataFrame with an event-time column of type timestamp and return one.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.network import is_degraded
from signalbook.functions.text import normalized
from signalbook.session import shared_folder


def kpi_hourly(stream: DataFrame, delay: str = "1 hour", metric: str = "value") -> DataFrame:
    """Count and mean per cell and hour, final once the watermark has passed the hour."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "cell_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean_value")).select(
        "cell_id", F.col("window.start").alias("hour_ts"), "n", "mean_value")


def degradation_sliding(stream: DataFrame, size: str = "3 hours", step: str = "1 hour", delay: str = "1 hour", share: float = 0.5) -> DataFrame:
    """Windows in which at least ``share`` of a cell's samples are degraded or critical."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "cell_id")
    counted = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_degraded(F.col("status"))).alias("degraded"))
    return counted.filter(F.col("degraded") / F.col("n") >= share).select(
        "cell_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "degraded")


def alarm_sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Bursts of alarms per cell: a session ends after ``gap`` without a new alarm."""
    w = stream.withWatermark("raised_time", delay).groupBy(F.session_window("raised_time", gap), "cell_id")
    return w.agg(F.count(F.lit(1)).alias("alarms")).select(
        "cell_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "alarms")


def usage_state(stream: DataFrame) -> DataFrame:
    """Running uses, wins and the run at which an agent was promoted; promotion is never undone.

    The state is three numbers per agent. Runs of one trigger are taken in time order.
    """

    def update(key, batches, state):
        uses, wins, promoted = state.get if state.exists else (0, 0, 0)
        runs = pd.concat(list(batches)).sort_values(["created_at", "run_id"])
        n = uses + pd.Series(range(1, len(runs) + 1), index=runs.index)
        w = wins + runs["success"].astype(int).cumsum()
        enough = n[(n >= rules.MIN_USES_FOR_PROMOTION) & (w / n >= rules.MIN_SUCCESS_RATE_FOR_PROMOTION)]
        if not promoted and len(enough):
            promoted = int(enough.iloc[0])
        uses, wins = int(n.iloc[-1]), int(w.iloc[-1])
        state.update((uses, wins, promoted))
        yield pd.DataFrame({"agent_id": [key[0]], "uses": [uses], "wins": [wins], "promoted_at_run": [promoted]})

    return stream.groupBy("agent_id").applyInPandasWithState(
        update, "agent_id long, uses long, wins long, promoted_at_run long", "uses long, wins long, promoted long", "update", "NoTimeout")


def dedup_stream(stream: DataFrame, delay: str = "1 hour", text: str = "question") -> DataFrame:
    """First arrival of every question within the watermark delay."""
    keyed = stream.withColumn("_key", F.sha2(normalized(F.col(text)), 256)).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def correlate_stream(changes: DataFrame, alarms: DataFrame, within: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Alarms with the changes of their cell in the time before; both sides forget by watermark.

    Rows meet by cell and time slot, a slot as long as ``within``: an alarm lies in its own slot, a change in all that its reach
    runs into. An alarm is tested against the changes of about twice that time, not against all that its cell keeps.
    """
    reach = F.expr(f"interval {within}")
    length = F.greatest(F.unix_micros(F.timestamp_seconds(F.lit(0)) + reach), F.lit(1_000_000))

    def slot(at: Column) -> Column:
        return F.floor(F.unix_micros(at) / length)

    c = changes.select(F.col("cell_id").alias("c_cell"), "change_id", "param", "time").withWatermark("time", delay)
    c = c.withColumn("c_slot", F.explode(F.sequence(slot(F.col("time")), slot(F.col("time") + reach))))
    a = alarms.withWatermark("raised_time", delay).withColumn("_slot", slot(F.col("raised_time")))
    near = (F.col("cell_id") == F.col("c_cell")) & (F.col("_slot") == F.col("c_slot")) & (
        F.col("raised_time") >= F.col("time")) & (F.col("raised_time") <= F.col("time") + reach)
    return a.join(c, near).select("alarm_id", "cell_id", "change_id", "param")


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything the sources hold now and return the written rows as a table.

    Append results go to a Parquet sink; update results go to one folder per trigger, so a repeated
    trigger overwrites its own output. Both live next to the query's checkpoint in the shared folder.
    """
    spark: SparkSession = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{base}/rows").start()
    else:
        def save(batch: DataFrame, batch_id: int):
            batch.write.mode("overwrite").parquet(f"{base}/rows/trigger={batch_id}")

        q = writer.outputMode(mode).foreachBatch(save).start()
    q.awaitTermination()
    schema = df.schema if mode == "append" else df.schema.add("trigger", "long")
    return spark.read.schema(schema).parquet(f"{base}/rows")
