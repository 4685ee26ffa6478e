"""Streaming jobs that need state of their own: usage in event order, and the last change before an alarm.

Rows wait in state until the watermark has passed them, so results do not depend on the order of arrival. What waits is kept
per key and time slot: the rows of a busy agent or cell lie in as many state partitions as it has slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from signalbook import rules

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """State with timers and maps needs the store on disk; sessions that name another store than the default keep it."""
    named = spark.conf.get(_STORE, "")
    if not named or named.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_STORE, _ROCKS)


class UsageInOrder(StatefulProcessor):
    """Uses, wins and the promoting run of an agent, from the outcomes of its closed slots.

    All slots that one trigger closes come together, and those of later triggers end later: putting a trigger's slots in order is enough,
    whatever the order of arrival. The state is read and written once per agent and trigger.
    """

    def __init__(self, min_uses: int, min_rate: float):
        self._uses, self._rate = min_uses, Fraction(str(min_rate))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._total = handle.getValueState("total", "uses long, wins long, promoted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots = sorted((int(at), bytes(outcomes)) for part in rows for at, outcomes in zip(part["closed_ms"], part["outcomes"]))
        uses, wins, promoted = self._total.get() or (0, 0, 0)
        out = []
        for at, outcomes in slots:
            if promoted:
                uses, wins = uses + len(outcomes), wins + outcomes.count(1)
            else:
                for won in outcomes:
                    uses, wins = uses + 1, wins + won
                    if not promoted and uses >= self._uses and wins * self._rate.denominator >= self._rate.numerator * uses:
                        promoted = uses
            out.append((at, uses, wins, promoted))
        self._total.update((uses, wins, promoted))
        closed, *counts = zip(*out)
        yield pd.DataFrame({
            "agent_id": [None if key[1] else key[0]] * len(out), "closed": pd.to_datetime(closed, unit="ms"), **dict(zip(["uses", "wins", "promoted_at_run"], counts))})

    def close(self) -> None:
        pass


def usage_in_order(
    stream: DataFrame, slot: str = "1 hour", delay: str = "1 hour",
    min_uses: int = rules.MIN_USES_FOR_PROMOTION, min_rate: float = rules.MIN_SUCCESS_RATE_FOR_PROMOTION,
) -> DataFrame:
    """agent_id, closed, uses, wins, promoted_at_run: the counts of every agent after each of its slots.

    ``stream``: run_id, agent_id, created_at, success (null counts as a failure). Runs count in the order of (created_at, run_id) even if they
    arrive out of order; runs behind the watermark are dropped. ``promoted_at_run`` is the first run at which the agent had enough uses and wins, 0 before, and is
    never undone.

    First the runs of each (agent, slot) are gathered and put in order, each slot by itself; then the agent's slots
    are counted one after the other, a byte for each run. Rows come when the watermark passes the end of a slot.
    """
    with_state_store(stream.sparkSession)
    run = F.struct("created_at", "run_id", F.coalesce(F.col("success"), F.lit(False)).alias("success"))
    slots = stream.withWatermark("created_at", delay).groupBy(F.window("created_at", slot), "agent_id").agg(F.collect_list(run).alias("runs"))
    # One byte for each run, in order.
    flags = F.array_join(F.transform(F.array_sort("runs"), lambda r: F.when(r["success"], "01").otherwise("00")), "")
    # A null key would turn its neighbours' keys into floats on the way to the Python workers.
    key = [F.coalesce("agent_id", F.lit(0)).alias("agent_id"), F.col("agent_id").isNull().alias("no_agent")]
    ordered = slots.select(*key, "window", F.unix_millis("window.end").alias("closed_ms"), F.unhex(flags).alias("outcomes"))
    return ordered.groupBy("agent_id", "no_agent").transformWithStateInPandas(
        UsageInOrder(min_uses, min_rate), "agent_id long, closed timestamp, uses long, wins long, promoted_at_run long", "append", "eventTime")


class LastChange(StatefulProcessor):
    """The last change before each alarm of a (cell, slot), once the slot is closed."""

    def __init__(self, within_ms: int):
        self._within = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._changes = handle.getListState("changes", "at_us long, id long, param string")
        self._alarms = handle.getListState("alarms", "at_us long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for kind, state, columns in ((0, self._changes, ["at_us", "id", "param"]), (1, self._alarms, ["at_us", "id"])):
                found = part.loc[part["kind"] == kind, columns]
                if len(found):
                    state.appendList([tuple(r) for r in found.astype({"at_us": int, "id": int}).astype(object).where(found.notna(), None).itertuples(index=False)])
            self._handle.registerTimer(int(part["closed_ms"].iloc[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        changes = sorted(self._changes.get(), key=lambda c: c[:2]) if self._changes.exists() else []
        alarms = sorted(self._alarms.get()) if self._alarms.exists() else []
        self._changes.clear()
        self._alarms.clear()
        out, at, last = [], 0, None
        for time, alarm in alarms:
            while at < len(changes) and changes[at][0] <= time:
                last, at = changes[at], at + 1
            near = last if last is not None and time - last[0] <= self._within * 1000 else None
            out.append((alarm, key[0], near and near[1], near and near[2], near and (time - near[0]) // 1_000_000))
        if out:
            frame = pd.DataFrame(out, columns=["alarm_id", "cell_id", "change_id", "param", "age_seconds"])
            yield frame.astype({"change_id": "Int64", "age_seconds": "Int64"})

    def close(self) -> None:
        pass


def last_change_stream(
    changes: DataFrame, alarms: DataFrame, within_seconds: int = 6 * 3600, slot_seconds: int = 6 * 3600, delay: str = "1 hour",
) -> DataFrame:
    """alarm_id, cell_id, change_id, param, age_seconds: every alarm with the last change of its cell in the
    ``within_seconds`` up to it; without one the last three are null.

    ``changes``: change_id, cell_id, param, time. ``alarms``: alarm_id (a long), cell_id, raised_time. A change at the alarm's own time counts;
    of changes at one time the one with the largest id is the last. Rows without a time or behind the watermark are dropped.

    A cell is cut into slots of ``slot_seconds``. Alarms wait in their slot; a change waits in its own slot and in those
    that its reach runs into. A slot's alarms are given out in one go when the watermark passes its end, and its state is dropped.
    """
    if within_seconds <= 0 or slot_seconds <= 0:
        raise ValueError("the range and the slot must be positive")
    with_state_store(changes.sparkSession)
    line = changes.select(
        F.col("time").alias("at"), "cell_id", F.lit(0).alias("kind"), F.col("change_id").cast("long").alias("id"), "param",
        F.lit(-(-within_seconds // slot_seconds)).alias("reach"),
    ).unionByName(alarms.select(
        F.col("raised_time").alias("at"), "cell_id", F.lit(1).alias("kind"), F.col("alarm_id").cast("long").alias("id"),
        F.lit(None).cast("string").alias("param"), F.lit(0).alias("reach")))
    slot = F.floor(F.unix_micros("at") / F.lit(slot_seconds * 1_000_000)).cast("long")
    dealt = (
        line.withWatermark("at", delay).withColumn("slot", F.explode(F.sequence(slot, slot + F.col("reach"))))
        .select("cell_id", "slot", "at", "kind", "id", "param", F.unix_micros("at").alias("at_us"), ((F.col("slot") + 1) * slot_seconds * 1000).alias("closed_ms")))
    return dealt.groupBy("cell_id", "slot").transformWithStateInPandas(
        LastChange(within_seconds * 1000), "alarm_id long, cell_id string, change_id long, param string, age_seconds long", "append", "eventTime")
