"""Sessions, sliding windows and time ranges over event time, as batch operators.

The rows of a busy cell are never gathered in one place: they are reduced to one row per time bucket first, with partial
aggregation before the shuffle, and whatever crosses buckets works on those summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.functions.network import is_degraded
from signalbook.operators.scans import running

_BUCKETS = 4096  # summaries of a key scanned in one piece


def _micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def _time(micros: Column, kind: str) -> Column:
    return F.timestamp_micros(micros).cast(kind)


def sessions(rows: DataFrame, keys: list[str], time: str, gap_seconds: float, aggs: dict[str, Column] | None = None) -> DataFrame:
    """Bursts per key: a session ends where the next row is ``gap_seconds`` or more away.

    One row per session: the keys, ``start`` and ``end`` (its first and last row's time), ``n`` and for each of ``aggs`` the sum of
    that integer column. Rows without a time are in no session; null keys are a key like any other.

    Times are cut into buckets as long as the gap, so the rows of a bucket are of one session and become one summary. Gaps are
    looked for between summaries only; the last end and the number of sessions so far are carried over them in two levels.
    """
    aggs = aggs or {}
    gap = round(gap_seconds * 1_000_000)
    if gap <= 0:
        raise ValueError("the gap must be positive")
    kind = dict(rows.dtypes)[time]
    at = _micros(time)
    names = [f"_key{i}" for i in range(len(keys))]
    # Null keys meet as well: the key as a struct is never null.
    keyed = rows.filter(F.col(time).isNotNull()).select(
        F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names)]).alias("_key"), at.alias("_at"), *[v.alias(f"_v_{k}") for k, v in aggs.items()])
    summaries = keyed.groupBy("_key", F.floor(F.col("_at") / F.lit(gap)).cast("long").alias("_slot")).agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("n"),
        *[F.sum(f"_v_{k}").alias(f"_v_{k}") for k in aggs])
    part = F.floor(F.col("_slot") / _BUCKETS)
    ends = running(summaries, ["_key"], ["_slot"], part, lasts={"_before": F.col("_last")})
    fresh = (F.col("_before").isNull() | (F.col("_first") - F.col("_before") >= gap)).cast("long")
    numbered = running(ends.withColumn("_fresh", fresh), ["_key"], ["_slot"], part, sums={"_session": F.col("_fresh")})
    done = numbered.groupBy("_key", "_session").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("n").alias("n"), *[F.sum(f"_v_{k}").alias(k) for k in aggs])
    return done.select(
        *[F.col(f"_key.{n}").alias(k) for k, n in zip(keys, names)], _time(F.col("_first"), kind).alias("start"),
        _time(F.col("_last"), kind).alias("end"), "n", *aggs)


def alarm_sessions(alarm_rows: DataFrame, gap_seconds: float = 6 * 3600, cell: str = "cell_id", time: str = "raised_time") -> DataFrame:
    """cell_id, start, end, alarms: the batch twin of the streaming job; ``end`` is the last alarm's time and all
    sessions are listed, the last one of a cell too."""
    return sessions(alarm_rows, [cell], time, gap_seconds).select(F.col(cell).alias("cell_id"), "start", "end", F.col("n").alias("alarms"))


def closed(found: DataFrame, gap_seconds: float, watermark: Column) -> DataFrame:
    """The sessions that are final once the watermark has passed."""
    return found.filter(_micros(F.col("end")) + round(gap_seconds * 1_000_000) <= _micros(watermark))


def sliding_sums(rows: DataFrame, keys: list[str], time: str, size_seconds: int, step_seconds: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over all windows of ``size_seconds`` that start at multiples of ``step_seconds`` and hold a row.

    Columns: the keys, ``start``, ``end``, ``sums``. Rows without a time are in no window.

    Rows are added up once per pane (a step); windows are made from panes by doubling, two at a time, so a row or pane is
    never repeated for each of the windows over it.
    """
    if size_seconds <= 0 or step_seconds <= 0 or size_seconds % step_seconds:
        raise ValueError("the size must be a multiple of the step")
    kind = dict(rows.dtypes)[time]
    step = step_seconds * 1_000_000
    names = [f"_key{i}" for i in range(len(keys))]
    values = [f"_v{i}" for i in range(len(sums))]
    add = lambda df: df.groupBy("_key", "_pane").agg(*[F.sum(v).alias(v) for v in values])
    blocks = add(rows.filter(F.col(time).isNotNull()).select(
        F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names)]).alias("_key"),
        F.floor(_micros(time) / F.lit(step)).cast("long").alias("_pane"), *[c.alias(v) for c, v in zip(sums.values(), values)]))
    # ``blocks`` holds sums of 1, 2, 4, ... panes from each start on; the binary digits of the size say which make up a window.
    panes, offset, width, windows = size_seconds // step_seconds, 0, 1, None
    back = lambda df, by: df.withColumn("_pane", F.col("_pane") - by) if by else df
    while panes:
        if panes & 1:
            part = back(blocks, offset)
            windows = part if windows is None else windows.unionByName(part)
            offset += width
        panes >>= 1
        if panes:
            blocks = add(blocks.unionByName(back(blocks, width)))
            width *= 2
    start = F.col("_pane") * step
    return add(windows).select(
        *[F.col(f"_key.{n}").alias(k) for k, n in zip(keys, names)], _time(start, kind).alias("start"),
        _time(start + size_seconds * 1_000_000, kind).alias("end"), *[F.col(v).alias(k) for v, k in zip(values, sums)])


def sliding_degradation(
    samples: DataFrame, size_seconds: int = 3 * 3600, step_seconds: int = 3600, share: float = 0.5, cell: str = "cell_id", time: str = "ts",
) -> DataFrame:
    """cell_id, start, end, n, degraded: windows in which at least ``share`` of a cell's samples are degraded or
    critical (column status; null is neither). The batch twin of the streaming job."""
    found = sliding_sums(samples, [cell], time, size_seconds, step_seconds, {
        "n": F.lit(1), "degraded": F.coalesce(is_degraded(F.col("status")).cast("int"), F.lit(0))})
    return found.filter(F.col("degraded") / F.col("n") >= share).select(F.col(cell).alias("cell_id"), "start", "end", "n", "degraded")


def range_sums(
    rows: DataFrame, keys: list[str], time: str, before_seconds: float, sums: dict[str, Column], slot_seconds: int = 3600,
) -> DataFrame:
    """Add to every row the sums over the rows of its key in the time (t - before, t]: a RANGE frame, so all rows with the
    row's own time are in it. Columns of ``sums`` are integer or decimal; ``F.lit(1)`` counts. Rows without a time get nulls.

    Every distinct time of a key asks for the running sum at two places of the key's time line, at t and at t - before; the sum is the
    difference. The running sums are taken in two levels over slots of ``slot_seconds``, so no frame and no
    key has to fit into one task, and the work does not grow with the length of the range.
    """
    span = round(before_seconds * 1_000_000)
    if span <= 0:
        raise ValueError("the range must be positive")
    at, key = _micros(time), F.struct(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    names = [f"_v{i}" for i in range(len(sums))]
    line = rows.filter(F.col(time).isNotNull()).select(key.alias("_key"), at.alias("_at"), *[c.alias(n) for c, n in zip(sums.values(), names)])
    types = dict(line.dtypes)
    # One row per time: repeated times need no more places of their own.
    line = line.groupBy("_key", "_at").agg(*[F.sum(n).cast(_wider(types[n])).alias(n) for n in names])
    nothing = [F.lit(None).cast(_wider(types[n])).alias(n) for n in names]
    points = line.select("_key", "_at", F.lit(0).alias("_asks"), F.col("_at").alias("_for"), *names).unionByName(
        line.select("_key", (F.col("_at") - span).alias("_at"), F.lit(1).alias("_asks"), F.col("_at").alias("_for"), *nothing))
    slot = F.floor(F.col("_at") / F.lit(slot_seconds * 1_000_000)).cast("long")
    scanned = running(points, ["_key"], ["_at", "_asks", "_for"], slot, sums={f"_c{n}": F.coalesce(n, F.lit(0).cast(_wider(types[n]))) for n in names})
    sign = F.when(F.col("_asks") == 0, 1).otherwise(-1)
    framed = scanned.groupBy("_key", F.col("_for").alias("_at")).agg(*[F.sum(sign * F.col(f"_c{n}")).alias(k) for k, n in zip(sums, names)])
    joined = rows.withColumns({"_key": key, "_at": at}).join(framed, ["_key", "_at"], "left")
    return joined.drop("_key", "_at")


def _wider(kind: str) -> str:
    """A type that holds the sums of a column."""
    return f"decimal(38,{kind[kind.index(',') + 1:-1]})" if kind.startswith("decimal") else "long"
