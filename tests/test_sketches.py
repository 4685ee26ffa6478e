"""Mergeable quantiles: error bounds, exact small groups, states of a stream."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import files_stream

from signalbook.operators import sketches
from signalbook.streaming import jobs


def off(values, got, share):
    """How far the rank of ``got`` is from ``share``, as a share of the values."""
    low, high = sum(v < got for v in values) / len(values), sum(v <= got for v in values) / len(values)
    return max(0.0, low - share, share - high)


@pytest.mark.parametrize("size", [50, 400])
def test_merged_states_keep_the_error(spark, size):
    rng = random.Random(size)
    rows = [("hot" if rng.random() < 0.8 else "b", i % 40, float(rng.choice([rng.gauss(0, 1), rng.randrange(9)]) + (i > 15000))) for i in range(20_000)]
    rows += [("small", i, float(i)) for i in range(30)] + [("none", 1, None), ("none", 2, float("nan")), (None, 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, day int, v double").repartition(8)
    merged = sketches.merge_states(sketches.quantile_states(df, "v", ["k", "day"], size), ["k"], size)
    shares = {"low": 0.01, "median": 0.5, "high": 0.99}
    found = {r.k: r for r in sketches.quantiles(merged, shares, size).collect()}
    assert set(found) == {"hot", "b", "small", None} and found[None].median == 3.0
    for key, r in found.items():
        values = [v for k, _, v in rows if k == key and v is not None and v == v]
        assert (r.n, r.least, r.most) == (len(values), min(values), max(values))
        for name, share in shares.items():
            bound = 0 if len(values) < size else 3 * sketches.rank_error(size)  # three times the 99 % bound
            assert off(values, r[name], share) <= bound + 1 / len(values)
        assert r.rank_error == (0 if len(values) < size else sketches.rank_error(size))


def test_stored_states_of_a_stream(spark, tmp_path):
    """States of closed hours, stored by the stream, merge to what a batch over the same rows gives."""
    rows = [(f"2024-01-01 {h:02}:{m:02}:00", "a", float(h * 60 + m)) for h in range(4) for m in range(0, 60, 5)]
    batches = [rows[:24], rows[24:], [("2024-01-03 00:00:00", "a", 0.0)], [("2024-01-01 00:01:00", "a", 9.0)]]
    s = files_stream(spark, tmp_path, "ts timestamp, cell_id string, value double", batches)
    stored = jobs.run_available(sketches.quantile_stream(s, "value", ["cell_id"], "ts"))
    assert stored.count() == 4
    r = sketches.quantiles(sketches.merge_states(stored, ["cell_id"]), {"median": 0.5}).first()
    assert (r.n, r.least, r.most, r.rank_error) == (48, 0.0, 235.0, 0.0) and r["median"] in (115.0, 120.0)


def test_wrong_arguments(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        sketches.quantile_states(df, "v", [], 3)
    with pytest.raises(ValueError):
        sketches.quantiles(sketches.quantile_states(df, "v", []), {"x": 1.5})
    assert sketches.quantile_states(df.filter(F.lit(False)), "v", ["v"]).collect() == []
