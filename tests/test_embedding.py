"""The hook for a caller's embedding model."""

import sys

import pytest
from pyspark import cloudpickle

from signalbook.operators import embedding

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the test folder


class Picky:
    """Fails on texts with "bad", gives odd results for some others, and tells how many texts a call had."""

    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot read this")
        if any("wide" in t for t in texts):
            return [[1.0, 2.0, 3.0]] * len(texts)
        return [[float("inf") if t == "inf" else len(t), len(texts)] for t in texts]


def test_every_row_comes_back(spark):
    rows = [(i, t) for i, t in enumerate(["a", None, "bad one", "", "inf", "wide", "abc", "bad", "x" * 50_000])] + [(6, "abc")]
    df = spark.createDataFrame(rows, "row_id long, text string").coalesce(1)
    got = embedding.embed(df, Picky, "picky", 2, batch_rows=4).collect()
    assert len(got) == len(rows)
    by_id = {r.row_id: r for r in got}
    assert [by_id[i].embedding and by_id[i].embedding[0] for i in range(9)] == [1, None, None, 0, None, None, 3, None, 50_000]
    assert [bool(r.error) for _, r in sorted(by_id.items())] == [False, False, True, False, True, True, False, True, False]
    assert "cannot read" in by_id[2].error and "width" in by_id[5].error and by_id[4].error == "not finite"


def test_lists_are_bounded(spark):
    df = spark.createDataFrame([(i, "abcde") for i in range(100)], "row_id long, text string").coalesce(1)
    assert max(r.embedding[1] for r in embedding.embed(df, Picky, "picky", 2, batch_rows=7).collect()) == 7
    assert max(r.embedding[1] for r in embedding.embed(df, Picky, "picky", 2, batch_chars=20).collect()) == 4


def test_edges(spark):
    df = spark.createDataFrame([("k", "Ab"), ("k", "Ab")], "row_id string, text string")
    assert [tuple(r.embedding) for r in embedding.embed(df, lambda: embedding.LetterCounts(8), "l", 8).collect()] == [(0, 0.5, 0.5, 0, 0, 0, 0, 0)] * 2
    assert embedding.embed(df.filter("false"), Picky, "picky", 2).collect() == []
    with pytest.raises(ValueError):
        embedding.embed(df, Picky, "picky", 0)
