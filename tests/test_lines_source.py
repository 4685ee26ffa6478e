"""Tables of lines: splits, broken lines, and appends that count once whatever fails."""

import os

import pytest
from pyspark.sql import functions as F

from signalbook.sources import lines_source as ls

LINES = ['{"a": 1}', "  ", "", '{"b": "é日本🙂"}', "[1]", "{broken", '"text"', '{"c": 2}\r', "x" * 300]


def table_of(spark, path, split=1 << 20):
    return sorted(tuple(r) for r in ls.read_line_table(spark, path, split).collect())


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_splits_hold_every_line_once(spark, tmp_path, split):
    data = "\n".join(LINES).encode() + b"\n\xff\xfe{}\n{}"
    (tmp_path / "x.jsonl").write_bytes(data)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    got = table_of(spark, str(tmp_path), split)
    want, at = [], 0
    for line in data.split(b"\n"):
        if line.strip():
            want.append(("x.jsonl", at, line.rstrip(b"\r").decode(errors="replace"), ls.is_broken(line)))
        at += len(line) + 1
    assert got == sorted(want)
    assert sum(r[3] for r in got) == 5
    counted = ls.bad_lines(ls.read_line_table(spark, f"file://{tmp_path}/x.jsonl", split)).collect()
    assert [tuple(r) for r in counted] == [("x.jsonl", len(want), 5)]


def test_a_batch_counts_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(50).select(F.format_string('{"id": %d}', "id").alias("value")).repartition(4)
    ls.append_lines(rows, path, "one")
    ls.append_lines(rows, path, "one")
    ls.append_lines(rows.filter("value like '%1%'").union(spark.createDataFrame([(None,)], "value string")), path, "two")
    assert sorted(r[2] for r in table_of(spark, path, 100)) == sorted([f'{{"id": {i}}}' for i in range(50)] + [f'{{"id": {i}}}' for i in range(50) if "1" in str(i)])
    assert sorted(n for n in os.listdir(path) if n != ls.ENTRIES) == sorted(os.path.basename(f) for f in ls.committed_files(path))


def test_lost_tasks_and_failed_appends_are_never_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    writer = ls.LineWriter(path, "b")
    lost = writer.write(iter([("{}",), ("{}",)]))  # an attempt whose report never arrived
    kept = writer.write(iter([("{}",), ("{}",)]))
    with pytest.raises(RuntimeError):
        writer.write(("{}",) if i < 1 else _fail() for i in range(2))
    assert lost.file != kept.file and table_of(spark, path) != []  # no entry yet: a plain folder
    writer.commit([kept, None])
    assert len(table_of(spark, path)) == 2
    again = ls.LineWriter(path, "b")
    message = again.write(iter([("{}",)] * 5))
    again.commit([message])  # as after a driver that died behind its commit
    assert len(table_of(spark, path)) == 2 and not os.path.exists(f"{path}/{message.file}")
    third = ls.LineWriter(path, "c")
    staged = third.write(iter([("{}",)]))
    third.abort([staged, None])
    assert len(table_of(spark, path)) == 2 and not os.path.exists(f"{path}/{staged.file}")


def _fail():
    raise RuntimeError("lost")


def test_a_failing_job_appends_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    good = spark.range(10).select(F.format_string('{"id": %d}', "id").alias("value")).repartition(3)
    ls.append_lines(good, path, "a")
    bad = good.withColumn("value", F.when(F.col("value") == '{"id": 7}', F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        ls.append_lines(bad, path, "b")
    assert len(table_of(spark, path)) == 10
    ls.append_lines(good, path, "b")
    assert len(table_of(spark, path)) == 20


def test_wrong_arguments(spark, tmp_path):
    rows = spark.createDataFrame([("{}",)], "value string")
    for batch in ("", "a/b", ".." + "/" * 3):
        with pytest.raises(Exception):
            ls.append_lines(rows, f"{tmp_path}/t", batch)
    with pytest.raises(Exception):
        rows.write.format("lines").option("batch", "x").mode("overwrite").save(f"{tmp_path}/t")
    with pytest.raises(ValueError):
        ls.committed_files("s3://bucket/t")
    (tmp_path / "none").mkdir()
    assert ls.read_line_table(spark, str(tmp_path / "none")).collect() == []
