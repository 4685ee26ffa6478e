"""A Python data source for tables of lines: splits by bytes when read, and appends that count once.

    spark.dataSource.register(LineTable)
    spark.read.format("lines").option("splitBytes", 1 << 25).load("/shared/chats")
    rows.write.format("lines").option("batch", "2024-05-01").mode("append").save("/shared/chats")

A table is a folder that driver and executors share (a mounted path). Reading gives file, position (in bytes), value and broken for every
non-blank line; a line belongs to the split it begins in, so a large file is read by many tasks. ``broken`` marks lines that are no JSON object, or no
UTF-8, so that they can be counted.

An append has a batch id. Each task stages a file and reports it to the driver, whose commit writes one entry that lists the files of the
batch; that entry, made in one step, is what makes them part of the table. Files of lost tasks, of failed appends and of a second
append under the same id are in no entry and are never read. Folders without entries are read file by file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ENTRIES = "_entries"
SPLIT_BYTES = 32 << 20
_READ = 1 << 20


def _folder(path: str) -> str:
    local = re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" in local:
        raise ValueError(f"{path}: a table of lines is a folder that all executors have mounted")
    return local


def committed_files(path: str) -> list[str]:
    """The data files of a table, in order of their names."""
    folder = _folder(path)
    if os.path.isfile(folder):
        return [folder]
    entries = os.path.join(folder, ENTRIES)
    if os.path.isdir(entries):
        names = []
        for entry in sorted(os.listdir(entries)):
            if entry.endswith(".json"):
                with open(os.path.join(entries, entry), encoding="utf-8") as f:
                    names += [x["file"] for x in json.load(f)["files"]]
    else:
        names = [n for n in os.listdir(folder) if n[0] not in "._" and os.path.isfile(os.path.join(folder, n))]
    return [os.path.join(folder, n) for n in sorted(names)]


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


def lines_of(file: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in [start, end), without their line ends; blank lines are left out."""
    with open(file, "rb", buffering=_READ) as f:
        at = start
        if start:
            f.seek(start - 1)
            at += len(f.readline()) - 1  # the rest of a line that began before
        while at < end:
            line = f.readline()
            if not line:
                return
            if line.strip():
                yield at, line.rstrip(b"\r\n")
            at += len(line)


def is_broken(line: bytes) -> bool:
    try:
        return not isinstance(json.loads(line.decode()), dict)
    except ValueError:  # of the encoding, too
        return True


class LineReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self._path, self._bytes = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        splits = []
        for file in committed_files(self._path):
            size = os.path.getsize(file)
            splits += [Split(file, at, min(at + self._bytes, size)) for at in range(0, size, self._bytes)]
        return splits or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        if partition.file:
            name = os.path.basename(partition.file)
            for at, line in lines_of(partition.file, partition.start, partition.end):
                yield name, at, line.decode(errors="replace"), is_broken(line)


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class LineWriter(DataSourceWriter):
    """``write`` runs in the tasks, ``commit`` and ``abort`` in the driver."""

    def __init__(self, path: str, batch: str):
        if not re.fullmatch(r"[\w.-]{1,100}", batch):
            raise ValueError("the option batch names the append: letters, digits, . _ -")
        self._folder, self._batch = _folder(path), batch

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        os.makedirs(self._folder, exist_ok=True)
        # Every attempt has a file of its own; only the one reported counts.
        name = f"part-{self._batch}-{part:05}-{uuid.uuid4().hex}.jsonl"
        rows = 0
        with open(os.path.join(self._folder, name), "wb") as f:
            for row in iterator:
                if row[0] is not None:
                    f.write(str(row[0]).replace("\n", " ").encode() + b"\n")
                    rows += 1
            f.flush()
            os.fsync(f.fileno())
        return Staged(name, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        entries = os.path.join(self._folder, ENTRIES)
        os.makedirs(entries, exist_ok=True)
        staged = [m for m in messages if m is not None]
        ready = os.path.join(entries, f".{self._batch}-{uuid.uuid4().hex}")
        with open(ready, "w", encoding="utf-8") as f:
            json.dump({"batch": self._batch, "files": [{"file": m.file, "rows": m.rows} for m in staged if m.rows]}, f)
            f.flush()
            os.fsync(f.fileno())
        try:  # a link is made as a whole or, if the batch is there, not at all
            os.link(ready, os.path.join(entries, f"{self._batch}.json"))
            unused = [m for m in staged if not m.rows]
        except FileExistsError:
            unused = staged
        self._drop([m.file for m in unused])
        os.unlink(ready)

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop([m.file for m in messages if m is not None])

    def _drop(self, names: list[str]) -> None:
        for name in names:
            path = os.path.join(self._folder, name)
            if os.path.exists(path):
                os.unlink(path)


class LineTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "file string, position long, value string, broken boolean"

    def reader(self, schema) -> LineReader:
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        if split < 1:
            raise ValueError("splitBytes is at least 1")
        return LineReader(self.options["path"], split)

    def writer(self, schema, overwrite: bool) -> LineWriter:
        if overwrite:
            raise ValueError("a table of lines is appended to only")
        return LineWriter(self.options["path"], self.options.get("batch", ""))


def read_line_table(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, position, value, broken of every line of a table. (file, position) orders the lines."""
    spark.dataSource.register(LineTable)
    return spark.read.format("lines").option("splitBytes", split_bytes).load(path)


def append_lines(lines: DataFrame, path: str, batch: str, value: str = "value") -> None:
    """Append the non-null lines under a batch id; a batch that is in the table already is left as it is."""
    lines.sparkSession.dataSource.register(LineTable)
    lines.select(value).write.format("lines").option("batch", batch).mode("append").save(path)


def bad_lines(table: DataFrame) -> DataFrame:
    """(file, lines, broken): counts per file."""
    from pyspark.sql import functions as F

    return table.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("broken").alias("broken"))
