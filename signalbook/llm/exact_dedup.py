"""Exact duplicates by compressed radix (Patricia) tries.

Rows are grouped in two levels. Inside each batch of an input split a trie finds the first row of every text, so
of a group of copies at most one text per batch moves. These texts are dealt out by length and content
hash and sorted; each task inserts them into a trie, whose terminal nodes keep the smallest identifier and
the number of copies. Keys are the length, the hash and the full byte string, so different texts part within
the first bytes and equal ones are compared in full. Because keys arrive in order, all subtrees beside the
path of the current key are complete: they are written out and freed whenever the trie is over its budget.
What returns to the rows is one (local first row, owner, size) per batch and text; the join back is on the
local first row, whose rows are those of one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = b" \t\n\x0b\x0c\r"


def normalized(text: str) -> bytes:
    """UTF-8 of the text with each run of ASCII white space replaced by one space."""
    data = text.encode()
    words = data.split()  # bytes.split knows exactly these six characters
    if not words:
        return b" " if data else b""
    return (b" " if data[0] in _SPACE else b"") + b" ".join(words) + (b" " if data[-1] in _SPACE else b"")


class Trie:
    """A radix trie over byte strings. Nodes are lists: label, children by first byte, value or None."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes, value, merge) -> None:
        """Store ``value`` at ``key``, or ``merge(old, value)`` if the key is there."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = value if node[2] is None else merge(node[2], value)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                self.bytes += len(key) - at + 200
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            # split the edge
            node[1][key[at]] = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            self.bytes += 200
            node, at = node[1][key[at]], at + same

    def values(self, node: list | None = None) -> Iterator:
        """Values in key order, of the trie or of a subtree."""
        stack = [node or self.root]
        while stack:
            label, children, value = stack.pop()
            if value is not None:
                yield value
            stack.extend(children[b] for b in sorted(children, reverse=True))

    def complete(self, key: bytes, ordered: int) -> Iterator:
        """Remove the subtrees beside the path of the first ``ordered`` bytes of ``key`` and give their values."""
        node, at = self.root, 0
        while at < ordered:
            for first in [b for b in node[1] if b != key[at]]:
                yield from self.values(node[1].pop(first))
            child = node[1].get(key[at])
            if child is None or not key.startswith(child[0], at):
                break
            node, at = child, at + len(child[0])
        self.bytes = 0


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _key(length: int, digest: bytes, data: bytes) -> bytes:
    """Length, eight bytes of the hash, text: the order in which rows arrive, for the first 16 bytes."""
    return length.to_bytes(8, "big") + digest[:8] + data


_NO_ID = (1 << 63) - 1  # stands for a null identifier, behind all others


def _local(with_text: bool):
    """Every row with the first row of its text in this batch, or the first rows with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie, rows = Trie(), []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = normalized(value.as_py() or "")
                digest = hashlib.sha256(data).digest()
                found: list = []
                owner = [_NO_ID, 0, digest, data]  # smallest id, copies
                trie.insert(_key(len(data), digest, data), owner, lambda old, new: found.append(old) or old)
                owner = found[0] if found else owner
                owner[0] = min(owner[0], _NO_ID if doc is None else doc)
                owner[1] += 1
                rows.append((doc, owner))
            if with_text:
                owners = list(trie.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in owners], pa.int64()), pa.array([len(o[3]) for o in owners], pa.int64()),
                     pa.array([o[2][:8] for o in owners], pa.binary()), pa.array([o[1] for o in owners], pa.int64()),
                     pa.array([o[3] for o in owners], pa.binary())], names=["local_id", "length", "hash", "n", "data"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in rows], pa.int64()), pa.array([o[0] for _, o in rows], pa.int64()),
                     pa.array([o[2][:8] for _, o in rows], pa.binary()), pa.array([o[2].hex() for _, o in rows], pa.string())],
                    names=["doc_id", "local_id", "hash", "text_sha256"])

    return run


def _owners(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def merge(old, new):
            return min(old[0], new[0]), old[1] + new[1], old[2] | new[2], old[3]

        def rows(values) -> pa.RecordBatch:
            found = [(local, owner, size, digest) for owner, size, locals_, digest in values for local in locals_]
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in range(3)] + [pa.array([f[3] for f in found], pa.binary())],
                names=["local_id", "keep_id", "group_size", "hash"])

        for batch in batches:
            for local, length, digest, n, data in zip(*(batch.column(c).to_pylist() for c in ("local_id", "length", "hash", "n", "data"))):
                key = _key(length, digest, data)
                if trie.bytes > budget:
                    yield rows(list(trie.complete(key, 16)))
                trie.insert(key, (local, n, frozenset([local]), digest), merge)
        yield rows(list(trie.values()))

    return run


def exact_owners(docs: DataFrame, budget: int = 32 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space is replaced by one space;
    null is the empty text. ``keep_id`` is the smallest id of the group; rows without an id count but never
    stay before others. Rows that repeat both id and text are each marked as kept. Other columns are not
    read. ``budget``: bytes a task's trie may hold before complete subtrees are written out. The input is read
    twice in the same splits: give a table, or write a derived frame first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = rows.mapInArrow(_local(False), "doc_id long, local_id long, hash binary, text_sha256 string")
    firsts = rows.mapInArrow(_local(True), "local_id long, length long, hash binary, n long, data binary")
    owners = (
        firsts.repartition("length", "hash").sortWithinPartitions("length", "hash")
        .mapInArrow(_owners(budget), "local_id long, keep_id long, group_size long, hash binary")
    )
    return members.join(owners, ["local_id", "hash"]).select(
        "doc_id", F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")).alias("keep_id"), "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
