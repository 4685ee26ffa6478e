"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as a whole, every turn as

    <|turn|>role<|text|>text<|end|>

with control strings inside roles and texts escaped, and encoded once with offsets. The markers are special
tokens of their own, so no other token reaches over the border of a turn's text. The sorted spans of the turns to learn are
intersected with the sorted spans of the tokens by binary search, which gives the masked tokens.

Turns are sorted and streamed, never collected. Rendering and encoding are dealt out by conversation
and run of turns, so a conversation with a very large share of all turns is worked on by many tasks; such
conversations are rendered in parts of a bounded size that end with a turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's markers.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

RENDERED = (
    "conv_id long, bucket long, part long, n_turns long, formatted string, ids array<int>, "
    "loss array<struct<first: long, last: long, start: long, end: long>>")


def escape(text: str) -> str:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no marker is left in the text."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def chat_tokenizer(tokenizer_file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.add_special_tokens([TURN, TEXT, END])
    return tokenizer


def masked(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> list[dict]:
    """Tokens [first, last) and characters [start, end) under the mask for each span of characters."""
    if not offsets:
        return []
    starts, ends = np.array(offsets, np.int64).T
    spans_ = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(ends, spans_[:, 0], "right")
    last = np.searchsorted(starts, spans_[:, 1], "left")
    return [
        {"first": int(a), "last": int(b), "start": int(starts[a]), "end": int(ends[b - 1])}
        for a, b in zip(first, last) if a < b
    ]


def render(
    turns: DataFrame, tokenizer_file: str, learn: tuple[str, ...] = ("assistant",), run_of_turns: int = 256, part_chars: int = 1 << 20,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Formatted conversations: conv_id, bucket, part (their order), n_turns, formatted, ids, loss spans.

    Turns are ordered by ``turn``, nulls first, ties by role and text; null roles and texts are empty. Repeated
    rows are turns of their own. A conversation of at most ``run_of_turns`` turns, numbered within one such run,
    and ``part_chars`` characters is one row. The text of roles in ``learn`` is under the loss mask. Rows without a
    conversation id form one conversation. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("bucket", F.floor(F.col("turn") / run_of_turns).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(tokenizer_file)
        key, part, pieces, spans, size, count = None, 0, [], [], 0, 0

        def close() -> pa.RecordBatch:
            formatted = "".join(pieces)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            loss = masked(spans, encoded.offsets)
            span = pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([part], pa.int64()), pa.array([count], pa.int64()),
                 pa.array([formatted], pa.string()), pa.array([encoded.ids], pa.list_(pa.int32())), pa.array([loss], pa.list_(span))],
                names=["conv_id", "bucket", "part", "n_turns", "formatted", "ids", "loss"])

        for batch in batches:
            for conv, bucket, role_, text_ in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "bucket", "role", "text"))):
                if (conv, bucket) != key or size > part_chars:
                    if pieces:
                        yield close()
                    part = part + 1 if (conv, bucket) == key else 0
                    key, pieces, spans, size, count = (conv, bucket), [], [], 0, 0
                head, body = TURN + escape(role_) + TEXT, escape(text_)
                if role_ in learn and body:
                    spans.append((size + len(head), size + len(head) + len(body)))
                pieces += [head, body, END]
                size += len(head) + len(body) + len(END)
                count += 1
        if pieces:
            yield close()

    return rows.repartition("conv_id", "bucket").sortWithinPartitions("conv_id", "bucket", "turn", "role", "text").mapInArrow(run, RENDERED)


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted parts and their masks: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Digests run along the sorted parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, out = None, []

        def close() -> None:
            if state:
                out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names=names)
            out.clear()
            return made

        for batch in batches:
            for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if state is None or conv != state[0]:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            yield batch_of()
        close()
        yield batch_of()

    return (
        rendered.select("conv_id", "bucket", "part", "formatted", "loss").repartition("conv_id")
        .sortWithinPartitions("conv_id", "bucket", "part")
        .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
