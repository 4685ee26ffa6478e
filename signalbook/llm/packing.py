"""Harmonic packing of tokenized documents into sequences of bounded length.

Every document is cut into full sequences and a tail; the tail is cut further into halves, quarters and
so on of the capacity while at least ``smallest`` ids are left. A piece of length n belongs to class
k = capacity // n (its length lies in (capacity / (k + 1), capacity / k]), and a bin of class k takes
exactly k pieces, so a bin never overflows and pieces need not be compared with one another. Each task
fills its bins on its own: there is no shuffle, and what an executor lost is recomputed from its input
split. The bins of a task still open at its end are laid end to end and cut at the capacity; what is
left after the last full sequence is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.chunks import ChunkMemo, distinct_chunks, slices, strings, worker_cached

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ROWS = 20_000
_ENCODED = 8192  # chunks encoded at once
_JOINED = 32  # of them in one string
_SLICE = 250  # texts whose chunks are made distinct together
_MARKS = ".,;:!?"


def _split(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, ends = ids.tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class IdEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, from a tokenizers file."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        from tokenizers import Tokenizer, decoders, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._memo = ChunkMemo(self._encode, 250_000)
        # Bytes that an id stands for. Byte-level tokens have a character for each byte, added ones stand as they are.
        self._bytes = None
        if isinstance(self._tokenizer.decoder, decoders.ByteLevel) and self._tokenizer.normalizer is None:
            vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
            self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self._bytes[i] = len(token)
            for i, token in self._tokenizer.get_added_tokens_decoder().items():
                self._bytes[i] = len(token.content.encode())
        # Byte-level pre-tokens end between a letter and a mark; not so if an added token may lie across.
        start, added = self._tokenizer.pre_tokenizer, self._tokenizer.get_added_tokens_decoder().values()
        self._cuts_marks = self._bytes is not None and isinstance(start, pre_tokenizers.ByteLevel) and start.use_regex
        self._cuts_marks &= not any(mark in token.content for mark in _MARKS for token in added)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        # A part at a time: the library's result objects are a hundred times as large as the ids.
        return [ids for k in range(0, len(chunks), _ENCODED) for ids in self._part(chunks[k : k + _ENCODED])]

    def _part(self, chunks: list[str]) -> list[bytes]:
        # A space between other characters starts a pre-token, so chunks that begin with one may follow one another.
        fit = [len(c) > 1 and c[0] == " " and c.strip() == c[1:] for c in chunks]
        if self._bytes is None or not any(fit):
            return self._apart(chunks)
        if all(fit):
            return self._together(chunks)
        together = iter(self._together([c for c, f in zip(chunks, fit) if f]))
        apart = iter(self._apart([c for c, f in zip(chunks, fit) if not f]))
        return [next(together if f else apart) for f in fit]

    def _together(self, chunks: list[str]) -> list[bytes]:
        ids, _ = self._ids(["".join(chunks[k : k + _JOINED]) for k in range(0, len(chunks), _JOINED)])
        wanted = np.cumsum([0, *map(len, map(str.encode, chunks))])
        reached = np.concatenate([[0], np.cumsum(self._bytes[ids])])
        ends = np.searchsorted(reached, wanted)
        if reached[-1] != wanted[-1] or (reached[ends] != wanted).any():
            return self._apart(chunks)  # a token over the end of a chunk
        return _split(ids, ends)

    def _apart(self, chunks: list[str]) -> list[bytes]:
        ids, sizes = self._ids(chunks)
        return _split(ids, np.cumsum([0, *sizes]))

    def _ids(self, strings: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of the strings in a row, and how many each has."""
        lists = [e.ids for e in self._tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        sizes = list(map(len, lists))
        return np.fromiter(chain.from_iterable(lists), "<u4", sum(sizes)), sizes

    def _later(self, keys: pa.Array) -> list[bytes]:
        """Ids of different chunks that follow a space, which the keys lack."""
        if not self._cuts_marks:
            return self._memo.distinct(strings(keys), " ")
        # Words are remembered without the marks after them. Letters to U+024F are letters to any tokenizer.
        bare = pc.utf8_rtrim(keys, _MARKS)
        last = pc.utf8_slice_codeunits(bare, -1)
        marked = pc.and_(pc.and_(pc.utf8_is_alpha(last), pc.less_equal(last, "\u024f")), pc.not_equal(bare, keys))
        words = pc.if_else(marked, bare, keys).dictionary_encode()
        values = self._memo.distinct(strings(words.dictionary), " ")
        values = list(map(values.__getitem__, words.indices.to_numpy().tolist()))
        marks = [key[len(word) :] for key, word in zip(strings(keys.filter(marked)), strings(bare.filter(marked)))]
        ids = self._whole(marks)
        for i, mark in zip(pc.indices_nonzero(marked).to_numpy().tolist(), marks):
            values[i] += ids[mark]
        return values

    def _whole(self, chunks: list[str]) -> dict[str, bytes]:
        different = list(dict.fromkeys(chunks))
        return dict(zip(different, self._memo.distinct(different, "")))

    def __call__(self, texts: list[str]) -> list[bytes]:
        firsts, keys, places, starts, ends = distinct_chunks(texts)
        first, later = self._whole(firsts), self._later(keys).__getitem__
        spans = zip(firsts, starts.tolist(), ends.tolist())
        return [b"".join([first[t], *map(later, places[a:b].tolist())]) for t, a, b in spans]


def piece_lengths(total: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    lengths = [capacity] * (total // capacity)
    rest, size = total % capacity, capacity // 2
    while rest and size >= smallest:
        if rest == size or rest >= size + smallest:  # no piece shorter than ``smallest`` is left behind
            lengths.append(size)
            rest -= size
        size //= 2
    return lengths + [rest] * (rest > 0)


class HarmonicBins:
    """Open bins of one task. Pieces are (doc_id, start, length, payload)."""

    def __init__(self, capacity: int):
        self._capacity, self._open = capacity, {}

    def add(self, piece: tuple) -> list[tuple] | None:
        """The bin that ``piece`` completes, if it does."""
        k = self._capacity // piece[2]
        if k == 1:
            return [piece]
        members = self._open.setdefault(k, [])
        members.append(piece)
        return self._open.pop(k) if len(members) == k else None

    def rest(self) -> Iterator[list[tuple]]:
        """Sequences of the pieces in open bins: full ones, then powers of two."""
        left = [p for k in sorted(self._open) for p in self._open[k]]
        self._open = {}
        total = sum(p[2] for p in left)
        sizes = [self._capacity] * (total // self._capacity)
        sizes += [1 << b for b in reversed(range(self._capacity.bit_length())) if (total % self._capacity) >> b & 1]
        at, used = 0, 0  # piece, and how much of it is dealt out
        for size in sizes:
            members = []
            while size:
                doc, start, length, data = left[at]
                take = min(size, length - used)
                members.append((doc, start + used, take, data[4 * used : 4 * (used + take)]))
                size, used = size - take, used + take
                if used == length:
                    at, used = at + 1, 0
            yield members


def pack(
    docs: DataFrame, tokenizer_file: str, capacity: int = 1024, smallest: int = 64, end_id: int = 0,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and ``end_id`` after them; null and empty texts are that one id.
    Repeated rows are packed each. Columns other than the two named are not read. A sequence holds at
    most ``capacity`` ids and offsets in it have no gaps. ``capacity`` is a power of two. Sequence ids
    are unique: the number of the partition in the upper bits, a running number below.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cached("ids", tokenizer_file, lambda: IdEncoder(tokenizer_file))
        bins = HarmonicBins(capacity)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=list(names))

        def close(members: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (doc, total), start, length, data in members:
                rows.append((doc, start, length, zlib.crc32(data), total, sequence, offset))
                offset += length
            sequence += 1

        for batch in batches:
            for docs_, values in slices(batch, _SLICE):
                for doc, ids in zip(docs_, encode(values)):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length in piece_lengths(total, capacity, smallest):
                        full = bins.add(((doc, total), start, length, ids[4 * start : 4 * (start + length)]))
                        start += length
                        if full:
                            close(full)
                if len(rows) >= _ROWS:
                    yield flush()
        for members in bins.rest():
            close(members)
        yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
