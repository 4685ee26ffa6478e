"""SentencePiece models on the tokenizers library: encoding, decoding and a parity check.

The model file (a protobuf) is read field by field; from it are rebuilt the normaliser (character map,
white-space rules, dummy prefix), the metaspace marker, the pieces with their scores (unigram scores, or
merges ranked by the score of the merged piece) and byte fallback. Texts are cut into chunks where no
piece can reach across, unknown chunks are encoded in multithreaded batches, and each distinct chunk is
compared with the sentencepiece library and decoded again.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.chunks import ChunkMemo, slices, worker_cached

MARK = "▁"
# Kinds of pieces and models, as the format numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]  # text, score, kind
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    strip_spaces: bool


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""),
                 bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def build_tokenizer(model: Model):
    """The tokenizers equivalent of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    texts = [p[0] for p in model.pieces]
    unknown = next(i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN)
    if model.kind == BPE:
        vocab = {p: i for i, p in enumerate(texts)}
        usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [
            (-score, vocab[p[:k]], vocab[p[k:]])
            for p, score in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable
        ]
        core = models.BPE(
            vocab=vocab, merges=[(texts[a], texts[b]) for _, a, b in sorted(merges)], unk_token=texts[unknown],
            fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        # Control pieces never come from a text: a name that no text has keeps their ids in place.
        named = [f"\U0010fffe{i}" if kind in (CONTROL, UNUSED) else p for i, (p, _, kind) in enumerate(model.pieces)]
        core = models.Unigram([(n, p[1]) for n, p in zip(named, model.pieces)], unknown, model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


class Codec:
    """Encoding of texts with a verdict on parity and on the round trip."""

    def __init__(self, model_file: str, verify: bool = True):
        model = read_model(model_file)
        self._tokenizer = build_tokenizer(model)
        self._plain = {i: p.replace(MARK, " ") for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
        self._dummy = model.dummy_prefix
        self._reference = None
        if verify:
            from sentencepiece import SentencePieceProcessor

            self._reference = SentencePieceProcessor(model_file=model_file)
        # Chunks are independent if a marker only ever begins a piece and spaces are kept as they are.
        self._cuts = model.dummy_prefix and not model.strip_spaces and not model.charsmap and not any(
            MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL)
        # Text is given back as it was unless the normaliser changes it.
        self._lossless = not model.charsmap and not model.strip_spaces
        self._memo = ChunkMemo(lambda chunks: self._encode([c[1:] if c[:1] == " " else c for c in chunks]))

    def _encode(self, bodies: list[str]) -> list[tuple[bytes, bool, bool]]:
        found = self._tokenizer.encode_batch_fast(bodies, add_special_tokens=False)
        ids = [e.ids if b else [] for b, e in zip(bodies, found)]
        back = self._decoded(ids)
        expected = self._reference.encode(bodies, num_threads=4) if self._reference else ids
        joined = array("I", chain.from_iterable(ids))
        if sys.byteorder != "little":
            joined.byteswap()
        data, ends = joined.tobytes(), [4 * n for n in accumulate(map(len, ids), initial=0)]
        return [
            (data[at:end], i == e, not self._lossless or r == b.replace(MARK, " "))
            for at, end, i, e, r, b in zip(ends, ends[1:], ids, expected, back, bodies)
        ]

    def _decoded(self, ids: list[list[int]]) -> list[str]:
        """What the decoder makes of the ids. Rows of plain pieces are their texts one after the other, with spaces for
        markers, less the space of the dummy prefix; only rows with other ids (bytes, unknown) need the decoder itself."""
        get, out, other = self._plain.get, [], []
        for k, row in enumerate(ids):
            try:
                text = "".join(map(get, row))
            except TypeError:  # an id without a text
                other.append(k)
                text = ""
            out.append(text[1:] if self._dummy and text[:1] == " " else text)
        for k, text in zip(other, self._tokenizer.decode_batch([ids[k] for k in other], skip_special_tokens=False)):
            out[k] = text
        return out

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(ids as little-endian unsigned 32-bit integers, parity, round trip) per text."""
        whole = [i for i, t in enumerate(texts) if t and (not self._cuts or MARK in t or t[0] == " ")]
        out: list = [(b"", True, True)] * len(texts)
        for i, value in zip(whole, self._encode([texts[i] for i in whole]) if whole else []):
            out[i] = value
        rest = sorted(set(range(len(texts))) - set(whole))
        for i, values in zip(rest, self._memo.many([texts[i] for i in rest])):
            if texts[i]:
                out[i] = b"".join(v[0] for v in values), all(v[1] for v in values), all(v[2] for v in values)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._tokenizer.decode_batch(ids, skip_special_tokens=True)


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", verify: bool = False) -> DataFrame:
    """doc_id, ids array<int>, parity, round_trip. Null and empty texts have no ids.

    Repeated rows give a row each; other columns are not read. ``parity`` and ``round_trip`` are true
    without ``verify`` as far as they are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cached("codec", (model_file, verify), lambda: Codec(model_file, verify))
        for batch in batches:
            for docs_, values in slices(batch):
                found = codec(values)
                ids = [list(struct.unpack(f"<{len(f[0]) // 4}I", f[0])) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.bool_()),
                     pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "ids", "parity", "round_trip"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, parity boolean, round_trip boolean")


def decode(rows: DataFrame, model_file: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of rows of ids; null and empty lists are the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file, verify=False)
        for batch in batches:
            texts = codec.decode([i or [] for i in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(
        run, "doc_id long, text string")


def codec_report(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, parity, round_trip of every whole text, without moving the ids.

    ``parity``: the ids are those of the sentencepiece library. ``round_trip``: decoding gives the text
    (the marker character as a space, as the library does). Null and empty texts: 0 pieces, both true.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cached("codec", (model_file, True), lambda: Codec(model_file))
        for batch in batches:
            for docs_, values in slices(batch):
                found = codec(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array([len(f[0]) // 4 for f in found], pa.int64()),
                     pa.array([zlib.crc32(f[0]) for f in found], pa.int64()), pa.array([f[1] for f in found], pa.bool_()),
                     pa.array([f[2] for f in found], pa.bool_())],
                    names=["doc_id", "n_pieces", "ids_crc32", "parity", "round_trip"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, parity boolean, round_trip boolean")
