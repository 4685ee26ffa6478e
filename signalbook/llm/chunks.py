"""Cutting texts into chunks that a tokenizer treats independently, and a bounded memo over them.

A single space with a non-space character on either side always starts a new pre-token, whatever
surrounds it. Cutting there leaves short chunks that repeat all through a corpus, so what is known of
a chunk (its ids, its number of tokens, its likelihoods) is computed once per worker and looked up.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORKER = "_signalbook_worker"


def worker_cached(name: str, key, make: Callable[[], object]):
    """``make()``, kept for later tasks of the same Python worker while ``key`` stays the same.

    Only what can be made anew belongs here (tokenizers and their memos). One value is kept at a time.
    """
    held = sys.modules.setdefault(_WORKER, types.ModuleType(_WORKER)).__dict__
    if held.get("key") != (name, key):
        release_worker()
        held.update(value=make(), key=(name, key))
    return held["value"]


def release_worker() -> None:
    """Give back what earlier tasks have left in this Python worker."""
    held = sys.modules.setdefault(_WORKER, types.ModuleType(_WORKER)).__dict__
    held.pop("key", None)
    held.pop("value", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    # What is free inside the C heap stays with the process unless it is asked for; idle workers would keep it.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_CUT = re.compile(r"(?<=\S) (?=\S)")


class ChunkMemo:
    """Values of the chunks of a text.

    ``compute`` maps a list of chunk strings to their values (never None). ``limit`` bounds the number
    of remembered chunks: a full memo becomes the old one, from which chunks still in use move over, and
    the one before is dropped, so memory does not follow the corpus. Chunks longer than ``longest`` are
    computed each time.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 150_000, longest: int = 64):
        self._compute, self._limit, self._longest = compute, limit, longest
        self._led: dict = {}  # chunk without the space that leads it
        self._whole: dict = {}  # chunk as it stands
        self._old: dict = {"": {}, " ": {}}

    def __call__(self, text: str) -> list:
        """The values of all chunks of ``text``, in order."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[list]:
        """The same for several texts; their unknown chunks go to ``compute`` together."""
        rows, led, whole = [], {}, {}
        for text in texts:
            parts = text.split(" ")
            values = list(map(self._led.get, parts))
            values[0] = self._whole.get(parts[0])
            missing: list[int] = []
            wanted = led
            if None in values:
                missing = [i for i, v in enumerate(values) if v is None]
                if len(parts) > 1 and _touches_space([parts[i] for i in missing]):
                    # Runs of white space: cut only where a single space stands alone.
                    parts, wanted = cut(text), whole
                    values = list(map(self._whole.get, parts))
                    missing = [i for i, v in enumerate(values) if v is None]
                for i in missing:
                    (wanted if i else whole)[parts[i]] = None
            rows.append((values, parts, missing, wanted))
        for wanted, lead in ((led, " "), (whole, "")):
            if wanted:
                wanted.update(zip(keys := list(wanted), self._fill(keys, lead)))
        for values, parts, missing, wanted in rows:
            for i in missing:
                values[i] = (wanted if i else whole)[parts[i]]
        return [r[0] for r in rows]

    def distinct(self, keys: list[str], lead: str) -> list:
        """Values of chunks that all differ. With ``lead`` " " each begins with that space, which its key lacks."""
        values = list(map((self._led if lead else self._whole).get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            for i, v in zip(missing, self._fill([keys[i] for i in missing], lead)):
                values[i] = v
        return values

    def _fill(self, keys: list[str], lead: str) -> list:
        values = list(map(self._old[lead].get, keys))
        unknown = [i for i, v in enumerate(values) if v is None]
        if unknown:
            for i, v in zip(unknown, self._compute([lead + keys[i] for i in unknown])):
                values[i] = v
        memo = self._led if lead else self._whole
        if max(map(len, keys)) <= self._longest:
            memo.update(zip(keys, values))
        else:
            memo.update((k, v) for k, v in zip(keys, values) if len(k) <= self._longest)
        if len(memo) > self._limit:
            self._old[lead] = memo
            if lead:
                self._led = {}
            else:
                self._whole = {}
        return values


def _touches_space(parts: list[str]) -> bool:
    """True if one of the parts is empty, or begins or ends with white space."""
    return "" in parts or [p.strip() for p in parts] != parts


def cut(text: str) -> list[str]:
    """The chunks of a text; joined without anything between they are the text again."""
    parts = _CUT.split(text)
    return parts[:1] + [" " + p for p in parts[1:]]


def distinct_chunks(texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(first chunk of each text, all different later chunks without the space that leads them, places, starts, ends).

    The chunks of text i after its first are those at ``places[starts[i]:ends[i]]``. Texts are cut and chunks
    compared in Arrow, so Python meets a chunk once, however often it is repeated.
    """
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    parts, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    firsts = parts.take(pa.array(offsets[:-1])).to_pylist()
    later = np.ones(len(parts), bool)
    later[offsets[:-1]] = False
    rest = parts.filter(pa.array(later))
    starts, ends = offsets[:-1] - np.arange(len(texts)), offsets[1:] - np.arange(1, len(texts) + 1)
    coded = rest.dictionary_encode()
    keys, places = coded.dictionary, coded.indices.to_numpy()
    odd = {i for i, t in enumerate(firsts) if (not t or t[-1].isspace()) and starts[i] < ends[i]}
    spaced = pc.or_(pc.equal(keys, ""), pc.not_equal(keys, pc.utf8_trim_whitespace(keys))).to_numpy(zero_copy_only=False)
    if spaced.any():
        odd.update(np.searchsorted(ends, np.flatnonzero(spaced[places]), "right").tolist())
    if odd:
        # Runs of white space: cut only where a single space stands alone.
        plain, chunks, sizes = np.ones(len(rest), bool), [], ends - starts
        for i in odd:
            plain[starts[i] : ends[i]] = False
            sizes[i] = 0
        ends = np.cumsum(sizes)
        starts, kept = ends - sizes, int(plain.sum())
        for i in odd:
            firsts[i], *more = _CUT.split(texts[i])
            starts[i], ends[i] = kept + len(chunks), kept + len(chunks) + len(more)
            chunks += more
        coded = pa.concat_arrays([rest.filter(pa.array(plain)), pa.array(chunks, pa.string())]).dictionary_encode()
        keys, places = coded.dictionary, coded.indices.to_numpy()
    return firsts, keys, places, starts, ends


def strings(column: pa.Array) -> list[str]:
    """The same as ``to_pylist``, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Texts of a batch one after the other, null as the empty text."""
    for value in batch.column(column):
        yield value.as_py() or ""


def slices(batch: pa.RecordBatch, rows: int = 1000, chars: int = 8_000_000) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of a batch in runs bounded in rows and in characters, but for a single longer text."""
    ids, held, size = [], [], 0
    for doc, value in zip(batch.column("doc_id").to_pylist(), texts(batch)):
        if held and (len(held) >= rows or size + len(value) > chars):
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(doc)
        held.append(value)
        size += len(value)
    if held:
        yield ids, held
