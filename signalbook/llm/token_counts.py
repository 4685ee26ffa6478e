"""Exact token counts of every prefix of a text by dynamic programming.

For byte-pair encoding, the encoding of any prefix ends in exactly one token, and a row of tokens is an
encoding if and only if each two neighbours are: encoding the bytes of the two gives the two back. So
over the prefixes of a pre-token,

    last(p)  = the token t that ends at p and is compatible with last(p - |t|)
    count(p) = count(p - |t|) + 1

gives the exact count at every prefix in one pass over the pre-token, with an automaton that names the tokens that end at a place and
a test of two neighbours that follows their edges through the merges. Pre-tokens add up. A table of a text stores the counts at
all pre-token ends; a prefix that ends inside a pre-token is answered by the program over that one pre-token, and
the longest prefix for a budget by a search in the table and one pass over the next pre-token. The text is never encoded again.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.chunks import ChunkMemo, cut, slices, texts, worker_cached

COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_PAIRS, _PIECES = 500_000, 300_000
_NEVER = 1 << 30  # the rank of no merge


class PrefixCounter:
    """The dynamic program for the byte-level vocabulary of a tokenizers file."""

    def __init__(self, tokenizer_file: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            model = json.load(f)
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self._ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self._specials = [t["content"] for t in model["added_tokens"]]
        self._pre = Tokenizer.from_file(tokenizer_file).pre_tokenizer
        # Only tokens that encode to themselves can be in an encoding. ``_lefts`` and ``_rights``: the tokens that stand at either
        # edge while a token is made, each with the rank of the merge that takes it up.
        self._lefts: dict[str, list[tuple[str, int]]] = {}
        self._rights: dict[str, list[tuple[str, int]]] = {}
        split = {}
        for token in sorted(model["model"]["vocab"], key=len):
            if len(token) > 1 and (parts := self._last_merge(token)):
                split[token] = parts
            if len(token) == 1 or parts:
                self._lefts[token] = self._edge(token, split, 0)
                self._rights[token] = self._edge(token, split, 1)
        # One pass over a pre-token gives the tokens that end at each place, longest first.
        self._ending = ahocorasick.Automaton()
        for token in self._lefts:
            self._ending.add_word(token, token)
        self._ending.make_automaton()
        self._fits: dict = {}
        self._known: dict = {}  # counts of whole pre-tokens
        self._memo = ChunkMemo(self._chunks)

    def _merges(self, piece: str) -> Iterator[list[str]]:
        """The parts of a short string of byte symbols, merge by merge."""
        parts, ranks = list(piece), self._ranks
        yield parts
        while len(parts) > 1:
            best, at = min((ranks.get(p, _NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == _NEVER:
                return
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            yield parts

    def _last_merge(self, token: str) -> tuple[str, str] | None:
        """The two parts merged last, if the string is one token in the end."""
        steps = list(self._merges(token))
        return tuple(steps[-2]) if len(steps[-1]) == 1 else None

    def _edge(self, token: str, split: dict, side: int) -> list[tuple[str, int]]:
        path, taken = [], _NEVER
        while True:
            path.append((token, taken))
            if token not in split:
                return path[::-1]
            taken, token = self._ranks[split[token]], split[token][side]

    def _compatible(self, one: str, two: str) -> bool:
        """No merge ever joins the end of ``one`` with the start of ``two``: what stands at the two edges meets, in the order of
        the merges, only neighbours that merge elsewhere first (of equal merges the left one is first)."""
        rights, lefts, ranks = self._rights[one], self._lefts[two], self._ranks
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = rights[i], lefts[j]
            across = ranks.get((x, y), _NEVER)
            if across < x_taken and across <= y_taken and across != _NEVER:
                return False
            if x_taken == y_taken == _NEVER:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def prefixes(self, piece: str) -> list[int]:
        """Token counts of the prefixes of one pre-token (byte symbols), the empty one included."""
        fits, last, counts = self._fits, [""], [0]
        done = -1
        for end, token in self._ending.iter(piece):
            if end == done:
                continue
            start = end + 1 - len(token)
            if start:
                pair = (last[start], token)
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= _PAIRS:
                        fits.clear()
                    ok = fits[pair] = self._compatible(*pair)
                if not ok:
                    continue
            done = end
            last.append(token)
            counts.append(counts[start] + 1)
        return counts

    def chunk(self, chunk: str) -> int:
        """Tokens of a chunk; special strings count as one token each."""
        for special in self._specials:
            if special in chunk:
                parts = chunk.split(special)
                return len(parts) - 1 + sum(self.chunk(p) for p in parts if p)
        return sum(self._whole(piece) for piece, _ in self._pre.pre_tokenize_str(chunk))

    def _chunks(self, chunks: list[str]) -> list[int]:
        """The same for many chunks; those that begin with a space and go on without any are pre-tokenized as one text."""
        counts = [0] * len(chunks)
        together = "\n".join(chunks)
        special = any(s in together for s in self._specials)
        plain = []
        for i, c in enumerate(chunks):
            if c[:1] == " " and c.split() == [c[1:]] and not (special and any(s in c for s in self._specials)):
                plain.append(i)
            else:
                counts[i] = self.chunk(c)
        whole = self._whole
        for k in range(0, len(plain), 5000):
            run = plain[k : k + 5000]
            at, end = -1, 0
            for piece, (start, _) in self._pre.pre_tokenize_str("".join(map(chunks.__getitem__, run))):
                if start >= end:
                    at += 1
                    end += len(chunks[run[at]])
                counts[run[at]] += whole(piece)
        return counts

    def _whole(self, piece: str) -> int:
        if piece in self._lefts:
            return 1
        count = self._known.get(piece)
        if count is None:
            count = self.prefixes(piece)[-1]
            if len(piece) <= 64:
                if len(self._known) >= _PIECES:
                    self._known.clear()
                self._known[piece] = count
        return count

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        return [sum(v) if t else 0 for t, v in zip(texts, self._memo.many(texts))]

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Code-point offsets and the exact token counts up to them, from 0 on: the stored prefixes.

        There is one at the end of every pre-token but white space, since what follows never changes the pre-tokens up to there. Texts with special
        strings have them at the ends of their chunks.
        """
        ends, counts = [0], [0]
        if any(s in text for s in self._specials):
            chunks = cut(text)
            return [0, *accumulate(map(len, chunks))], [0, *accumulate(map(self.chunk, chunks))]
        total = 0
        for piece, (_, end) in self._pre.pre_tokenize_str(text) if text else ():
            total += self._whole(piece)
            if not text[end - 1].isspace():
                ends.append(end)
                counts.append(total)
        if ends[-1] < len(text):
            ends.append(len(text))
            counts.append(total)
        return ends, counts

    def tokens_at(self, text: str, table: tuple[list[int], list[int]], end: int) -> int:
        """Tokens of ``text[:end]``, exactly: a stored count, and the program for the part of the one pre-token behind it."""
        ends, counts = table
        k = bisect_right(ends, end) - 1
        return counts[k] + (self.chunk(text[ends[k] : end]) if end > ends[k] else 0)

    def _inside(self, part: str) -> list[int]:
        """Token counts of the prefixes of a part between two stored prefixes, the empty and the whole one included."""
        pieces = self._pre.pre_tokenize_str(part)
        first = len(part) - len(part.lstrip())
        word = part[first:]
        letters = "".join(p for p, _ in pieces)
        behind = pieces[-1][1][0] if pieces else 0
        one_gap = len(self._pre.pre_tokenize_str(part[:first])) <= 1  # some control characters are white space here and not there
        if any(s in part for s in self._specials) or behind > first or not one_gap or (word[:1] == "'" and len(word) > 1 and word[1].isalpha()) or len(letters) != len(part.encode()):
            return [0, *(self.chunk(part[:end]) for end in range(1, len(part) + 1))]
        at = [0, *accumulate(len(c.encode()) for c in part)]
        # Inside the white space all of it is one pre-token; behind it the last pre-token grows and the ones before stay.
        space = self.prefixes(letters[: at[first]])
        counts = [space[x] for x in at[: first + 1]]
        if word:
            last = pieces[-1][0]
            base, start = sum(self._whole(p) for p, _ in pieces[:-1]), len(letters) - len(last)
            grown = self.prefixes(last)
            counts += [base + grown[x - start] for x in at[first + 1 :]]
        return counts

    def longest_prefix(self, text: str, table: tuple[list[int], list[int]], budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        ends, counts = table
        k = bisect_right(counts, budget) - 1
        if k == len(ends) - 1:
            return ends[k]
        inside = self._inside(text[ends[k] : ends[k + 1]])
        return ends[k] + max(n for n, c in enumerate(inside) if counts[k] + c <= budget)


def token_counts(
    docs: DataFrame, tokenizer_file: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give a row each; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cached("counts", tokenizer_file, lambda: PrefixCounter(tokenizer_file))
        for batch in batches:
            for ids, values in slices(batch):
                counts = counter.counts(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(v.encode()) for v in values], pa.int64()),
                     pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, COUNT_SCHEMA)


def prefix_tables(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ends, counts: the stored table of every text (``PrefixCounter.table``).

    Null and empty texts have the one entry (0, 0).
    """

    def run(batches):
        counter = worker_cached("counts", tokenizer_file, lambda: PrefixCounter(tokenizer_file))
        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ends, counts = counter.table(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
                    names=["doc_id", "ends", "counts"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ends array<long>, counts array<long>")


def truncate(
    docs: DataFrame, tokenizer_file: str, budget: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_chars, n_tokens of the longest prefix of each text within ``budget`` tokens."""

    def run(batches):
        counter = worker_cached("counts", tokenizer_file, lambda: PrefixCounter(tokenizer_file))
        for batch in batches:
            chars, tokens = [], []
            for value in texts(batch):
                table = counter.table(value)
                chars.append(counter.longest_prefix(value, table, budget))
                tokens.append(counter.tokens_at(value, table, chars[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_chars long, n_tokens long")
