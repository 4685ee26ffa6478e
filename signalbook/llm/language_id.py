"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The likelihood of a word is
the sum over all its segmentations into pieces, computed by the forward recursion

    a(0) = 1,   a(e) = sum over pieces x[s:e] of a(s) * p(x[s:e])

for all languages at once; that of a text is the product over its words. Pieces and words may be of any
length: a trie over the pieces finds those at every letter, and the recursion is rescaled along long words.
Words repeat, so each distinct chunk is scored once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.llm.chunks import ChunkMemo, slices, worker_cached
from signalbook.llm.sentencepiece_codec import MARK, NORMAL, read_model

UNDETERMINED = "und"
_RUN = re.compile(r"[^\W\d_]+")
# Letters of a word up to which products of probabilities stay within double precision, and the letters between two
# rescalings behind them.
_SAFE, _RESCALE = 24, 8
_PART = 32_000  # letters scored together, for up to eight languages
_UNSEEN = 1e-7  # probability of a character outside the vocabulary, in every language


def words_of(chunk: str) -> list[str]:
    """Runs of letters in lower case behind a word marker."""
    return [MARK + run for run in _RUN.findall(chunk.lower())]


def vocabulary(model_file: str) -> list[str]:
    """Lower-case letter pieces of a piece model, with or without the word marker in front."""
    pieces = {p.lower() for p, _, kind in read_model(model_file).pieces if kind == NORMAL}
    return sorted(p for p in pieces if p == MARK or _RUN.fullmatch(p.removeprefix(MARK)))


class Forward:
    """Piece probabilities of several languages and the recursion over them."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        """``probabilities``: one row per piece, one column per language."""
        self.longest = max(map(len, pieces), default=1)
        # A trie: node and next letter lead to a node; nodes that end a piece have its row.
        children: dict[int, int] = {}
        row_of = [-1]
        for row, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = children.setdefault(node << 21 | ord(c), len(row_of))
                if node == len(row_of):
                    row_of.append(-1)
            row_of[node] = row
        keys = np.fromiter(children, np.int64, len(children))
        order = np.argsort(keys)
        # The last key is behind all others.
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._nodes = np.append(np.fromiter(children.values(), np.int64, len(children))[order], 0)
        self._row_of = np.array(row_of)
        # The last row: a character that is no piece.
        self._rows = np.vstack([probabilities, np.full((1, probabilities.shape[1]), _UNSEEN)])

    def _found(self, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and rows of all pieces in ``codes``; ``rest``: letters from each place to the end of its word."""
        starts, nodes, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for length in range(1, self.longest + 1):
            inside = rest[starts] >= length
            starts, nodes = starts[inside], nodes[inside]
            keys = nodes << 21 | codes[starts + length - 1]
            at = np.searchsorted(self._keys, keys)
            known = self._keys[at] == keys
            if length == 1:
                rows = np.where(known, self._row_of[self._nodes[at]], -1)
                found.append((starts, np.where(rows < 0, len(self._rows) - 1, rows)))
            starts, nodes = starts[known], self._nodes[at[known]]
            if length > 1:
                rows = self._row_of[nodes]
                found.append((starts[rows >= 0], rows[rows >= 0]))
            if not len(starts):
                break
        lengths = np.repeat(np.arange(1, len(found) + 1), [len(f[0]) for f in found])
        return np.concatenate([f[0] for f in found]), lengths, np.concatenate([f[1] for f in found])

    def _advance(self, words: list[str], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The recursion over words from the longest to the shortest, none empty.

        ``before``: its values at the first places of each word, known already (words x places x languages).
        Gives the last values of each word, as many places back as pieces reach, and the logarithms of their scales.
        """
        known, n = before.shape[1], len(self._rows[0])
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - first[word]
        starts, lengths, rows = self._found(codes, sizes[word] - place)
        ends = place[starts] + lengths
        # A word has a value more than letters.
        base = first + np.arange(len(words))
        new = ends >= known
        starts, lengths, rows, ends = starts[new], lengths[new], rows[new], ends[new]
        source = starts + word[starts]
        order = np.lexsort((source + lengths, ends))
        source, rows, target, ends = source[order], rows[order], (source + lengths)[order], ends[order]
        group = np.flatnonzero(np.diff(target, prepend=-1))
        steps = np.arange(known, sizes[0] + 2)
        bounds = np.searchsorted(ends, steps)
        groups = np.searchsorted(ends[group], steps)
        alive = len(words) - np.searchsorted(sizes[::-1], steps)
        reach = np.zeros((len(codes) + len(words), n))
        reach[(base[:, None] + np.arange(known)).ravel()] = before.reshape(-1, n)
        scale = np.zeros((len(words), n))
        for k, end in enumerate(steps[:-1]):
            low, high = bounds[k], bounds[k + 1]
            places = group[groups[k] : groups[k + 1]]
            reach[target[places]] = np.add.reduceat(reach[source[low:high]] * self._rows[rows[low:high]], places - low)
            if end >= _SAFE and end % _RESCALE == 0:
                last = base[: alive[k]] + end
                by = np.where(reach[last] > 0, reach[last], 1.0)
                window = last[:, None] - np.arange(min(end + 1, self.longest))
                reach[window] /= by[:, None]
                scale[: alive[k]] += np.log(by)
        back = min(self.longest, sizes[-1] + 1)
        return reach[(base + sizes)[:, None] + np.arange(1 - back, 1)], scale

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """One row per word, one column per language."""
        n = self._rows.shape[1]
        out, limit = np.zeros((len(words), n)), max(_PART * 8 // max(8, n), 4 * self.longest)
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: -len(words[i]))
        at = 0 if n else len(order)
        while at < len(order):
            if len(words[order[at]]) > limit:
                out[order[at]] = self._long(words[order[at]], limit)
                at += 1
                continue
            until, letters = at, 0
            while until < len(order) and letters + len(words[order[until]]) <= limit:
                letters += len(words[order[until]])
                until += 1
            part = order[at:until]
            last, scale = self._advance([words[i] for i in part], np.ones((len(part), 1, n)))
            out[part] = np.log(last[:, -1]) + scale
            at = until
        return out

    def _long(self, word: str, limit: int) -> np.ndarray:
        """One word in stretches: each starts from the values that pieces reach back to."""
        values, total, start = np.ones((1, 1, self._rows.shape[1])), 0.0, 0
        for end in range(limit, len(word) + limit, limit):
            values, scale = self._advance([word[start:end]], values)
            total, start = total + scale[0], min(end, len(word)) - values.shape[1] + 1
        return np.log(values[0, -1]) + total


@dataclass
class LanguageModel:
    """``languages`` in order, and the probability of each piece in each of them."""

    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray

    def scorer(self, memo_limit: int = 150_000):
        forward, n = Forward(self.pieces, self.probabilities), len(self.languages)

        def compute(chunks: list[str]) -> list[bytes]:
            words = [words_of(c) for c in chunks]
            flat = [w for ws in words for w in ws]
            scores = forward.log_likelihood(flat) if flat else np.zeros((0, n))
            rows = np.zeros((len(chunks), n + 1))
            rows[:, 0] = [sum(map(str.isalpha, c)) for c in chunks]
            np.add.at(rows[:, 1:], np.repeat(np.arange(len(chunks)), [len(w) for w in words]), scores)
            return [r.tobytes() for r in rows]

        memo = ChunkMemo(compute, memo_limit)

        def score(texts: list[str]) -> list[tuple[str, float]]:
            out = []
            for values in memo.many(texts):
                letters, *logs = np.frombuffer(b"".join(values)).reshape(-1, n + 1).sum(0)
                if not letters or not n:
                    out.append((UNDETERMINED, 0.0))
                    continue
                best = int(np.argmax(logs))
                out.append((self.languages[best], float(1 / np.exp(np.array(logs) - logs[best]).sum())))
            return out

        return score


def train(
    docs: DataFrame, piece_file: str, per_language: int = 2000, smoothing: float = 0.1,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> LanguageModel:
    """Piece probabilities from about ``per_language`` documents of each language, chosen by a hash of
    their ids (all documents of a language with fewer). Rows without text or language are not used.

    The driver receives a count per piece and language: vocabulary times languages rows at most.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    pieces = vocabulary(piece_file)
    languages = sorted(sizes)
    counts = np.zeros((len(pieces), len(languages)))
    if languages:
        share = F.lit(0.0)
        for name, size in sizes.items():
            share = F.when(F.col("lang") == name, F.lit(per_language / size)).otherwise(share)
        draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language-id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.filter(draw < share).select("lang", "text")
        place, column = {p: i for i, p in enumerate(pieces)}, {x: i for i, x in enumerate(languages)}
        for r in sample.mapInArrow(_piece_counts(piece_file), "lang string, piece string, n long").groupBy("lang", "piece").agg(
                F.sum("n").alias("n")).collect():
            if r["piece"] in place:
                counts[place[r["piece"]], column[r["lang"]]] += r["n"]
    totals = counts.sum(0) + smoothing * len(pieces)
    return LanguageModel(languages, pieces, (counts + smoothing) / totals)


def _piece_counts(piece_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=piece_file)
        for batch in batches:
            counts: Counter = Counter()
            for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = Counter(words_of(value))
                names = list(words)
                for name, found in zip(names, library.encode([w.removeprefix(MARK) for w in names], out_type=str, num_threads=1)):
                    for piece in found:
                        counts[lang, piece] += words[name]
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "piece", "n"])

    return run


def _cached_scorer(languages: list[str], pieces: list[str], probabilities: np.ndarray):
    key = (tuple(languages), len(pieces), probabilities.tobytes())
    return worker_cached("language", key, lambda: LanguageModel(languages, pieces, probabilities).scorer())


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    ``score`` is the posterior probability of the predicted language among the learned ones. Null texts
    and texts without a letter are ``und`` with score 0, as is everything if nothing was learned. Ties go
    to the language first in order. Repeated rows give a row each; other columns are not read.
    """
    # Vocabulary times languages, whatever the corpus.
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probabilities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _cached_scorer(*held.value)
        for batch in batches:
            for ids, values in slices(batch):
                found = score(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the documents that are not learned from: crc32 of the id as text, remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(
    docs: DataFrame, piece_file: str, per_language: int = 2000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned on the documents not held out, predicted for all."""
    model = train(docs.filter(~held_out(doc_id)), piece_file, per_language, doc_id=doc_id, text=text, lang=lang)
    found = predict(docs, model, doc_id, text)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose language is determined with at least ``min_score``, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probabilities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _cached_scorer(*held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = score([t.as_py() or "" for t in part.column(part.schema.get_field_index(text))])
                yield part.filter(pa.array([f[0] != UNDETERMINED and f[1] >= min_score for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
