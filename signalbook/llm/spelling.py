"""Spelling variants of a vocabulary by a bit-sliced position index.

Words that differ by one inserted, deleted or replaced letter share a half: with m letters in the shorter one, the first m // 2
letters or the last m - m // 2 are equal. Every word is therefore placed in the cells (m, first half) and
(m, last half) for its own length and the one below, and only words of one cell are compared.

Inside a cell the words are sliced into bitsets: one per (position, letter), a bit for each word with that letter there. A
word is compared with all of them at once. Its letters are taken one after the other, and four bitsets follow them:

    zero      &= here                                    no error so far
    replaced   = replaced & here | zero & ~here          one letter replaced, positions as they are
    inserted   = (inserted | zero) & next                one more letter in the other word, positions one to the right
    deleted    = deleted & before | zero                 one letter less in the other word, positions one to the left

(``here``, ``next`` and ``before`` are the bitsets of the letter at the same position and beside it.) What is left in the last three, cut to the
words of the right length, are the near words. Pairs with an equal first half are left to the cell of that half.

Large cells are cut into pieces of (block of words asked, block of words indexed), so that no cell is one task's work.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.chunks import release_worker
from signalbook.llm.frames import join_checked, materialize

BLOCK = 4000  # words indexed together
_HELD = 400_000  # distinct words of a task counted before they are sent on

# Latin letters: A-Z as a-z, U+00C0 to U+00FF as they are, anything else is a gap.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def words_of(doc_id: int | None, text: str | None, shortest: int, slips: int) -> Counter:
    """Numbers of the words of a text, as latin-1 bytes. Of words whose hash with the document's id ``slips`` divides, a letter
    is deleted; words of fewer than ``shortest`` letters after that are left out."""
    found = Counter(w for w in (text or "").encode("latin-1", "replace").translate(_LETTERS).split(b" ") if len(w) >= shortest)
    if not slips:
        return found
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    slipped = []
    for word in found:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % slips == 0:
            slipped.append((word, h % len(word)))
    slipped = [(word, at, found.pop(word)) for word, at in slipped]
    for word, at, n in slipped:
        if len(word) > shortest:
            found[word[:at] + word[at + 1 :]] += n
    return found


def _counts(shortest: int, slips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        total: Counter = Counter()

        def made() -> Iterator[pa.RecordBatch]:
            items = list(total.items())
            total.clear()
            for k in range(0, len(items), 50_000):
                part = items[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode("latin-1") for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in words_of(doc, text.as_py(), shortest, slips).items():
                    total[word] += n
                if len(total) >= _HELD:
                    yield from made()
        yield from made()

    return run


def vocabulary(
    docs: DataFrame, shortest: int = 6, least: int = 5, slips: int = 0, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """word, n: the words of at least ``shortest`` letters that occur at least ``least`` times."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counts(shortest, slips), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class SlicedIndex:
    """Bitsets per (position, letter) and per length over a list of words."""

    def __init__(self, words: list[str]):
        self.slices: list[dict[str, int]] = [{} for _ in range(max(map(len, words), default=0) + 2)]
        self.lengths: dict[int, int] = {}
        bit = 1
        for word in words:
            for at, letter in zip(self.slices, word):
                at[letter] = at.get(letter, 0) | bit
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | bit
            bit <<= 1
        self.all = bit - 1

    def near(self, word: str, unless: int = 0) -> int:
        """The words one replacement, insertion or deletion away; with ``unless``, without those that have the
        same first ``unless`` letters."""
        zero, replaced, inserted, deleted, equal = self.all, 0, 0, 0, 0
        before: dict[str, int] = {}
        empty: dict[str, int] = {}
        last = len(self.slices) - 1
        for i, letter in enumerate(word):
            here = self.slices[i] if i <= last else empty
            after = self.slices[i + 1] if i < last else empty
            same = here.get(letter, 0)
            replaced = replaced & same | zero & ~same
            inserted = (inserted | zero) & after.get(letter, 0)
            deleted = deleted & before.get(letter, 0) | zero
            zero &= same
            before = here
            if i + 1 == unless:
                equal = zero
        m, size = len(word), self.lengths.get
        found = replaced & size(m, 0) | (inserted | zero) & size(m + 1, 0) | deleted & size(m - 1, 0)
        return found & ~equal


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, near_n, near: what a word finds in a piece of a cell. Rows arrive sorted by m, half, part, i, j."""
    release_worker()
    place, asked, indexed, out = None, [], [], []

    def solve() -> None:
        m, half = place[:2]
        index = SlicedIndex([w for w, _ in indexed])
        for word in asked:
            found = index.near(word, 0 if half == "p" else m // 2)
            if len(word) > m:  # words of that length meet each other in their own class
                found &= index.lengths.get(m, 0)
            if found:
                hits = [indexed[b] for b in _bits(found)]
                n, best = min((-n, w) for w, n in hits)
                out.append((word, len(hits), -n, best))

    def made() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n_near", "near_n", "near"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("m", "half", "part", "i", "j")))
        for key, word, n, side in zip(keys, *(batch.column(c).to_pylist() for c in ("word", "n", "side"))):
            if key != place:
                if asked and indexed:
                    solve()
                place, asked, indexed = key, [], []
            if side != 1:
                asked.append(word)
            if side != 0:
                indexed.append((word, n))
        yield made()
    if asked and indexed:
        solve()
    yield made()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, near_n, near of distinct ``words`` (word, n): how many words are one letter away, and the most
    frequent of them (the smallest of equals) with its n. Words without any are left out."""
    classes = words.filter(F.length("word") > 0).withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    first = F.floor(F.col("m") / 2).cast("int")
    ends = F.array(
        F.struct(F.lit("p").alias("half"), F.col("word").substr(F.lit(1), first).alias("part")),
        F.struct(F.lit("s").alias("half"), F.col("word").substr(F.length("word") - F.col("m") + first + 1, F.col("m") - first).alias("part")))
    cells = classes.withColumn("end", F.explode(ends)).select("word", "n", "m", "end.half", "end.part")
    key = ["m", "half", "part"]
    # Words that differ by a letter are two: cells of one word are left out. Blocks per cell, the few larger ones are cut.
    sizes = materialize(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    placed = join_checked(cells, sizes, key, "inner").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    # side 0 is asked, 1 is indexed, 2 both.
    roles = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))).otherwise(
        F.concat(
            F.transform(other, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
            F.transform(other, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))))
    dealt = placed.withColumn("own", own).withColumn("role", F.explode(roles)).select("word", "n", *key, "role.i", "role.j", "role.side")
    found = dealt.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j").mapInArrow(
        _near_words, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.w").alias("near"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root from ``forms`` (word, form): the end of each chain of forms. Forms are more frequent than their words, so there
    are no circles; chains halve with every round."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_groups(
    docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, slips: int = 0, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    A word is a maximal run of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z as a-z, of at least ``shortest`` letters and with
    at least ``least`` occurrences in all texts (null: none). Its form is the most frequent word one
    letter away (the smallest of equals), if that is at least ``factor`` times as frequent, else null; ``root`` is the last form reached. ``slips``: see
    ``words_of``; a null id counts as no digits there. Repeated rows count as often as they are there; other columns are not read.
    """
    words = materialize(vocabulary(docs, shortest, least, slips, doc_id, text))
    near = near_words(words)
    formed = F.col("near_n") >= factor * F.col("n")
    named = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    roots = last_forms(named.filter("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
