"""Collocations from depth-truncated suffix trees that are built independently for groups of word prefixes.

As in ERA's vertical partitioning, the tree of all suffixes (here cut after four words) is never built whole. Its top is cut into
prefixes that fit a memory budget, prefixes are put together to groups of about that size, and each group's subtrees
are built by a task of its own:

1. texts are encoded once, as runs of word numbers with breaks between pieces, each run with its own words and counts;
2. the frequencies of single words come from the runs' counts. Prefixes whose suffixes exceed a part of the budget are extended by one word,
   counted over the encoded runs, and so on up to the depth. The extended prefixes are kept as a bit map
   of fixed size: a false positive only extends a prefix that would have fit;
3. each run sorts its truncated suffixes, counts equal ones, and sends the leaves of each group as one row;
4. a group merges its leaves into the sorted order of its subtrees; the count of a node is the total of the leaves
   below it. Nodes above a cut (extended prefixes) lie in several groups, whose totals are added.

Words below the least count are breaks for phrases (no phrase with such a word can reach it), but count as words. A bit map of
fixed size tells them; its false positives cost time only.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbook.llm.chunks import release_worker
from signalbook.llm.frames import join_checked, materialize
from signalbook.llm.shingles import mix

DEPTH = 4
GROUP_SUFFIXES = 2_000_000  # suffixes of a group: the memory budget
RUN_WORDS, RUN_DISTINCT = 1_000_000, 250_000  # of an encoded run
_BITS = 1 << 25  # of the bit maps: 4 MB
_SLICE = 4_000_000  # bytes of text split at once
_LINK = np.uint64(0x9E3779B97F4A7C15)

# Space and tab part words; . , ; : ! ? and line ends (LF, VT, FF, CR) part pieces.
_GAPS = bytes(32 if c == 9 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Run:
    """Word numbers of the texts of one language; 0 is a break."""

    def __init__(self):
        self.numbers, self.ids, self.carried = _Numbers(), array("I"), 0

    def add(self, data: bytes) -> bool:
        """A part of a text without leading or trailing half words. True if the run is full."""
        data = data.translate(_GAPS).replace(b"\n", b" \n ")
        numbers = self.numbers
        for word in data.split(b" "):
            if word == b"\n":
                self.ids.append(0)
            elif word:
                self.ids.append(numbers[word])
        return len(self.ids) >= RUN_WORDS or len(numbers) >= RUN_DISTINCT

    def row(self, going_on: bool) -> tuple[list[bytes], list[int], bytes, int]:
        """words, counts, ids and how many words at the end belong to the next run (which begins with them): the last
        ones of a piece that goes on there."""
        ids = np.frombuffer(self.ids, np.uint32)
        tail = min(DEPTH - 1, len(ids)) if going_on else 0
        if tail:
            stops = np.flatnonzero(ids[-tail:] == 0)
            tail -= int(stops[-1]) + 1 if len(stops) else 0
        counts = np.bincount(ids[: len(ids) - tail], minlength=len(self.numbers) + 1)[1:]
        return list(self.numbers), counts.tolist(), zlib.compress(ids.tobytes(), 1), tail


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size, cut beside white space or a piece's end (a longer word stays whole)."""
    at = 0
    while len(data) - at > _SLICE:
        end = max(data.rfind(c, at, at + _SLICE) for c in (b" ", b"\n", b".", b","))
        if end < at:
            end = min((i for i in (data.find(c, at + _SLICE) for c in (b" ", b"\n", b".", b",")) if i >= 0), default=len(data) - 1)
        yield data[at : end + 1]
        at = end + 1
    yield data[at:]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_worker()
    runs: dict[str, Run] = {}

    def made(lang: str, going_on: bool) -> pa.RecordBatch:
        run = runs.pop(lang)
        words, counts, ids, tail = run.row(going_on)
        if tail:
            names = {v: k for k, v in run.numbers.items()}
            runs[lang] = fresh = Run()
            fresh.ids.extend(fresh.numbers[names[i]] for i in run.ids[-tail:])
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([[w.decode() for w in words]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())),
             pa.array([ids], pa.binary()), pa.array([tail], pa.int32())], names=["lang", "words", "counts", "ids", "tail"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for part in _parts(text.as_py() or b""):
                run = runs.setdefault(lang, Run())
                if run.add(part):
                    yield made(lang, True)
            if lang in runs:
                runs[lang].ids.append(0)
        held = sum(len(r.ids) for r in runs.values()), sum(len(r.numbers) for r in runs.values())
        if held[0] >= 2 * RUN_WORDS or held[1] >= 2 * RUN_DISTINCT:
            lang = max(runs, key=lambda k: len(runs[k].ids))
            yield made(lang, False)
    for lang in list(runs):
        yield made(lang, False)


def encode(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, words, counts, ids, tail: the encoded runs."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_encode, "lang string, words array<string>, counts array<long>, ids binary, tail int")


def _word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """The bit map of a column h of hashes: at most its own fixed size comes to the driver."""
    bits = np.zeros(_BITS // 8, np.uint8)
    place = F.expr(f"pmod(cast(h as decimal(20,0)) + if(h < 0, 18446744073709551616BD, 0BD), {_BITS}BD)").cast("long")
    words = hashes.select(place.alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    whole = bits.view("<i8")
    for w, v in words.toPandas().itertuples(index=False):
        whole[w] = v
    return bits


def _hash_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list] = {}
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist()):
            found.setdefault(lang, []).append(word)
        h = np.concatenate([_word_hashes(k, v) for k, v in found.items()]) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


class Suffixes:
    """The distinct truncated suffixes of a run, as rows of word numbers (0: ended), sorted, with counts."""

    def __init__(self, lang: str, words: list[str], ids: bytes, tail: int, frequent: np.ndarray):
        hashes = _word_hashes(lang, words)
        # In order of the words, so that the lists of words that travel are sorted and shrink.
        kept = np.array(sorted(np.flatnonzero(_has(frequent, hashes)).tolist(), key=words.__getitem__), np.int64)
        self.words, self.hashes = [words[k] for k in kept], np.concatenate([np.zeros(1, np.uint64), hashes[kept]])
        number = np.zeros(len(words) + 1, np.uint32)
        number[kept + 1] = np.arange(1, len(kept) + 1)
        ids = number[np.frombuffer(zlib.decompress(ids), np.uint32)]
        padded = np.concatenate([ids, np.zeros(DEPTH, np.uint32)])
        starts = np.flatnonzero(padded[: len(ids) - tail])
        starts = starts[padded[starts + 1] > 0]  # single words are counted already
        rows, alive = np.zeros((len(starts), DEPTH), np.uint32), np.ones(len(starts), bool)
        for k in range(DEPTH):
            rows[:, k] = padded[starts + k] * alive
            alive &= rows[:, k] > 0
        self.rows, self.counts = merged(rows, np.ones(len(rows), np.int64))

    def prefix_hashes(self, at: np.ndarray, depth: int) -> np.ndarray:
        h = self.hashes[self.rows[at, 0]]
        for k in range(1, depth):
            h = mix(h * _LINK + self.hashes[self.rows[at, k]])
        return h


def merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, counts of equal ones added."""
    if not len(rows):
        return rows, counts
    bits = max(1, int(rows.max()).bit_length())
    wide = [rows[:, k].astype(np.uint64) for k in range(DEPTH)]
    if DEPTH * bits <= 64:
        key = wide[0]
        for k in range(1, DEPTH):
            key = (key << np.uint64(bits)) | wide[k]
        order = np.argsort(key)
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    else:
        high, low = (wide[0] << np.uint64(32)) | wide[1], (wide[2] << np.uint64(32)) | wide[3]
        order = np.lexsort((low, high))
        fresh = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
    first = np.flatnonzero(fresh)
    return rows[order[first]], np.add.reduceat(counts[order], first)


def pack(values: np.ndarray) -> bytes:
    """Columns of unsigned integers one after the other, the bytes of each place together, compressed."""
    flat = np.ascontiguousarray(values.T).ravel()
    return zlib.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _prefix_counts(frequent, extended, depth: int):
    """h, n: counts of the prefixes of ``depth`` words below the extended ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        bits, cut = (np.frombuffer(x, np.uint8) for x in (frequent, extended))
        for batch in batches:
            for row in batch.to_pylist():
                s = Suffixes(row["lang"], row["words"], row["ids"], row["tail"], bits)
                at = np.arange(len(s.rows))
                for k in range(1, depth):
                    at = at[_has(cut, s.prefix_hashes(at, k))]
                at = at[s.rows[at, depth - 1] > 0]
                h, back = np.unique(s.prefix_hashes(at, depth), return_inverse=True)
                n = np.bincount(back, weights=s.counts[at], minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


def _leaves(frequent, extended, groups: int):
    """group, lang, words, leaves, counts: the suffixes of a run that belong to a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        bits, cut = (np.frombuffer(x, np.uint8) for x in (frequent, extended))
        for batch in batches:
            for row in batch.to_pylist():
                s = Suffixes(row["lang"], row["words"], row["ids"], row["tail"], bits)
                if not len(s.rows):
                    continue
                place, h = np.zeros(len(s.rows), np.uint64), np.zeros(len(s.rows), np.uint64)
                at = np.arange(len(s.rows))
                for k in range(1, DEPTH + 1):
                    h = s.prefix_hashes(at, k)
                    place[at] = h
                    if k < DEPTH:
                        on = _has(cut, h) & (s.rows[at, k] > 0)
                        at = at[on]
                group = (mix(place) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                ends = np.searchsorted(group[order], np.arange(groups + 1))
                out = []
                for g in np.flatnonzero(np.diff(ends)):
                    part = order[ends[g] : ends[g + 1]]
                    names, index = np.unique(s.rows[part], return_inverse=True)
                    if names[0] != 0:
                        names, index = np.concatenate([[0], names]), index + 1
                    leaf = index.reshape(-1, DEPTH).astype("<u2" if len(names) <= 1 << 16 else "<u4")
                    most = s.counts[part].astype("<u1" if s.counts[part].max() < 256 else "<u8")
                    listed = " ".join(s.words[n - 1] for n in names[1:])
                    out.append((int(g), row["lang"], zlib.compress(listed.encode(), 1), pack(leaf), pack(most), leaf.itemsize, most.itemsize))
                columns = zip(*out)
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(_LEAF))

    return run


_LEAF = {"group": "long", "lang": "string", "words": "binary", "leaves": "binary", "counts": "binary", "wide": "int", "wide_n": "int"}


class Subtree:
    """The truncated suffixes of one group and language, merged as they come."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.held, self.size, self.settled = lang, _Numbers(), [], 0, 0

    def add(self, words: bytes, leaves: bytes, counts: bytes, wide: int, wide_n: int) -> None:
        numbers = self.numbers
        own = np.array([0] + [numbers[w] for w in zlib.decompress(words).decode().split(" ")], np.uint32)
        rows = own[unpack(leaves, wide).reshape(DEPTH, -1).T]
        self.held.append((rows, unpack(counts, wide_n).astype(np.int64)))
        self.size += len(rows)
        if self.size > 2 * self.settled + 200_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = (np.concatenate(x) for x in zip(*self.held))
        self.held = [merged(rows, counts)]
        self.size = self.settled = len(self.held[0][0])
        return self.held[0]

    def nodes(self, least: int, cut: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """(phrases, sizes, totals, whole) by depth: the nodes with at least ``least`` occurrences, and all that lie in several
        groups (``whole`` is False), from the totals of their leaves."""
        rows, counts = self.settle()
        words = list(self.numbers)
        hashes = np.concatenate([np.zeros(1, np.uint64), _word_hashes(self.lang, words)])
        h = hashes[rows[:, 0]]
        spread = _has(cut, h)
        for k in range(1, DEPTH):
            h = mix(h * _LINK + hashes[rows[:, k]])
            # In several groups: this prefix and all above it are extended, and more words follow somewhere.
            spread &= _has(cut, h) if k < DEPTH - 1 else False
            below = np.flatnonzero(rows[:, k] > 0)
            if not len(below):
                return
            part = rows[below, : k + 1]
            first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(1)]))
            totals = np.add.reduceat(counts[below], first)
            split = spread[below[first]]
            chosen = np.flatnonzero((totals >= least) | split)
            names = [" ".join(words[i - 1] for i in row) for row in part[first[chosen]].tolist()]
            yield names, np.full(len(names), k + 1, np.int32), totals[chosen], ~split[chosen]


def _subtrees(least: int, extended: bytes):
    """lang, phrase, size, a, whole of the groups; rows arrive sorted by group and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        cut, place, tree = np.frombuffer(extended, np.uint8), None, None

        def made() -> Iterator[pa.RecordBatch]:
            for names, sizes, totals, whole in tree.nodes(least, cut) if tree else ():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree.lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int32()),
                     pa.array(totals, pa.int64()), pa.array(whole, pa.bool_())], names=["lang", "phrase", "size", "a", "whole"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _LEAF)):
                if row[:2] != place:
                    yield from made()
                    place, tree = row[:2], Subtree(row[1])
                tree.add(*row[2:])
        yield from made()

    return run


def phrase_counts(
    runs: DataFrame, words: DataFrame, least: int, group_suffixes: int = GROUP_SUFFIXES,
) -> DataFrame:
    """lang, phrase, size, a: the phrases of two to four words with at least ``least`` occurrences. ``words``: lang, word, a
    of the words with as many."""
    counted = words.mapInArrow(_hash_column, "h long")
    frequent = _bit_map(counted).tobytes()
    total = words.agg(F.sum("a")).first()[0] or 0
    groups = max(1, -(-2 * total // group_suffixes))
    # Prefixes with over half of a group's suffixes are extended.
    extended = _bit_map(words.filter(F.col("a") > group_suffixes // 2).mapInArrow(_hash_column, "h long"))
    for depth in range(2, DEPTH):
        if not extended.any():
            break
        found = runs.mapInArrow(_prefix_counts(frequent, extended.tobytes(), depth), "h long, n long")
        more = _bit_map(found.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > group_suffixes // 2).select("h"))
        if not more.any():
            break
        extended |= more
    cut = extended.tobytes()
    leaves = runs.mapInArrow(_leaves(frequent, cut, groups), ", ".join(f"`{k}` {v}" for k, v in _LEAF.items()))
    nodes = materialize(leaves.repartition("group").sortWithinPartitions("group", "lang").mapInArrow(
        _subtrees(least, cut), "lang string, phrase string, size int, a long, whole boolean"))
    added = nodes.filter("not whole").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return nodes.filter("whole").drop("whole").unionByName(added)


def _first_words(n: int):
    return F.array_join(F.slice("w", 1, n), " ")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase: its cut with the lowest score floor(2000000 a / (l + r)), the first of equals."""
    parts = F.expr("transform(sequence(1, size - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') as first, array_join(slice(w, k + 1, size - k), ' ') as rest))")
    asked = phrases.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(parts)).select(
        "lang", "phrase", "a", "cut.k", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("cut.first").alias("part")), F.struct(F.lit(1).alias("side"), F.col("cut.rest").alias("part")))).alias("half"),
    ).select("lang", "phrase", "a", "k", "half.side", F.col("half.part").alias("part"))
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("n")).unionByName(words.select("lang", F.col("word").alias("part"), F.col("a").alias("n")))
    found = asked.join(counts.hint("merge"), ["lang", "part"])
    cuts = found.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    exact = F.expr("cast(cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    lowest = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def contained(phrases: DataFrame, share: int = 80) -> DataFrame:
    """lang, phrase of the phrases whose words lie inside a longer phrase with at least ``share`` percent of their occurrences."""
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = phrases.filter("size > 2").withColumn("w", F.split("phrase", " ")).select("lang", "a", F.explode(inner).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return phrases.join(most, ["lang", "phrase"]).filter(wide("most") * 100 >= wide("a") * share).select("lang", "phrase")


def collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, group_suffixes: int = GROUP_SUFFIXES, lang: str = "lang", text: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language.

    Texts (A-Z as a-z; null as empty) are split at . , ; : ! ? and line ends into pieces, pieces at spaces and tabs into words; a null language
    is ``und``. n counts the words of a language, a the occurrences of a phrase of two to four words inside pieces, at least ``least``; l and r are those of the
    two parts of its weakest cut. Phrases inside a longer one that has ``share`` percent of their occurrences are left out. Order: score, then a, downwards, then the
    phrase. Repeated rows count as often as they are there; other columns are not read.
    """
    runs = materialize(encode(docs, lang, text))
    each = runs.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("lang", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    totals = runs.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    words = materialize(each.groupBy("lang", "word").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
    phrases = materialize(phrase_counts(runs, words, least, group_suffixes))
    kept = scored(phrases, words).join(contained(phrases, share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each of many parts of a language, then the first of those: no language is sorted in one task.
    salted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return join_checked(ranked, materialize(totals), ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
