"""SimHash near duplicates by ball hashing that meets in the middle.

Two fingerprints that differ in at most ``radius`` bits have a word between them that is within half the radius of
either. So every fingerprint publishes all variants with up to ``radius / 2`` flipped bits, and whatever meets on a
variant is linked; nothing else can be.

The space of variants is dealt over the tasks by its leading bits. A fingerprint travels once to each prefix that its
variants reach, with the flips spent on the way (1 + b + b (b - 1) / 2 rows for b leading bits and radius 4), and the
task that owns the prefix writes out the variants below it: the same meetings as if each of the 2,081 variants were a
row of its own, for a few dozen rows. Prefixes that gather more variants than a task should hold are extended by more bits
until they fit, so a dense family of near copies is spread as well.

Equal fingerprints are one before anything is published. Fingerprints that meet on a variant are all within the
radius of each other, so a task ties each of them to one of them (after checking the distance), and never forms pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.chunks import release_worker
from signalbook.llm.components import components
from signalbook.llm.frames import join_checked, materialize

BITS, SEED = 64, 42
CELL_VARIANTS = 4_000_000  # written out by a task at once
_DEEPER = 8  # bits by which a full prefix is extended
_HASHES = 100_000  # whose bits are counted at once


def shingle_hashes(data: bytes, size: int) -> list[int]:
    """XXH64 of the runs of ``size`` words, repeats included; of all words if there are fewer."""
    words = data.lower().split()  # for bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes[i]`` hashes (at least one) the bits that are set in over half of them."""
    # Bits become bytes, eight of them to a word; up to 255 such words add up without a carry.
    ends = np.cumsum(sizes)
    starts = ends - sizes
    parts = -(-sizes // 255)
    run = np.repeat(np.arange(len(sizes)), parts)
    at = starts[run] + 255 * (np.arange(len(run)) - (np.cumsum(parts) - parts)[run])
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8)
    counts = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(values: list[bytes], size: int) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for i, value in enumerate(values):
        hashes = shingle_hashes(value, size)
        if len(hashes) > _HASHES:  # a very long text by itself, its bit counts added up
            h = np.array(hashes, np.uint64)
            counts = sum(
                np.unpackbits(h[k : k + _HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                for k in range(0, len(h), _HASHES))
            out[i] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
            values[i] = b""
        else:
            values[i] = hashes
    some = [i for i, v in enumerate(values) if v]
    held, size = [], 0
    for k, i in enumerate(some):
        held.append(i)
        size += len(values[i])
        if size >= _HASHES or k == len(some) - 1:
            hashes = np.array([h for j in held for h in values[j]], np.uint64)
            out[held] = majority(hashes, np.array([len(values[j]) for j in held]))
            held, size = [], 0
    return out


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                found = fingerprints_of([t or b"" for t in part.column("text").to_pylist()], shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row; texts without words (null too) have fingerprint zero."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(shingle), "doc_id long, fp long")


def flips(bits: int, most: int) -> dict[int, np.ndarray]:
    """Masks over the low ``bits`` bits, by their number of set bits up to ``most``."""
    return {k: np.array([sum(1 << p for p in c) for c in combinations(range(bits), k)], np.uint64) for k in range(min(most, bits) + 1)}


def _reach(low: int, high: int, half: int):
    """From prefixes of ``low`` bits to those of ``high`` bits. Rows: cell (prefix), spent (flips), fp."""
    masks = flips(high - low, half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in batches:
            cell, fp = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("cell", "fp"))
            spent = batch.column("spent").to_numpy(zero_copy_only=False)
            own = (fp >> np.uint64(BITS - high)) & np.uint64((1 << (high - low)) - 1)
            for used in range(half + 1):
                at = np.flatnonzero(spent == used)
                for more, m in masks.items():
                    if used + more > half or not len(at):
                        continue
                    prefix = (own[at, None] ^ m[None, :]) | ((cell[at] << np.uint64(high - low)) if low else np.zeros(len(at), np.uint64))[:, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prefix.ravel().view(np.int64)), pa.array(np.full(prefix.size, used + more, np.int32)),
                         pa.array(np.repeat(fp[at], len(m)).view(np.int64))], names=["cell", "spent", "fp"])

    return run


def tied(fp: np.ndarray, spent: np.ndarray, depth: int, half: int) -> list[tuple[int, int]]:
    """Pairs of distinct fingerprints of a cell that tie together all which meet on a variant of the cell."""
    low = np.uint64((1 << (BITS - depth)) - 1)
    masks = flips(BITS - depth, half)
    variants, owners = [], []
    for used in range(half + 1):
        at = np.flatnonzero(spent == used)
        if len(at):
            m = np.concatenate([x for k, x in masks.items() if k <= half - used])
            variants.append(((fp[at] & low)[:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(at, len(m)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    same = variant[1:] == variant[:-1]
    meets = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    variant, owner = variant[meets], owner[meets]
    if not len(owner):
        return []
    first = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    a, b = np.unique(np.stack([owner[first][group], owner], 1), axis=0).T if len(owner) < 1 << 16 else _pairs(owner[first][group], owner)
    near = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= 2 * half)
    a, b = a[near], b[near]
    label = np.arange(len(fp))
    while True:  # the smallest label of either end, until nothing changes
        least = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, least)
        np.minimum.at(fresh, b, least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return list(zip(fp[label[moved]].view(np.int64).tolist(), fp[moved].view(np.int64).tolist()))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    joined = np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
    return (joined >> np.uint64(32)).astype(np.int64), (joined & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _meetings(depth: int, half: int):
    """Links of the cells; rows arrive sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        place, fps, used = None, [], []

        def made() -> pa.RecordBatch:
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            found = tied(fp, np.concatenate(used), depth, half) if len(fp) > 1 else []
            fps.clear()
            used.clear()
            left, right = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for batch in batches:
            cell, fp, spent = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "spent"))
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)]):
                if hi > lo:
                    if cell[lo] != place:
                        yield made()
                        place = cell[lo]
                    fps.append(fp[lo:hi].view(np.uint64).copy())
                    used.append(spent[lo:hi].copy())
        yield made()

    return run


def link_fingerprints(fps: DataFrame, radius: int = 4, budget: int = CELL_VARIANTS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) which differ in at most ``radius`` bits.

    Every two such fingerprints are connected through links, and linked fingerprints are connected through steps within the radius.
    ``radius`` is even; ``budget`` bounds the variants that a task writes out at once.
    """
    if radius < 2 or radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    total = fps.count() * sum(comb(BITS, k) for k in range(half + 1))
    depth = min(max(1, (4 * total // budget).bit_length()), 40)
    kinds = "cell long, spent int, fp long"
    rows = fps.select(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("spent"), "fp").mapInArrow(_reach(0, depth, half), kinds)
    links = None
    while True:
        weight = F.lit(0)
        for used in range(half + 1):
            weight = F.when(F.col("spent") == used, sum(comb(BITS - depth, k) for k in range(half - used + 1))).otherwise(weight)
        # At most (variants / budget) cells are full; joins with them are broadcast only if they are few.
        full = materialize(rows.groupBy("cell").agg(F.sum(weight.cast("long")).alias("variants")).filter(F.col("variants") > budget).select("cell"))
        last = depth + _DEEPER > BITS - _DEEPER or full.isEmpty()
        fit = rows if last else join_checked(rows, full, ["cell"], "left_anti")
        found = fit.repartition("cell").sortWithinPartitions("cell").mapInArrow(_meetings(depth, half), "a long, b long")
        links = found if links is None else links.union(found)
        if last:
            return links
        rows = materialize(join_checked(rows, full, ["cell"], "left_semi").mapInArrow(_reach(depth, depth + _DEEPER, half), kinds))
        depth += _DEEPER


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of characters other than ASCII white space, A-Z as a-z; a bit of the fingerprint is set if over half of
    the hashes of all ``shingle``-word shingles have it (fewer words are one shingle; a text without words, null or
    empty, has fingerprint zero and is linked as any other). Documents are linked if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable. Repeated rows give a row each; rows without an id
    take part and never give the smallest id (null if a component has no id at all). Other columns are not read.
    """
    marked = materialize(fingerprints(docs, shingle, doc_id, text))
    owners = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    roots = components(link_fingerprints(owners.select("fp"), radius))
    placed = materialize(owners.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # Fingerprints that are linked with others are few beside all: their smallest ids are joined back on their own.
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    out = join_checked(marked, materialize(named), ["fp"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
