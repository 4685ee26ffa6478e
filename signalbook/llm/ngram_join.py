"""Jaccard join of word-shingle sets with count vectors and R-trees.

The hashed shingles of a document fall into groups; the numbers per group are a point. Two sets share at most
the sum of the smaller coordinates, so

    |A and B| <= sum over groups of min(a_g, b_g)

rejects pairs without their sets, and for boxes of points the larger corners bound all pairs below them.

A point has as many coordinates as the set has shingles, so no one box tree over all documents could prune.
The index is therefore a forest. Linked sets of at most u shingles differ in at most d = u * (1 - t) / t of
them; if the groups are dealt into b > d bands, the points of a linked pair are equal in b - d bands at least.
A tree stands for the documents that are equal in one band (a cell). Bands without any shingle are left out,
unless a document has b - d of them or more: only two such documents could have no other band in common.

Most bands are of one document only. They travel as sorted, difference-coded runs of keys, a few bytes each; the
cells of two documents or more are found range by range. Inside a cell:

1. every member is compared with the cell's smallest one, which ties families of near copies together;
2. members of cells that still hold several components are joined through the cell's R-tree by the
   bound above, large cells in bounded blocks; what candidates of different components tie together is gathered
   once, joined through an R-tree again, verified on the whole sets, and the links between components are kept.

Pairs inside one component need no check, so families never form all pairs; all other pairs of a cell are
bounded or verified, so no link between different components is lost. Nothing is sampled or capped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.chunks import release_worker, slices
from signalbook.llm.components import components
from signalbook.llm.frames import join_checked, materialize, shuffles_dropped
from signalbook.llm.shingles import mix, shingle_set

# Bits of a band's key; keys of one run, and of one range of them; documents of a run that crowd a cell.
KEY_BITS, RUN_KEYS, RANGE_KEYS, CROWD = 44, 1_000_000, 1_000_000, 16
# Members of a cell, and their shingles, joined in one piece of work; larger cells are cut into blocks.
BLOCK, BLOCK_SHINGLES = 2000, 1_000_000
LEAF = 32
_BITS = 1 << 23  # of the filter that spares documents without partners their second reading: 1 MB


class Threshold:
    """Jaccard at least num / den, and what follows for sizes, bands and points."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be in (0, 1]")
        self.num, self.den = num, den
        # Sizes between two steps share their bands; partners reach over one step at most.
        ratio = max(1.5, den / num)
        self._known: dict[int, tuple[int, int]] = {}
        self._steps = [1]
        while self._steps[-1] < 1 << 40:
            self._steps.append(int(self._steps[-1] * ratio) + 1)

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """(class, bands, least number of equal bands) of a set of ``n`` shingles: its own class, and the
        one below if a partner may be there."""
        k = int(np.searchsorted(self._steps, n, side="right")) - 1
        own = [k] + [k - 1] * (k > 0 and n * self.num <= (self._steps[k] - 1) * self.den)
        for c in own:
            if c not in self._known:
                self._known[c] = self._bands(c)
        return [(c, *self._known[c]) for c in own]

    def _bands(self, c: int) -> tuple[int, int]:
        """Bands of a class, enough that its smaller sets have fewer empty ones than equal ones."""
        differ = (self._steps[c + 1] - 1) * (self.den - self.num) // self.num
        equal = 1
        while True:
            empty = (differ + equal) * math.exp(-self._steps[c] / (differ + equal))
            if equal >= empty + 3 * math.sqrt(empty) or equal > differ:
                return differ + equal, equal
            equal += max(1, equal // 8)

    def keys(self, n: int) -> int:
        return sum(bands for _, bands, _ in self.classes(n)) if n else 0

    def overlap(self, sizes):
        """Least intersection of two linked sets of that many shingles together."""
        return -(-sizes * self.num // (self.num + self.den))


def band_keys(hashes: np.ndarray, threshold: Threshold) -> np.ndarray:
    """One key of ``KEY_BITS`` bits per class and band: equal for points equal in the band."""
    keys = []
    group = mix(hashes >> np.uint64(24))  # of 2^40 groups
    for c, bands, equal in threshold.classes(len(hashes)):
        band = (hashes % np.uint64(bands)).astype(np.int64)
        low = np.bincount(band, (group & np.uint64((1 << 26) - 1)).astype(np.float64), bands)
        high = np.bincount(band, (group >> np.uint64(38)).astype(np.float64), bands)
        place = np.arange(bands, dtype=np.uint64) + np.uint64(c << 48)
        found = mix(mix(low.astype(np.uint64) ^ mix(high.astype(np.uint64))) + mix(place))
        empty = np.bincount(band, minlength=bands) == 0
        keys.append(found[~empty] if empty.sum() < equal else found)
    return np.unique(np.concatenate(keys) >> np.uint64(64 - KEY_BITS))


def pack_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte of all of them, so that high bytes compress to nothing."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """Numbers of shingles per group; larger sets have more groups (64 times a power of 4)."""
    groups = 64
    while len(hashes) > 4 * groups:
        groups *= 4
    return np.bincount((mix(hashes ^ np.uint64(0x5BD1E995)) % np.uint64(groups)).astype(np.int64), minlength=groups)


def write_vector(counts: np.ndarray) -> bytes:
    """The counts in as many bytes each as the largest needs, behind a byte that says how many."""
    width = 1 if counts.max(initial=0) < 256 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def read_vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    """The counts of the same set over fewer groups."""
    return vector.reshape(*vector.shape[:-1], -1, groups).sum(-2)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    groups = min(len(a), len(b))
    return int(np.minimum(fold(a, groups), fold(b, groups)).sum())


class RTree:
    """A packed tree over count vectors, for joins by the summed smaller coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        # Sort-tile order: by size, then inside tiles by the coordinate that varies most.
        order = np.argsort(sizes, kind="stable")
        tile = max(LEAF, int(len(order) ** 0.5) // LEAF * LEAF)
        axis = int(points.var(0).argmax()) if len(points) else 0
        runs = [order[i : i + tile] for i in range(0, len(order), tile)]
        order = np.concatenate([r[np.argsort(points[r, axis], kind="stable")] for r in runs]) if runs else order
        # Levels from the leaves up: (rows or children, upper corner, smallest size).
        level = [(order[i : i + LEAF], None) for i in range(0, len(order), LEAF)]
        nodes = [(rows, (), points[rows].max(0), int(sizes[rows].min())) for rows, _ in level]
        while len(nodes) > 1:
            nodes = [
                (None, tuple(part), np.max([n[2] for n in part], 0), min(n[3] for n in part))
                for part in (nodes[i : i + 8] for i in range(0, len(nodes), 8))
            ]
        self.root = nodes[0] if nodes else None

    def join(self, other: "RTree", threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of the pairs that pass the bound; of a join with itself each pair once."""
        same = self is other
        stack = [(self.root, other.root)] if self.root and other.root else []
        while stack:
            a, b = stack.pop()
            if np.minimum(a[2], b[2]).sum() < threshold.overlap(a[3] + b[3]):
                continue
            if a[1] and b[1]:
                stack += [(x, y) for i, x in enumerate(a[1]) for j, y in enumerate(b[1]) if a is not b or i <= j]
            elif a[1]:
                stack += [(x, b) for x in a[1]]
            elif b[1]:
                stack += [(a, y) for y in b[1]]
            else:
                shared = np.minimum(self.points[a[0]][:, None, :], other.points[b[0]][None, :, :]).sum(-1)
                sums = self.sizes[a[0]][:, None] + other.sizes[b[0]][None, :]
                i, j = np.nonzero(shared >= threshold.overlap(sums))
                left, right = a[0][i], b[0][j]
                if same and a is b:
                    left, right = left[i < j], right[i < j]
                if len(left):
                    yield left, right


def _digest(hashes: np.ndarray) -> int:
    return int(mix(hashes).sum(dtype=np.uint64).view(np.int64))


def _profiles(shingle: int, threshold: Threshold):
    """doc_id, size, a 128-bit digest of the set, number of keys and count vector of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in batches:
            for ids, values in slices(batch, 250, 2_000_000):
                sets = [shingle_set(v.encode(), shingle) for v in values]
                sizes = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(map(_digest, sets), pa.int64()),
                     pa.array([_digest(s + np.uint64(1)) for s in sets], pa.int64()), pa.array(map(threshold.keys, sizes), pa.int64()),
                     pa.array([write_vector(count_vector(s)) for s in sets], pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "n_keys", "point"])

    return run


def _key_runs(shingle: int, threshold: Threshold, ranges: int):
    """Runs of band keys: range, owners (digests), keys, and which owner each key has.

    A key of more than ``CROWD`` documents of one run sends the smallest of them only; the documents themselves go
    out as rows of their own (key, d1, low), so that a crowded cell is never gathered in one place.
    """

    def flush(digests: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        owner = np.repeat(np.array(digests, np.int64), [len(k) for k in keys])
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0)
        size = np.diff(np.append(first, len(key)))
        crowded = np.repeat(size > CROWD, size)
        low = np.repeat(owner[first], size)
        rows = [(int(o) % ranges, None, None, None, k, o, w) for k, o, w in zip(key[crowded].tolist(), owner[crowded].tolist(), low[crowded].tolist())]
        sent = ~crowded
        sent[first] = True
        key, owner = key[sent], owner[sent]
        place = (key * np.uint64(ranges)) >> np.uint64(KEY_BITS)
        ends = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))
        for r in np.flatnonzero(np.diff(ends)):
            lo, hi = ends[r], ends[r + 1]
            names, at = np.unique(owner[lo:hi], return_inverse=True)
            width = 2 if len(names) < 1 << 16 else 4
            rows.append((int(r), names.tobytes(), pack_keys(key[lo:hi]), bytes([width]) + at.astype(f"<u{width}").tobytes(), None, None, None))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=["range", "owners", "keys", "at", "key", "d1", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        digests, keys, seen, size = [], [], set(), 0
        for batch in batches:
            for _, values in slices(batch, 250, 2_000_000):
                for value in values:
                    hashes = shingle_set(value.encode(), shingle)
                    digest = _digest(hashes)
                    if not len(hashes) or digest in seen:
                        continue
                    seen.add(digest)
                    digests.append(digest)
                    keys.append(band_keys(hashes, threshold))
                    size += len(keys[-1])
                    if size >= RUN_KEYS:
                        yield flush(digests, keys)
                        digests, keys, seen, size = [], [], set(), 0
        yield flush(digests, keys)
        digests, keys, seen = [], [], set()
        release_worker()

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (key, d1, low) of the cells of at least two sets, range by range."""
    place, keys, owners = None, [], []

    def made() -> pa.RecordBatch:
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[fresh], owner[fresh]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0)
        size = np.diff(np.append(first, len(key)))
        shared = np.repeat(size > 1, size)
        low = np.repeat(owner[first], size)
        keys.clear()
        owners.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(key[shared].view(np.int64)), pa.array(owner[shared]), pa.array(low[shared])], names=["key", "d1", "low"])

    for batch in batches:
        ready = batch.filter(batch.column("owners").is_null())
        if ready.num_rows:
            yield ready.select(["key", "d1", "low"])
        rest = batch.filter(batch.column("owners").is_valid())
        for r, names, data, at in zip(*(rest.column(c).to_pylist() for c in ("range", "owners", "keys", "at"))):
            if r != place:
                yield made()
                place = r
            keys.append(unpack_keys(data))
            owners.append(np.frombuffer(names, np.int64)[np.frombuffer(at, f"<u{at[0]}", offset=1)])
    yield made()
    release_worker()


def _passing(threshold: Threshold):
    """Pairs that pass the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_pylist() for c in ("n_a", "n_b"))
            pa_, pb = (batch.column(c).to_pylist() for c in ("point_a", "point_b"))
            keep = [bound(read_vector(x), read_vector(y)) >= threshold.overlap(m + n) for x, y, m, n in zip(pa_, pb, na, nb)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "d_a", "b", "d_b"])

    return run


def _by_work(columns: tuple[str, ...], use, names: dict[str, pa.DataType]):
    """``use`` on the rows of each piece of work; rows arrive sorted by ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        group, rows = None, []

        def made() -> pa.RecordBatch:
            found = list(zip(*use(rows))) if len(rows) > 1 else []
            found = found or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(found, names.values())], names=list(names))

        for batch in batches:
            lists = [c for c in columns if pa.types.is_list(batch.column(c).type)]
            data = [
                [v.values.to_numpy(zero_copy_only=False) for v in batch.column(c)] if c in lists else batch.column(c).to_pylist()
                for c in columns
            ]
            for work, *row in zip(batch.column("work").to_pylist(), *data):
                if work != group:
                    yield made()
                    group, rows = work, []
                rows.append(tuple(row))
        yield made()
        rows = []
        release_worker()

    return run


def _candidates(points: list[np.ndarray], side: list[int], threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one piece of work that pass the bound, found by its R-trees."""
    groups = min(map(len, points))
    folded, side = np.array([fold(p, groups) for p in points]), np.array(side)
    sizes = folded.sum(1)
    if not side.any():
        tree = RTree(folded, sizes)
        yield from tree.join(tree, threshold)
        return
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    trees = RTree(folded[left], sizes[left]), RTree(folded[right], sizes[right])
    for i, j in trees[0].join(trees[1], threshold):
        yield left[i], right[j]


def _near(threshold: Threshold):
    """Pairs that tie the members of a piece of work together which have a candidate in another component.
    Rows: doc, root, point, side."""

    def use(rows: list[tuple]) -> list[tuple]:
        root, tied, out = np.array([r[1] for r in rows]), np.arange(len(rows)), []
        for i, j in _candidates([read_vector(r[2]) for r in rows], [r[3] for r in rows], threshold):
            apart = root[i] != root[j]
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                if tied[x] != tied[y]:
                    tied[tied == tied[y]] = tied[x]
                    out.append((rows[x][0], rows[y][0]))
        return out

    return use


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs, exactly."""
    if len(left) <= 20 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    # Many pairs: products of the incidence matrix, a run of shingles at a time.
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # shingles of one set only are in no intersection
    rows, column = rows[times[column] > 1], place[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[rows[lo:hi], column[lo:hi] - start] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def _spanning(threshold: Threshold):
    """Links that tie components of a piece of work together. Rows: doc, root, side, hashes."""

    def use(rows: list[tuple]) -> list[tuple]:
        sets = [r[3] for r in rows]
        root = np.array([r[1] for r in rows])
        parent: dict = {}

        def find(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        points = [count_vector(s.view(np.uint64)) for s in sets]
        found = [
            (i[root[i] != root[j]], j[root[i] != root[j]])
            for i, j in _candidates(points, [r[2] for r in rows], threshold)
        ]
        if not found:
            return []
        left, right = (np.concatenate(x) for x in zip(*found))
        shared = _shared(sets, left, right)
        sums = np.array(list(map(len, sets)))[left] + np.array(list(map(len, sets)))[right]
        linked = shared * threshold.den >= (sums - shared) * threshold.num
        out = []
        for i, j in zip(left[linked].tolist(), right[linked].tolist()):
            a, b = find(rows[i][1]), find(rows[j][1])
            if a != b:
                parent[a] = b
                out.append((rows[i][0], rows[j][0]))
        return out

    return use


def _sets_of(shingle: int, bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits, np.uint8)
        for batch in batches:
            at = np.array([-1 if i is None else i % _BITS for i in batch.column("doc_id").to_pylist()], np.int64)
            chosen = np.flatnonzero((at >= 0) & (wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            for k in range(0, len(chosen), 100):
                part = batch.take(pa.array(chosen[k : k + 100]))
                sets = [shingle_set((t.as_py() or "").encode(), shingle) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(_digest, sets), pa.int64()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "d1", "hashes"])

    return run


def _sets(ends: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, d1, hashes of the documents in ``ends`` (doc_id, d1; distinct).

    Texts of other documents are kept out by a bit map of fixed size; its false positives and, on a
    very large corpus, its filling up cost time only, because the sets are joined by id and digest.
    """
    bits = bytearray(_BITS // 8)
    place = f"pmod(doc_id, {_BITS})"
    with shuffles_dropped(docs.sparkSession):
        words = ends.groupBy(F.expr(f"cast({place} div 32 as int)").alias("w")).agg(
            F.expr(f"bit_or(shiftleft(1L, cast({place} % 32 as int)))").alias("v")).collect()
    for r in words:
        bits[4 * r["w"] : 4 * r["w"] + 4] = int(r["v"]).to_bytes(4, "little")
    sets = docs.mapInArrow(_sets_of(shingle, bytes(bits)), "doc_id long, d1 long, hashes array<long>")
    return materialize(sets.join(ends, ["doc_id", "d1"], "left_semi").dropDuplicates(["doc_id", "d1"]))


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, threshold: Threshold) -> DataFrame:
    """The pairs (a, d_a, b, d_b) whose whole sets are similar enough."""
    ends = pairs.select(F.col("a").alias("doc_id"), F.col("d_a").alias("d1")).union(pairs.select("b", "d_b")).distinct()
    sets = _sets(ends, docs, shingle)
    left = sets.select(F.col("doc_id").alias("a"), F.col("d1").alias("d_a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("d1").alias("d_b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    num, den = threshold.num, threshold.den
    return (
        pairs.join(left, ["a", "d_a"]).join(right, ["b", "d_b"])
        .select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), shared.alias("shared"))
        .filter(F.col("shared") * den >= (F.col("sizes") - F.col("shared")) * num)
        .select("a", "b")
    )


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """Members of the groups ``key`` (columns d1, size and shingles of the group, others) as pieces of work.

    A group of several blocks becomes a piece for each pair of blocks: a member of block i works in the pieces
    (i, j) and (j, i), on the first or on the second side.
    """
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), (F.col("own") > j).cast("int").alias("side")))
    dealt = (
        members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("d1"), F.col("blocks")).cast("int"))
        .withColumn("piece", F.explode(pieces)).withColumn("side", F.col("piece.side"))
        .withColumn("work", F.xxhash64(key, "piece.i", "piece.j"))
    )
    return dealt.drop("blocks", "own", "piece", "size", "shingles").repartition("work").sortWithinPartitions("work")


def similar_components(
    docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of characters other than ASCII white space, A-Z as a-z; a document is the set of its
    distinct shingles of ``shingle`` words (with fewer words, of the one sequence they make). Documents are
    linked when ``den * intersection >= num * union``; ``component_id`` is the smallest id reachable by links.
    Null, empty and blank texts have no shingles and are linked with nothing. Equal sets are merged before
    anything else. Repeated rows give a row each; other columns are not read.
    """
    threshold = Threshold(num, den)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profiles = materialize(rows.mapInArrow(
        _profiles(shingle, threshold), "doc_id long, n long, d1 long, d2 long, n_keys long, point binary"))
    filled = profiles.filter("n > 0")
    merged = materialize(filled.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc"), F.first("point").alias("point")))

    # Members of the cells of two different sets at least, each with the smallest member it has met.
    with shuffles_dropped(docs.sparkSession):
        ranges = max(64, (filled.agg(F.sum("n_keys")).first()[0] or 0) // RANGE_KEYS)
    runs = rows.mapInArrow(
        _key_runs(shingle, threshold, ranges), "range long, owners binary, keys binary, at binary, key long, d1 long, low long")
    members = materialize(
        runs.repartition("range").sortWithinPartitions("range").mapInArrow(_cells, "key long, d1 long, low long"))

    def pairs_of(frame: DataFrame) -> DataFrame:
        """(a, d_a, b, d_b) that pass the bound, from columns d_a and d_b."""
        side = lambda s: merged.select(
            F.col("d1").alias(f"d_{s}"), F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("point").alias(f"point_{s}"))
        return frame.join(side("a"), "d_a").join(side("b"), "d_b").mapInArrow(
            _passing(threshold), "a long, d_a long, b long, d_b long")

    # Every set with the smallest one of each of its cells, and how many cells they share. Near copies share most of their cells with
    # many others, so each set is first tied to the one it shares most with; points and sets travel for these pairs, and
    # then only for pairs that are not of one component by that.
    star = materialize(
        members.filter("d1 != low").groupBy(F.col("low").alias("d_a"), F.col("d1").alias("d_b")).agg(F.count(F.lit(1)).alias("shared")))
    best = star.groupBy("d_b").agg(F.max_by("d_a", F.struct("shared", "d_a")).alias("d_a"))
    links = materialize(_verified(materialize(pairs_of(best)), rows, shingle, threshold))
    rooted = materialize(
        merged.select("d1", "doc").join(components(links).withColumnRenamed("node", "doc"), "doc", "left").select("d1", F.coalesce("root", "doc").alias("root")))
    apart = (
        star.select("d_a", "d_b").join(rooted.toDF("d_a", "root_a"), "d_a").join(rooted.toDF("d_b", "root_b"), "d_b")
        .filter("root_a != root_b").select("d_a", "d_b"))
    links = materialize(links.union(_verified(materialize(pairs_of(apart)), rows, shingle, threshold)))
    roots = components(links)

    # Cells whose members are not all of one component; of cells with the same members one is enough.
    nodes = materialize(
        merged.join(roots.withColumnRenamed("node", "doc"), "doc", "left")
        .select("d1", "doc", "n", "point", F.coalesce("root", "doc").alias("root")))
    placed = members.select("key", "d1").distinct().join(nodes.select("d1", "doc", "root", "n"), "d1")
    open_cells = (
        placed.groupBy("key").agg(
            F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"),
            F.bit_xor(F.xxhash64("d1", "doc")).alias("s0"), F.sum(F.xxhash64("doc", "d1").cast("decimal(38,0)")).alias("s1"))
        .filter("r0 != r1").groupBy("size", "shingles", "s0", "s1").agg(F.min("key").alias("key")).select("key", "size", "shingles")
    )
    in_cells = placed.select("key", "d1").join(open_cells, "key").join(nodes.select("d1", "doc", "root", "point"), "d1")
    near = _blocks(in_cells, "key").mapInArrow(
        _by_work(("doc", "root", "point", "side"), _near(threshold), {"a": pa.int64(), "b": pa.int64()}), "a long, b long")
    near = materialize(near.distinct())

    # What such pairs tie together is verified in one place, however many cells it shares.
    groups = components(near)
    grouped = materialize(
        groups.union(groups.select("root", "root").distinct()).toDF("doc", "group").join(nodes.select("doc", "d1", "root", "n"), "doc"))
    sets = _sets(grouped.select(F.col("doc").alias("doc_id"), "d1"), rows, shingle)
    sized = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    in_groups = grouped.join(sized, "group").join(sets.withColumnRenamed("doc_id", "doc"), ["doc", "d1"])
    more = _blocks(in_groups, "group").mapInArrow(
        _by_work(("doc", "root", "side", "hashes"), _spanning(threshold), {"a": pa.int64(), "b": pa.int64()}), "a long, b long")
    roots = components(links.union(more))
    owners = merged.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select(
        "d1", "d2", "n", F.coalesce("root", "doc").alias("component_id"))
    return profiles.select("doc_id", "n", "d1", "d2").join(owners, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each group of near duplicates, all columns.

    Rows without an id are kept. Rows are told apart by id and text: of equal rows one is kept (the one whose other columns come first as
    JSON), and rows that share an id but not the text are separate documents, which come after all ids that are in one row only.
    """
    columns = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__near_row")]
    shared = docs.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(doc_id)).agg(F.count(F.lit(1)).alias("__near_rows")).filter("__near_rows > 1")
    shared = materialize(shared.select(doc_id))
    if shared.isEmpty():
        found = similar_components(docs, shingle, num, den, doc_id, text)
        drop = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct()
        return join_checked(docs, materialize(drop), [doc_id], "left_anti")
    # Rows of ids that several rows have: one of each (id, text), under a number of its own above all other ids.
    rest = join_checked(docs, shared, [doc_id], "left_anti").select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *columns)
    again = join_checked(docs, shared, [doc_id], "left_semi").select(
        (F.lit(1 << 62) + F.xxhash64(doc_id, text).bitwiseAND((1 << 61) - 1)).alias("doc_id"), F.col(text).alias("text"), *columns)
    once = again.groupBy("doc_id", "text").agg(F.min_by("__near_row", F.to_json("__near_row")).alias("__near_row"))
    both = materialize(rest.unionByName(once))
    return keep_one(both, shingle, num, den).select("__near_row.*")
