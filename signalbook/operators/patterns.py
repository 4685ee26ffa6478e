"""Rule tables given as DataFrames: many literal patterns looked for in one pass over each text.

Patterns of a length are a sorted list of hashes. The hash of every place of a text and any length follows from running sums, so a batch of texts
is looked through as a whole: places whose first letters begin no pattern are left out step by step, the others are looked up by length and compared letter by
letter. The time for a text does not depend on the number of rules, where a column expression would have a term for each. The table is sent to the tasks in
parts of checked size, by length, so that a second part looks for other lengths instead of doing the same work again; never a join of all texts with all rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbook.operators.similarity import HELD_ROWS, _mix
from signalbook.session import materialize

PART_BYTES = 64 << 20  # of patterns sent to a task at once
BLOCK_CHARS = 1 << 17  # letters of texts looked through at once
GATES = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48)  # lengths of beginnings that are tried before whole patterns; doubled beyond
END = 0x110000  # stands between texts, no letter
_BASE, _GOLD = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15  # odd


# --- patterns --------------------------------------------------------------------------------
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _spread(codes: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(np.uint64) + np.uint64(1))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """A bit for each hash among about sixteen times as many, and the shift that leads there."""
    size = max(6, int(16 * len(hashes)).bit_length())
    table = np.zeros(1 << size, bool)
    table[(hashes * np.uint64(_GOLD)) >> np.uint64(64 - size)] = True
    return np.packbits(table, bitorder="little"), 64 - size


def _passes(table: np.ndarray, shift: int, hashes: np.ndarray) -> np.ndarray:
    at = ((hashes * np.uint64(_GOLD)) >> np.uint64(shift)).view(np.int64)
    return np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The number of each value among the different ones, and these; null is a value."""
    values = column.combine_chunks()
    try:
        found = values.dictionary_encode(null_encoding="encode")
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
    except pa.ArrowNotImplementedError:  # nested
        first: dict[str, int] = {}
        at = np.array([first.setdefault(repr(v.as_py()), i) for i, v in enumerate(values)], np.int64)
        rows, numbers = np.unique(at, return_inverse=True)
        return numbers, values.take(pa.array(rows))


def _ends(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` numbers begins and ends among the sorted ones."""
    return np.searchsorted(numbers, np.arange(n + 1))


def _compiled(rows: pa.Table) -> dict:
    """What tasks need of (rule, pattern, ...): steps by length, the rules of each pattern, and the other columns by rule."""
    rule, rules = _numbered(rows["rule"])
    valid = np.flatnonzero(pc.is_valid(rows["pattern"].combine_chunks()).to_numpy(zero_copy_only=False))
    number, patterns = _numbered(rows["pattern"].take(pa.array(valid)))
    others = pa.table({"_rule": rule, **{c: rows[c] for c in rows.column_names if c not in ("rule", "pattern")}})
    outs = others.group_by(others.column_names, use_threads=False).aggregate([]).sort_by("_rule") if len(others.column_names) > 1 else pa.table({"_rule": np.arange(len(rules))})
    of = outs["_rule"].to_numpy()
    size = pc.utf8_length(patterns).to_numpy(zero_copy_only=False)
    lengths = np.unique(size).tolist()
    gates = [g for g in [*GATES, *(64 << k for k in range(24))] if min(lengths[0], 8) <= g <= lengths[-1]]
    power = _powers(_BASE, lengths[-1])
    begins: dict[int, list[np.ndarray]] = {g: [] for g in gates}
    steps, place, done = [], np.empty(len(patterns), np.int64), 0
    for n in lengths:
        mine = np.flatnonzero(size == n)
        letters, hashes = [], []
        for k in range(0, len(mine), step := max(1, BLOCK_CHARS // n)):
            codes = _letters("".join(patterns.take(pa.array(mine[k : k + step])).to_pylist())).reshape(-1, n)
            sums = np.cumsum(_spread(codes) * power[:n], axis=1, dtype=np.uint64)
            letters.append(codes.astype(np.uint8 if codes.max() < 1 << 8 else np.uint16 if codes.max() < 1 << 16 else np.uint32))
            hashes.append(sums[:, -1])
            for g in gates:
                if g <= n:
                    begins[g].append(np.unique(sums[:, g - 1]))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        place[done : done + len(mine)] = mine[order]
        steps.append((n, True, (*_bits(hashes), hashes, np.concatenate(letters)[order], done, bool((hashes[1:] == hashes[:-1]).any()))))
        done += len(mine)
    steps += [(g, False, _bits(np.unique(np.concatenate(begins[g])))) for g in gates]
    # A pattern is known by its place among all, by length and hash.
    turned = np.empty_like(place)
    turned[place] = np.arange(len(place))
    pairs = np.unique(turned[number] * len(rules) + rule[valid])
    return {
        "steps": sorted(steps, key=lambda x: x[:2]), "longest": lengths[-1], "rules": rules, "outs": outs.select(outs.column_names[1:]),
        "of_pattern": (_ends(pairs // len(rules), len(place)), (pairs % len(rules)).astype(np.int32)), "of_rule": (_ends(of, len(rules)), np.arange(len(of))),
    }


# --- texts -----------------------------------------------------------------------------------
def _expanded(rows: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's entry and its values: those from ends[row] to ends[row + 1]."""
    start = ends[rows]
    n = ends[rows + 1] - start
    if (n == 1).all():
        return np.arange(len(rows)), values[start]
    entry = np.repeat(np.arange(len(rows)), n)
    return entry, values[np.arange(len(entry)) - np.repeat(np.cumsum(n) - n - start, n)]


class _Search:
    """Looks for the patterns of a part in blocks of texts."""

    def __init__(self, part: dict, whole_words: bool, block_chars: int):
        self.part, self.whole_words, self.block = part, whole_words, block_chars
        room = block_chars + part["longest"] + 2
        self.power, self.inverse = _powers(_BASE, room), _powers(pow(_BASE, -1, 1 << 64), room)
        self.spread = _spread(np.arange(END + 1))
        self.words: dict[int, bool] = {END: False}

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns begin, and which."""
        total, found = len(codes), []
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(self.spread[codes] * self.power[:total], out=sums[1:])
        at = None  # places left: at first all
        for n, whole, step in self.part["steps"]:
            if n > total:
                break
            if at is None:
                hashes = (sums[n:] - sums[:-n]) * self.inverse[: total + 1 - n]
            else:
                now = at[: np.searchsorted(at, total - n, "right")]
                hashes = (sums[now + n] - sums[now]) * self.inverse[now]
            if not whole:
                left = _passes(*step, hashes)
                at = left if at is None else now[left]
                if not len(at):
                    break
                continue
            table, shift, listed, letters, first, same = step
            left = _passes(table, shift, hashes)
            if not len(left):
                continue
            hashes, start = hashes[left], left if at is None else now[left]
            k = np.searchsorted(listed, hashes)
            if same:  # several patterns have one hash
                ends = np.searchsorted(listed, hashes, "right")
                entry = np.repeat(np.arange(len(k)), ends - k)
                k = np.arange(len(entry)) - np.repeat(np.cumsum(ends - k) - (ends - k) - k, ends - k)
                start = start[entry]
            else:
                hit = np.flatnonzero(listed[np.minimum(k, len(listed) - 1)] == hashes)
                k, start = k[hit], start[hit]
            equal = np.ones(len(k), bool)
            for j in range(n):
                equal &= letters[k, j] == codes[start + j]
            start, k = start[equal], k[equal]
            if self.whole_words:
                keep = ~(self.joined(codes, start - 1) | self.joined(codes, start + n - 1))
                start, k = start[keep], k[keep]
            found.append((start, k + first))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def joined(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a word goes on from a place to the next."""
        around = [np.where((x >= 0) & (x < len(codes)), codes[np.clip(x, 0, len(codes) - 1)], END) for x in (at, at + 1)]
        for c in set(np.unique(np.concatenate(around)).tolist()) - self.words.keys():
            self.words[c] = chr(c).isalnum() or c == ord("_")
        known = np.zeros(END + 1, bool)
        known[[c for c, word in self.words.items() if word]] = True
        return known[around[0]] & known[around[1]]

    def counted(self, row: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, rule and number of places."""
        entry, rule = _expanded(pattern, *self.part["of_pattern"])
        rules = len(self.part["rules"])
        pairs, n = np.unique(row[entry] * rules + rule, return_counts=True)
        return pairs // rules, pairs % rules, n

    def run(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of texts numbered as they come, block by block."""
        held: list[int] = []
        chars = 0

        def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes = _letters("\0".join(texts[i] for i in held)).astype(np.int64)
            starts = np.cumsum([0, *(len(texts[i]) + 1 for i in held)])
            codes[starts[1:-1] - 1] = END
            at, pattern = self.places(codes)
            return self.counted(np.array(held)[np.searchsorted(starts, at, "right") - 1], pattern)

        for i, text in enumerate(texts):
            if chars + len(text) + 1 > self.block and held:
                yield block()
                held, chars = [], 0
            if len(text) < self.block:
                held.append(i)
                chars += len(text) + 1
                continue
            # A long text in pieces that reach over the next one's start.
            parts, codes = [], _letters(text)
            for s in range(0, len(codes), step := self.block - 2):
                before = min(s, 1)
                at, pattern = self.places(codes[s - before : s + step + self.part["longest"]].astype(np.int64))
                own = (at >= before) & (at < before + step)
                parts.append(self.counted(np.full(own.sum(), i), pattern[own])[1:])
            rule, k = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
            n = np.zeros(len(rule), np.int64)
            np.add.at(n, k, np.concatenate([n for _, n in parts]))
            yield np.full(len(rule), i), rule, n
        if held:
            yield block()


def _parts(table: DataFrame, part_bytes: int) -> list[tuple[int, int, int, int]]:
    """Lengths from and to, and number and remainder of the rules' hashes, of parts of about ``part_bytes``."""
    sizes = table.groupBy("home").agg(F.sum(F.coalesce(F.octet_length("pattern"), F.lit(0)) + 64).alias("bytes")).orderBy("home").collect()
    out: list[tuple[int, int, int, int]] = []
    room = 0
    for home, size in sizes:
        if size > part_bytes:
            n = -(-size // part_bytes)
            out += [(home, home, n, k) for k in range(n)]
            room = 0
        elif size <= room:
            out[-1] = (out[-1][0], home, 1, 0)
            room -= size
        else:
            out.append((home, home, 1, 0))
            room = part_bytes - size
    return out


def rule_matches(
    df: DataFrame, rules: DataFrame, key: str = "row_id", text: str = "text", rule: str = "rule_id", pattern: str = "pattern",
    whole_words: bool = False, part_bytes: int = PART_BYTES, keep: tuple[str, ...] = (), block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(key, rule, n): the rules whose pattern is in the text of a row, and at how many places.

    Texts and patterns are compared in lower case. With ``whole_words`` a pattern counts only where no word goes on at either end. Null texts hold nothing, null and
    empty patterns are in nothing; rules with the same pattern match alike, a rule listed with several patterns counts all of them, a repeated
    one once. Repeated rows of ``df`` give results each. Other columns of both are not read, but those of ``rules`` named in ``keep`` come with
    their rule, a row for each combination that the rule is listed with.
    """
    # Every part reads the table again: it is made once, whatever it is derived from. Listed values count whether or not their row has a pattern.
    words = F.when(F.length(pattern) > 0, F.lower(F.col(pattern)))
    listed = rules.select(F.col(rule).alias("rule"), words.alias("pattern"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]).distinct()
    home = F.max(F.length("pattern")).over(Window.partitionBy("rule"))
    table = materialize(listed.withColumn("home", home).filter("home is not null"))
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField(rule, rules.schema[rule].dataType), T.StructField("n", T.LongType()),
        *[T.StructField(c, rules.schema[c].dataType) for c in keep]])
    texts = df.filter(F.col(text).isNotNull()).select(F.col(key), F.lower(F.col(text)).alias("_text"))
    out = None
    for low, high, many, rest in _parts(table, part_bytes):
        own = F.col("home").between(low, high) & (F.pmod(F.xxhash64("rule"), F.lit(many)) == rest)
        rows = table.filter(own).drop("home").toArrow()  # about ``part_bytes`` at most
        if not rows.num_rows:
            continue
        sent = df.sparkSession.sparkContext.broadcast(_compiled(rows))
        del rows

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            part = sent.value
            look = _Search(part, whole_words, block_chars)
            for batch in batches:
                for row, rule_at, n in look.run(batch.column("_text").to_pylist()):
                    entry, other = _expanded(rule_at, *part["of_rule"])
                    values = [batch.column(key).take(pa.array(row[entry])), part["rules"].take(pa.array(rule_at[entry])), pa.array(n[entry], pa.int64())]
                    values += [c.combine_chunks().take(pa.array(other)) for c in part["outs"].columns]
                    yield pa.RecordBatch.from_arrays(values, names=schema.names)

        hits = texts.mapInArrow(search, schema)
        out = hits if out is None else out.unionByName(hits)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def rule_coverage(
    matches: DataFrame, rules: DataFrame, total: int, rule: str = "rule_id", key: str = "row_id", repeated: DataFrame | None = None
) -> DataFrame:
    """(rule, n, share): rows with each rule and their share of ``total``, rules without rows included.

    A row counts once for a rule, however often it is listed with it. If ``repeated`` holds the keys that may be listed so, the
    matches of all others are counted where they are. Without it, or if it is too long to be sent to the tasks, all are made distinct first.
    """
    pairs = matches.select(rule, key)
    many = 0
    if repeated is not None:
        held = materialize(repeated.select(F.col(key).alias("_held")).distinct())
        many = held.count()
    if repeated is None or many > HELD_ROWS:
        rows = pairs.distinct().groupBy(rule).agg(F.count(F.lit(1)).alias("n"))
    elif many:
        marked = pairs.join(F.broadcast(held.withColumn("_again", F.lit(True))), F.col(key).eqNullSafe(F.col("_held")), "left")
        once = marked.groupBy(rule, "_held", "_again").agg(F.count(F.lit(1)).alias("n"))
        rows = once.groupBy(rule).agg(F.sum(F.when(F.col("_again"), 1).otherwise(F.col("n"))).alias("n"))
    else:
        rows = pairs.groupBy(rule).agg(F.count(F.lit(1)).alias("n"))
    listed = rules.select(rule).distinct().join(rows, rule, "left")
    return listed.select(rule, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / max(total, 1), 6).alias("share"))


def first_label(
    df: DataFrame, matches: DataFrame, rules: DataFrame, key: str = "row_id", rule: str = "rule_id", label: str = "label", priority: str = "priority",
) -> DataFrame:
    """``df`` with ``label``: that of the matching rule with the smallest priority (of equals the smallest label), null if no rule matches.

    The best rule of a row is kept per task before the shuffle, however many rules match it. Matches that have kept label and priority of their rule
    are not joined to ``rules`` and do not move.
    """
    kept = {label, priority} <= set(matches.columns)
    named = matches.filter(F.col(rule).isNotNull()) if kept else matches.join(rules.select(rule, label, priority).distinct(), rule)
    best = named.groupBy(key).agg(F.min(F.struct(priority, label)).alias("_best")).select(key, F.col(f"_best.{label}").alias(label))
    return df.join(best, key, "left")
