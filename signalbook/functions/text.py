"""Portable text helpers as Column expressions (Unicode-aware, code-point based)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character that counts as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c) -> Column:
    """Remove all leading and trailing white space, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def words(c) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def word_tokens(c, min_len: int = 1) -> Column:
    """Runs of letters, digits and underscore in any script, at least ``min_len`` long."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]{%d,})" % min_len), F.lit(1))


def normalized(c) -> Column:
    """Key under which two questions count as the same: stripped and lower-cased."""
    return F.lower(strip(c))


def seeded_order(key, seed: int) -> Column:
    """Reproducible pseudo-random order: the md5 of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(f"-{seed}")))


def stable_hash(*cols) -> Column:
    """First eight hex digits of the md5 of the dash-joined values, as a number."""
    joined = F.concat_ws("-", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def contains_any(c, needles) -> Column:
    """True when any of the literal needles is a substring."""
    out = F.lit(False)
    for needle in needles:
        out = out | c.contains(needle)
    return out


def matches(c, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware regular-expression search."""
    return c.rlike("(?iU)" + pattern)


def count_matches(c, pattern: str) -> Column:
    return F.regexp_count(c, F.lit("(?iU)" + pattern))


def any_of(*patterns: str) -> str:
    """A pattern that any of the given ones satisfies; of none, one that nothing satisfies."""
    return "(?:" + "|".join(patterns) + ")" if patterns else "(?!)"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def char_trigrams(c) -> Column:
    """Distinct three-character windows of the normalized text; empty below three characters."""
    chars = F.regexp_extract_all(normalized(c), F.lit("(?s)(.)"), F.lit(1))

    def windows(x):
        starts = F.slice(x, F.lit(1), F.greatest(F.size(x) - 2, F.lit(0)))
        return F.array_distinct(F.transform(starts, lambda ch, i: F.concat(ch, F.get(x, i + 1), F.get(x, i + 2))))

    return bind(chars, windows)


def jaccard(a, b) -> Column:
    """Intersection over union of two sets; 0.0 when either is empty."""

    def ratio(s):
        both = F.size(F.array_intersect(s["a"], s["b"]))
        sizes = F.size(s["a"]) + F.size(s["b"])
        return F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(both / (sizes - both))

    return bind(F.struct(a.alias("a"), b.alias("b")), ratio)
