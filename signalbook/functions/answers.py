"""Reading answers of multiple-choice and free-text questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.text import bind, strip


def mcq_prompt(question: Column, choices: Column) -> Column:
    """Question with ``n) choice`` lines and a number-only instruction."""
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("  "), i.cast("string"), F.lit(") "), c, F.lit("\n"))), "")
    end = "\nRespond with ONLY the number of the correct answer (e.g., 0, 1, 2, 3, or 4). Do not explain."
    return F.concat(question, F.lit("\n\n"), lines, F.lit(end))


def mcq_prompt_labelled(question: Column, choices: Column) -> Column:
    """Question with a ``Choices:`` block of ``n: choice`` lines."""
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("  "), i.cast("string"), F.lit(": "), c, F.lit("\n"))), "")
    end = "\nAnswer with ONLY the number of the correct choice (0, 1, 2, etc.)."
    return F.concat(question, F.lit("\n\nChoices:\n"), lines, F.lit(end))


def _digit(c: Column, pattern: str) -> Column:
    """First captured digit of the pattern, null without a match."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")


def _letter(c: Column) -> Column:
    found = F.nullif(F.regexp_extract(F.substring(c, 1, 50), r"(?U)\b([A-E])\b", 1), F.lit(""))
    return F.ascii(found) - F.ascii(F.lit("A"))


def _first_in_range(n: Column, *candidates: Column) -> Column:
    return F.coalesce(*[F.when(v < n, v) for v in candidates], F.lit(-1)).cast("int")


def _digits(t: Column) -> list[Column]:
    return [
        _digit(t, r"^(\d)"),
        _digit(t, r"(?i)(?:answer|option|choice)[:\s]+(\d)"),
        _digit(F.substring(t, 1, 50), r"(?U)\b(\d)\b"),
    ]


def extract_answer(c: Column, n: Column) -> Column:
    """Chosen index below ``n``: leading digit, labelled digit, lone digit, lone letter; else -1."""
    t = strip(c)
    return _first_in_range(n, *_digits(t), _letter(t))


def extract_digit(c: Column, n: Column) -> Column:
    """As ``extract_answer`` without the letter step."""
    return _first_in_range(n, *_digits(strip(c)))


def extract_loose(c: Column) -> Column:
    """First lone digit, else first lone letter A-E, of the first 50 characters; no range check."""
    t = strip(c)
    return F.coalesce(_digit(F.substring(t, 1, 50), r"(?U)\b([0-9])\b"), _letter(t), F.lit(-1)).cast("int")


TERM = r"(?U)([a-z0-9][\w\-]*[a-z0-9]|[a-z0-9])"


def key_concepts(choice: Column, explanation: Column, stopwords=None, limit: int = 15) -> Column:
    """Distinct terms of answer and explanation, then two-word terms of the answer; first ``limit``."""
    stop = F.array(*[F.lit(w) for w in (rules.CONCEPT_STOPWORDS if stopwords is None else stopwords)]).cast("array<string>")

    def terms(c):
        return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(1))

    def useful(w):
        return (F.length(w) >= 3) & ~F.array_contains(stop, w)

    def pairs(ws):
        heads = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0)))
        two = F.transform(heads, lambda w, i: F.struct(w.alias("a"), F.get(ws, i + 1).alias("b")))
        kept = F.filter(two, lambda p: useful(p["a"]) & useful(p["b"]))
        return F.transform(kept, lambda p: F.concat_ws(" ", p["a"], p["b"]))

    single = F.filter(terms(F.concat_ws(" ", choice, explanation)), useful)
    return F.slice(F.array_distinct(F.concat(single, bind(terms(choice), pairs))), 1, limit)


def concept_coverage(answer: Column, concepts: Column) -> Column:
    """Struct of score, found and missing concepts (distinct) by substring search; none give 0."""

    def cover(x):
        found = F.filter(x["concepts"], lambda c: F.contains(x["low"], c))
        return F.struct(x["concepts"].alias("concepts"), found.alias("found"))

    def result(x):
        n = F.size(x["concepts"])
        score = F.when(n == 0, F.lit(0.0)).otherwise(F.size(x["found"]) / F.greatest(n, F.lit(1)))
        missing = F.array_except(x["concepts"], x["found"])
        return F.struct(score.alias("score"), x["found"].alias("found"), missing.alias("missing"))

    return bind(bind(F.struct(F.lower(answer).alias("low"), concepts.alias("concepts")), cover), result)
