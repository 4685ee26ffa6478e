"""Cleaning and domain tagging of chat answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.text import any_of, count_matches, matches, rstrip, strip, word_tokens


def strip_trailing_followups(c: Column, followups=None, fillers=None) -> Column:
    """Drop follow-up questions and filler lines from the end.

    The text is returned as it was when its last non-blank line is kept or nothing would remain.
    """
    asks = any_of(*(rules.TRAILING_FOLLOWUPS if followups is None else followups))
    filler = "^" + any_of(*(rules.FILLERS if fillers is None else fillers))
    lines = F.split(rstrip(c), "\n")

    def kept_at(line, i):
        t = strip(line)
        return F.when((t != "") & ~matches(t, asks) & ~matches(t, filler), i)

    last = F.array_max(F.transform(lines, kept_at))
    cut = rstrip(F.array_join(F.slice(lines, 1, last + 1), "\n"))
    return F.when(last < F.size(lines) - 1, cut).otherwise(c)


def strip_leading_restatement(user: Column, answer: Column, ratio: float = 0.7, min_rest: int = 50) -> Column:
    """Drop the first line (or first sentence of a one-line answer) when it repeats the question."""
    newline = F.locate("\n", answer, 2)
    stop = F.regexp_instr(F.substring(answer, 1, 300), F.lit(r"[.!]\s"))
    cut = F.when(newline > 0, newline - 1).when(stop > 0, stop + 1)
    head = F.lower(strip(F.substring(answer, F.lit(1), cut)))
    asked = F.array_distinct(word_tokens(F.lower(strip(user)), 4))
    said = F.array_distinct(word_tokens(head, 4))
    repeats = F.size(F.array_intersect(asked, said)) / F.greatest(F.size(asked), F.lit(1)) >= ratio
    restates = matches(head, any_of(*rules.RESTATEMENTS))
    rest = F.regexp_replace(F.substring(answer, cut + 1, F.length(answer)), r"^\s+", "")
    drop = (
        cut.isNotNull() & (F.size(asked) > 0) & (F.size(said) > 0)
        & (repeats | restates) & (F.length(rest) > min_rest)
    )
    return F.when(drop, rest).otherwise(answer)


def drop_filler_lines(c: Column, fillers=None) -> Column:
    """Drop every line that starts with a filler phrase; keep the text if nothing would remain."""
    filler = "^" + any_of(*(rules.FILLERS if fillers is None else fillers))
    lines = F.split(c, "\n")
    kept = F.filter(lines, lambda line: ~matches(strip(line), filler))
    text = strip(F.array_join(kept, "\n"))
    return F.when((F.size(kept) < F.size(lines)) & (text != ""), text).otherwise(c)


def infer_domain(user: Column, answer: Column, category: Column, patterns=None) -> Column:
    """Domain with the most pattern matches, helped by hints in the category; null if unsure."""
    patterns = rules.DOMAIN_PATTERNS if patterns is None else patterns
    if not patterns:
        return F.lit(None).cast("string")
    text = F.concat_ws(" ", user, answer)
    label = F.lower(F.coalesce(category, F.lit("")))
    found = {d: sum((count_matches(text, p) for p in ps), F.lit(0)) for d, ps in patterns.items()}
    total = sum(found.values(), F.lit(0))
    scored = dict(found)
    for needles, domain in rules.CATEGORY_HINTS:
        if domain in scored:
            hit = F.lit(False)
            for n in needles:
                hit = hit | label.contains(n)
            scored[domain] = scored[domain] + F.when(hit, rules.HINT_BONUS).otherwise(0)
    # The negative position makes the earlier domain win among equal scores.
    ranked = F.array(*[F.struct(s.cast("long").alias("score"), F.lit(-i).alias("rank"), F.lit(d).alias("name"))
                       for i, (d, s) in enumerate(scored.items())])
    top = F.array_max(ranked)
    return F.when((total > 0) & (top["score"] >= rules.MIN_DOMAIN_SCORE), top["name"])


def has_domain_tag(c: Column, domains=None) -> Column:
    names = any_of(*(rules.DOMAIN_PATTERNS if domains is None else domains))
    return strip(c).rlike(rf"^\[{names}\]")


def tag_domain(c: Column, domain: Column) -> Column:
    """Prefix ``[domain] `` unless a tag is there already or the domain is unknown."""
    return F.when(has_domain_tag(c) | domain.isNull(), c).otherwise(F.concat(F.lit("["), domain, F.lit("] "), c))


def sentences(c: Column) -> Column:
    """Sentences of every line: cut after . ! ? before a capital, digit or list mark."""
    cut = F.split(c, r'(?<=[.!?])\s+(?=[A-Z\d*\-("\\])')
    lines = F.flatten(F.transform(cut, lambda s: F.transform(F.split(s, "\n"), strip)))
    return F.filter(lines, lambda s: s != "")


def clean_answers(df: DataFrame, user: str, answer: str, category: str, patterns=None) -> DataFrame:
    """All cleaning steps in order, with one flag per step that changed the answer.

    Rows without an answer (null) pass unchanged with all flags false.
    """
    a = F.col
    out = df.withColumn("_a1", strip_trailing_followups(a(answer)))
    out = out.withColumn("_a2", strip_leading_restatement(a(user), a("_a1")))
    out = out.withColumn("_a3", drop_filler_lines(a("_a2")))
    out = out.withColumn("had_tag", F.coalesce(has_domain_tag(a("_a3")), F.lit(False)))
    out = out.withColumn(
        "domain",
        F.when(a(answer).isNotNull() & ~a("had_tag"), infer_domain(a(user), a("_a3"), a(category), patterns)),
    )
    out = out.withColumn("cleaned", tag_domain(a("_a3"), a("domain")))
    changed = lambda x, y: F.coalesce(a(x) != a(y), F.lit(False))
    return out.withColumns({
        "followup_cut": changed("_a1", answer),
        "restatement_cut": changed("_a2", "_a1"),
        "filler_cut": changed("_a3", "_a2"),
        "tag_added": a("domain").isNotNull(),
        "modified": changed("cleaned", answer),
    }).drop("_a1", "_a2", "_a3")
