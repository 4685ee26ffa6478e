"""Entities, keywords and plans in operator questions and model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions.text import bind, contains_any, matches, strip


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit("(?iU)" + pattern), F.lit(1))


def extract_entities(c: Column) -> Column:
    """Struct (cell_id, cell_ids, site_id, site_ids) as a question names them.

    One cell or several cells; else one site (reported as cell_id) or several sites; without any
    such id, numbers after an element word, else long numbers after a preposition, count as sites.
    """
    found = F.struct(
        _all(c, rules.CELL_ID).alias("cells"), F.array_distinct(_all(c, rules.SITE_ID)).alias("named"),
        _all(c, rules.KEYWORD_NUMBER).alias("numbers"), _all(c, rules.LONG_NUMBER).alias("long"),
    )

    def pick(x):
        sites = (
            F.when((F.size(x["cells"]) > 0) | (F.size(x["named"]) > 0), x["named"])
            .when(F.size(x["numbers"]) > 0, x["numbers"]).otherwise(x["long"])
        )
        n_cells, n_sites = F.size(x["cells"]), F.size(sites)
        many_sites = (n_cells == 0) & (n_sites > 1)
        return F.struct(
            F.when(n_cells > 0, F.get(x["cells"], F.lit(0))).when(n_sites == 1, F.get(sites, F.lit(0))).alias("cell_id"),
            F.when(n_cells > 1, x["cells"]).alias("cell_ids"),
            F.when(many_sites, F.get(sites, F.lit(0))).alias("site_id"),
            F.when(many_sites, sites).alias("site_ids"),
        )

    return bind(found, pick)


def skill_class(c: Column) -> Column:
    """First keyword class with a substring in the question, else ``general``."""
    low = F.lower(c)
    out = None
    for name, needles in rules.SKILL_KEYWORDS:
        hit = contains_any(low, needles)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def skill_chain(c: Column) -> Column:
    kind = skill_class(c)
    out = None
    for name, chain in rules.SKILL_CHAINS.items():
        steps = F.array(*[F.lit(s) for s in chain])
        out = F.when(kind == name, steps) if out is None else out.when(kind == name, steps)
    return out


def has_entity(c: Column) -> Column:
    return matches(c, rules.HAS_ENTITY)


def needs_plan(c: Column) -> Column:
    low = F.lower(c)
    return (
        low.contains(" and ") | low.contains(" then ")
        | (low.contains("diagnose") & low.contains("config")) | (low.contains("explain") & low.contains("generate"))
    )


def normalize_label(c: Column, labels: list[str]) -> Column:
    """First known label inside a classifier reply, else ``followup``, else ``general``."""
    t = strip(F.regexp_replace(F.lower(strip(c)), r"\.+$", ""))
    out = None
    for label in labels:
        out = F.when(t.contains(label), label) if out is None else out.when(t.contains(label), label)
    return out.when(t.contains("follow"), "followup").otherwise("general")


def is_followup(c: Column, indicators=None) -> Column:
    return contains_any(F.lower(c), rules.FOLLOWUP_INDICATORS if indicators is None else indicators)


def _unfenced(c: Column) -> Column:
    t = strip(c)
    return F.when(t.startswith("```"), F.regexp_replace(F.get(F.split(t, "```"), F.lit(1)), "^json", "")).otherwise(t)


def json_array(c: Column, element: str) -> Column:
    """Objects of the JSON array between the first [ and the last ]; empty when absent or broken."""
    body = F.regexp_extract(_unfenced(c), r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), f"array<{element}>"),
                      F.array().cast(f"array<{element}>"))


def json_object(c: Column, schema: str, required: list[str]) -> Column:
    """Object between the first { and the last } when every required field is present; else null."""
    body = F.regexp_extract(_unfenced(c), r"(?s)\{.*\}", 0)
    keys = F.json_object_keys(F.when(F.try_parse_json(body).isNotNull(), body))
    complete = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), keys)) == 0
    return F.when(complete, F.from_json(body, schema))


def valid_steps(steps: Column, allowed: list[str], k: int = 6) -> Column:
    """Steps with a known tool, the first ``k``."""
    return F.slice(F.filter(steps, lambda s: s["tool"].isin(*allowed)), 1, k)


def known_only(labels: Column, allowed: list[str]) -> Column:
    return F.filter(labels, lambda x: x.isin(*allowed))


def normalize_domain(c: Column) -> Column:
    return F.translate(F.lower(c), " -", "__")


def keyword_list(c: Column) -> Column:
    """Comma-separated keywords as a list of stripped texts."""
    return F.transform(F.split(c, ","), strip)


def split_words(c: Column, min_len: int = 3, separators: str = "[_\\-\\s]+") -> Column:
    """Lower-cased words of at least ``min_len`` characters."""
    return F.filter(F.split(F.lower(c), separators), lambda w: F.length(w) >= min_len)


def keyword_words(keywords: Column, min_len: int = 3) -> Column:
    return F.array_distinct(F.flatten(F.transform(keywords, lambda k: split_words(k, min_len))))


def expand_keywords(keywords: Column, domain: Column, description: Column) -> Column:
    """Keywords, their parts, the words of the domain and the longer words of the description."""
    stop = rules.DESCRIPTION_STOPWORDS
    told = F.filter(F.split(F.lower(description), r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(*stop))
    return F.array_distinct(F.concat(
        F.transform(keywords, F.lower), keyword_words(keywords), split_words(domain, 3, "[_\\s]+"), told))
