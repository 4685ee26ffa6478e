"""Phrases, spelling variants and SimHash against brute force on hand-made and random rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalbook.llm import phrases, simhash, spelling
from signalbook.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "\n\t ", "a", "A b", "one two, three", "One  two\tthree. one two", "x" * 5000, "é É ßx", "a.b.c", "the same words again " * 40,
    "word " * 3000, "naïve Ärger × ÷ ŵord", "\x00 nul \x00", "日本 語",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts twice, a null id, a repeated row, clashing extra columns."""
    rows = [(i, t, None if i % 4 == 0 else "en", i) for i, t in enumerate(ODD + ODD)]
    rows += [rows[6], (None, "the same words again", "fr", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").withColumns({"a": F.lit(1), "word": F.lit("x"), "fp": F.lit(2)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- phrases ---------------------------------------------------------------------------------
def phrase_rows(rows, least, top, share):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in chosen.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        rows = []
        for p, a in chosen.items():
            if 100 * most[p] >= share * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("budget, run_words, part", [(2_000_000, 1_000_000, 4_000_000), (300, 700, 150)])
def test_phrases(spark, documents, odd, monkeypatch, budget, run_words, part):
    """Whole results, also with many groups, extended prefixes, short runs and texts cut into parts."""
    monkeypatch.setattr(phrases, "RUN_WORDS", run_words)
    monkeypatch.setattr(phrases, "_SLICE", part)
    both = documents.select("doc_id", "text", "lang").union(odd.select("doc_id", "text", "lang"))
    got = phrases.collocations(both, least=5, top=300, share=80, group_suffixes=budget)
    assert dict(got.dtypes) == dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint") | {"lang": "string", "phrase": "string"}
    want = phrase_rows([(r.lang, r.text) for r in both.collect()], 5, 300, 80)
    assert sorted(map(tuple, got.collect())) == want


def test_phrases_of_nothing(spark, empty):
    assert phrases.collocations(empty).collect() == []


def test_suffixes_of_a_piece_cut_by_a_run():
    """A run that ends inside a piece hands its last words on; nothing is counted twice or lost."""
    run = phrases.Run()
    run.add(b"a b. c d e f")
    words, counts, ids, tail = run.row(True)
    assert (words, counts, tail) == ([b"a", b"b", b"c", b"d", b"e", b"f"], [1, 1, 1, 0, 0, 0], 3)
    assert run.row(False)[1:] == ([1] * 6, ids, 0)
    done = phrases.Run()
    done.add(b"a b.")
    assert done.row(True)[3] == 0


# --- spelling --------------------------------------------------------------------------------
def spelling_rows(rows, shortest, least, factor, slips):
    c = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    n = {w: k for w, k in c.items() if len(w) >= shortest and k >= least}
    near = {w: [x for x in n if x != w and one_apart(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= factor * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def spelling_result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_spelling(spark, documents, odd):
    both = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = spelling.spelling_groups(both, shortest=4, least=2, factor=2, slips=7)
    assert spelling_result(got) == spelling_rows([tuple(r) for r in both.collect()], 4, 2, 2, 7)


def test_spelling_blocks(spark):
    """A cell of many words is cut into blocks; chains of forms are followed to their end."""
    rng = np.random.default_rng(3)
    words = ["prefix" + "".join(rng.choice(list("abé"), rng.integers(0, 5))) for _ in range(400)]
    words += ["chains"] * 5 + ["chainz"] * 30 + ["chaimz"] * 200 + ["shaimz"] * 1200
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    want = spelling_rows([(1, text)], 6, 1, 5, 0)
    assert next(r for r in want if r[0] == "chains")[1:3] == ("chainz", "shaimz")
    vocabulary = spelling.vocabulary(docs, 6, 1)
    near = {r.word: (r.n_near, r.near) for r in spelling.near_words(vocabulary, block=7).collect()}
    whole = {r.word: (r.n_near, r.near) for r in spelling.near_words(vocabulary).collect()}
    assert near == whole and {w: x[0] for w, x in near.items()} == {r[0]: r[4] for r in want if r[4]}
    assert spelling_result(spelling.spelling_groups(docs, 6, 1, 5)) == want


def test_spelling_of_nothing(spark, empty):
    assert spelling.spelling_groups(empty).collect() == []


def test_sliced_index():
    words = ["a", "", "ab", "abc", "abcd", "bbc", "bc", "acb", "abc" * 70]
    index = spelling.SlicedIndex(words)
    for w in [*words, "zzz", "abcde"]:
        assert {words[b] for b in spelling._bits(index.near(w))} == {x for x in words if x != w and one_apart(w, x)}


# --- simhash ---------------------------------------------------------------------------------
def fingerprint(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(values, radius):
    """The smallest index reachable from each value."""
    a, root = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_simhash(spark, documents, odd):
    both = documents.select("doc_id", "text").union(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = sorted(map(tuple, both.collect()), key=lambda r: (r[0] is None, r[0]))
    prints = [fingerprint(t, 4) for _, t in rows]
    root = groups_of(prints, 4)
    want = sorted(map(str, ((d, f"{p:016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, root))))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(both).collect()) == want


@pytest.mark.parametrize("radius, budget", [(4, 4_000_000), (4, 20_000), (2, 4_000_000)])
def test_ball_hashing(spark, radius, budget):
    """Families around common centres; a small budget extends the prefixes of dense ones."""
    rng = np.random.default_rng(7)
    found = {int(x) for x in rng.integers(0, 1 << 63, 50, dtype=np.uint64)} | {0, (1 << 64) - 1}
    for centre in list(found)[:20]:
        for _ in range(20):
            x = centre
            for p in rng.choice(64, rng.integers(1, 8), replace=False):
                x ^= 1 << int(p)
            found.add(x)
    values = sorted(found)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, budget)
    roots = {r.node: r.root for r in components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for x, r in zip(signed, groups_of(values, radius)):
        got[roots.get(x, x)].add(x)
        want[r].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_long_text_and_odd_radius(spark):
    text = " ".join(str(i % 977) for i in range(120_000)).encode()
    hashes = np.array(simhash.shingle_hashes(text, 4), np.uint64)
    assert simhash.fingerprints_of([text, b"", b"a b"], 4).tolist() == [
        int(simhash.majority(hashes, np.array([len(hashes)]))[0]), 0, xxhash.xxh64_intdigest(b"a b", 42)]
    with pytest.raises(ValueError):
        simhash.link_fingerprints(spark.createDataFrame([(1,)], "fp long"), 3)


def test_simhash_of_nothing(spark, empty):
    assert simhash.near_duplicates(empty).collect() == []
