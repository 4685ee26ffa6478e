"""The training-data operators against brute force, libraries and hand-made rows."""

import hashlib
import os
import random
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from signalbook.llm import chat_format, exact_dedup, html_extract, language_id, line_dedup, neighbours, ngram_join
from signalbook.llm import chunks, packing, sentencepiece_codec, shingles, token_counts
from signalbook.llm.components import components

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "\n\t ", "a", "A", "a b", "  a  b \n c\t\td", "don't  <|endoftext|> x<|endoftext|>y we'll", "日本語 テキスト ééé \x1c a \x1f",
    "a " * 50 + " ", " lead", "x" * 3000, "a\n\nb \n\n c's 's 123abc ²³ ½", "the same line\nthe same line", "▁ marker ▁x", "word " * 4000,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, each twice under different ids, one row repeated, clashing extra columns."""
    rows = [(i, t, None if i % 4 == 0 else "en", f"s{i % 2}" if i % 5 else None, i) for i, t in enumerate(ODD + ODD)]
    rows.append(rows[3])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").withColumn("keys", F.lit(1)).withColumn("root", F.lit("x"))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_html_rules():
    page = """<!DOCTYPE html><body class="has-sidebar"><header><h1>Site</h1></header><div id=cookie-notice>We use cookies, please accept them all now.</div>
    <nav><ul><li><a href=/>Home</a><li><a>More</a></ul></nav><article><h1>A &amp; B</h1><p><b>First<br>para&nbsp;graph.<p>Short.<div class="ad">Buy the best things here today.</div>
    <ul><li>one<li>two</ul><script>var t="</p>";</script><section id=comments><p>I liked this article a lot, thank you.</p></section></article><aside><p>More to read.</p></aside><footer>c</footer>"""
    assert html_extract.main_text(page) == "A & B\nFirst para graph.\nShort.\none\ntwo"
    for broken in ("", None, "<", "<p", "</p></p>", "<a title='x>text", "<!-- open", "<script>x", "&amp;&#x0;", "<p>" * 2000 + "x"):
        assert isinstance(html_extract.main_text(broken), str)


def test_html_form_around_the_page():
    """A form that holds most of the text is a container; small forms and forms of labels stay outside."""
    text = "The council met on Tuesday to discuss the budget, and it took hours to agree on it."
    content = f"<div id=content><h1>Budget</h1><p>{text}</p><p>{text}</p></div>"
    for attributes in ("id=aspnetForm", "role=form"):
        page = f"<body><form {attributes}><div id=menu><a href=/>Home</a></div><nav><a href=/n>News</a></nav>{content}<div id=footer>Copyright by us.</div></form></body>"
        assert html_extract.main_text(page) == f"Budget\n{text}\n{text}"
    assert html_extract.main_text(f"<body>{content}<form><p>Tell us what you think of this page, we read it all.</p></form></body>") == f"Budget\n{text}\n{text}"
    assert html_extract.main_text("<body><form><label>Your name and full postal address.</label><label>Your telephone number, please.</label><p>Fill it in.</p></form></body>") == ""
    assert html_extract.main_text(f"<body><form hidden>{content}</form></body>") == ""


def test_html_foreign_and_preformatted():
    """Self-closed and nested svg swallow no text; formulas and xmp are text."""
    page = lambda x: f"<body><article><p>One two three four five.</p>{x}<p>Six seven eight nine ten.</p></article></body>"
    plain = "One two three four five.\nSix seven eight nine ten."
    for gone in ("<svg/>", "<svg width='4' />", "<math/>", "<svg><g><svg><text>a</text></svg><text>b</text></g></svg>", "<svg><svg/><text>a</text></svg>",
                 "<SVG><title>t</title><foreignObject><p>a</p></foreignObject></SVG>", "<div><svg><path d='M0'></div>", "<svg><path>",
                 "<svg><script>if (a<b && c>d) x</script><style><![CDATA[</svg> <p>]]></style></svg>", "<svg><!-- </svg> --><text>a</text></svg>"):
        assert html_extract.main_text(page(gone)) == plain, gone
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='x'>E = m\\frac</annotation></semantics></math>"
    assert html_extract.main_text(page(f"<p>It holds that {formula} for all of them.</p>")) == plain.replace("\n", "\nIt holds that E=m for all of them.\n")
    assert html_extract.main_text(page("<p>The page says.<xmp>use <b>bold</b> &amp; more of it.</XMP>")) == plain.replace(
        "\n", "\nThe page says.\nuse <b>bold</b> &amp; more of it.\n")
    assert html_extract.main_text("<article><p>One two three four five.</p><xmp>never <i>closed here.") == "One two three four five.\nnever <i>closed here."


def test_html_cut_is_minimal():
    """The flow's labels cost no more than any other labelling of a small page."""
    random.seed(3)
    for _ in range(30):
        n = 6
        lose, keep = [random.random() * 3 for _ in range(n)], [random.random() * 3 for _ in range(n)]
        joints = [(i, j, random.random()) for i in range(n) for j in range(i) if random.random() < 0.6]
        graph = html_extract.Flow(n + 2)
        for i in range(n):
            graph.add(n, i, lose[i])
            graph.add(i, n + 1, keep[i])
        for i, j, w in joints:
            graph.add(i, j, w, w)
        cost = lambda s: sum(keep[i] if s[i] else lose[i] for i in range(n)) + sum(w for i, j, w in joints if s[i] != s[j])
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(graph.reachable(n, n + 1)[:n]) == pytest.approx(best)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>One two three four five.</article>", 1), (1, "u", None, 2), (None, None, "", 3)], "page_id long, url string, html string, text int")
    assert sorted(r["n_chars"] for r in html_extract.extract(pages).collect()) == [0, 0, 24]
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_sentencepiece(odd, empty, documents):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text"))
    want = Counter((i, tuple(library.encode(t or ""))) for i, t in texts_of(docs))
    encoded = sentencepiece_codec.encode(docs, PIECES, verify=True)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    assert encoded.filter("not parity or not round_trip").count() == 0
    back = Counter((r["doc_id"], r["text"]) for r in sentencepiece_codec.decode(encoded, PIECES).collect())
    assert back == Counter((i, (t or "").replace("▁", " ")) for i, t in texts_of(docs))
    report = {(r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in sentencepiece_codec.codec_report(docs, PIECES).collect()}
    assert report == {(i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in want}
    assert sentencepiece_codec.codec_report(empty, PIECES).count() == 0


def test_line_dedup(spark, odd, empty):
    rows = [(i, f"own {i}\nshared line \nshared line\n\nend {i % 7}", "a" if i < 60 else "b", "x") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pages string")
    done = {r["doc_id"]: r for r in line_dedup.drop_site_lines(df, 0.2, 20).collect()}
    assert len(done) == 70 and done[3]["text"] == "own 3\n\nend 3" and done[3]["_lines_dropped"] == 2 and done[3]["pages"] == "x"
    assert done[65]["text"] == "own 65\n\nend 2"  # on all ten pages of a small host; its other lines are on few
    kept = line_dedup.drop_site_lines(odd, 0.1, 3)
    assert kept.count() == odd.count() and set(kept.columns) == {*odd.columns, "_lines_dropped"}
    assert line_dedup.drop_site_lines(empty).count() == 0


def test_line_dedup_small_hosts(spark):
    """Lines on all three pages of a host go, lines on two of three or on both pages of a host stay; texts are told apart by row."""
    rows = [(1, "menu\n a ", "x"), (1, "menu\nb\ntwice", "x"), (2, " menu \nc\ntwice\n", "x"), (3, "top\nd", "y"), (4, "top\ne", "y"),
            (5, "menu\nf", None), (6, None, None), (7, "menu\n a ", "x"), (7, "menu", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    done = sorted((r["doc_id"], r["text"] or "", r["_lines_dropped"]) for r in line_dedup.drop_site_lines(df).collect())
    assert done == sorted([(1, " a ", 1), (1, "b\ntwice", 1), (2, "c\ntwice\n", 1), (3, "top\nd", 0), (4, "top\ne", 0), (5, "menu\nf", 0), (6, "", 0), (7, " a ", 1), (7, "", 1)])
    with pytest.raises(ValueError):
        line_dedup.drop_site_lines(df.withColumn("__line_at", F.lit(1)))


def test_line_dedup_copies(spark):
    """Copies of a document are no boilerplate: the pipeline keeps one of them with its text."""
    import corpus_pipeline

    clean = "\n".join(f"line {k} of the clean document has words {k} {k + 1}" for k in range(6))
    rows = [(i, "the menu of the site\n" + (clean if i < 12 else f"own text {i} alone {i * 7} on page {i}"), "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = {r["pages"]: r["host_pages"] for r in line_dedup.site_lines(df).collect()}
    assert found == {19: 19}  # the menu, in 18 single texts and the copied one
    done = corpus_pipeline.lines(spark, df, SF)
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {i: t.split("\n", 1)[1] for i, t, *_ in rows}
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.near_duplicates(spark, done, SF).collect()}
    assert kept.keys() == {0, *range(12, 30)} and kept[0] == (clean, len(clean))


def test_token_counts(odd, empty, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    docs = odd.select("doc_id", "text").union(documents.select("doc_id", "text"))
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, BPE).collect())
    assert got == Counter((i, len((t or "").encode()), size(t or ""), size(t or "") > 512) for i, t in texts_of(docs))
    assert token_counts.token_counts(empty, BPE).count() == 0
    counter, random_ = token_counts.PrefixCounter(BPE), random.Random(1)
    for text in [t for t in ODD if t] + [t for _, t in texts_of(documents)[:3]]:
        text = text[:120]
        table = counter.table(text)
        for end in {0, len(text), *(random_.randint(0, len(text)) for _ in range(25))}:
            assert counter.tokens_at(text, table, end) == size(text[:end])
        best = counter.longest_prefix(text, table, 9)
        assert best == max(e for e in range(len(text) + 1) if size(text[:e]) <= 9)
    tables = token_counts.prefix_tables(odd, BPE).collect()
    assert len(tables) == odd.count() and all(r["counts"][0] == 0 for r in tables)
    assert token_counts.truncate(odd, BPE, 3).filter("n_tokens > 3").count() == 0


def test_token_prefixes():
    """Every prefix and every budget of odd texts, and long texts without lone spaces in little time."""
    import time

    from tokenizers import Tokenizer

    library, counter, rng = Tokenizer.from_file(BPE), token_counts.PrefixCounter(BPE), random.Random(9)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    parts = ["a", "th", "the", "'s", "'re", "'", "''", "don't", " 'll", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "!!", "<|endoftext|>", "\x1c", "\x85", " x", "ABC",
             "   \n ", "\u2028", "\xa0", "²", "\x00"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        table, want = counter.table(text), [size(text[:e]) for e in range(len(text) + 1)]
        assert [counter.tokens_at(text, table, e) for e in range(len(text) + 1)] == want, text
        for budget in range(max(want) + 2):
            assert counter.longest_prefix(text, table, budget) == max(e for e, n in enumerate(want) if n <= budget), (text, budget)
    for text in ("".join(rng.choice("etaoinshr") for _ in range(100_000)), "x" * 100_000, " " * 100_000, "日本" * 30_000, "a" + " " * 50_000 + "b"):
        start = time.process_time()
        table = counter.table(text)
        best = counter.longest_prefix(text, table, 500)
        assert size(text[:best]) == counter.tokens_at(text, table, best) <= 500
        assert time.process_time() - start < 5  # some tenths of a second


def test_exact_dedup(odd, empty):
    rows = texts_of(odd)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    size, keep = Counter(norm(t) for _, t in rows), {}
    for i, t in rows:
        keep[norm(t)] = min(i, keep.get(norm(t), i))
    want = Counter((i, keep[norm(t)], size[norm(t)], i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    for budget in (1, 1 << 20):
        assert Counter(map(tuple, exact_dedup.exact_owners(odd.repartition(3), budget).collect())) == want
    assert exact_dedup.exact_owners(empty).count() == 0


def test_trie():
    random_ = random.Random(2)
    keys = [bytes(random_.choices(b"ab", k=random_.randint(0, 9))) for _ in range(500)]
    trie, want = exact_dedup.Trie(), Counter(keys)
    for k in keys:
        trie.insert(k, (k, 1), lambda a, b: (a[0], a[1] + b[1]))
    assert list(trie.values()) == sorted(want.items())


def test_language(spark, odd, empty, documents):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(big, PIECES).join(big.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count() > 0
    rows = {r["doc_id"]: r for r in language_id.identify(odd, PIECES).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == "und" and rows[0]["score"] == 0.0
    assert language_id.identify(empty, PIECES).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}


def test_language_forward():
    """The recursion sums all segmentations."""
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    p = np.random.default_rng(1).random((len(pieces), 2))
    by_name = dict(zip(pieces, p))

    def total(word):
        return np.ones(2) if not word else sum((by_name[x] * total(word[len(x):]) for x in pieces if word.startswith(x)), np.zeros(2))

    words = ["▁ab", "▁ababa", "▁bbb", "▁a"]
    assert np.allclose(np.exp(language_id.Forward(pieces, p).log_likelihood(words)), [total(w) for w in words])


def test_language_long_pieces(spark):
    """No piece is left out for its length, neither in training nor in the sum; long words are not cut."""
    pieces = language_id.vocabulary(PIECES)
    assert "▁considered" in pieces and "▁administration" in pieces and max(map(len, pieces)) > 12
    rows = [(i, "considered it" if i % 2 else "taken it", "xy"[i % 2]) for i in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES)
    x, y = model.probabilities[pieces.index("▁considered")]
    assert y > 50 * x
    by_name = dict(zip(pieces, model.probabilities))
    longest, odd = max(map(len, pieces)), np.full(2, language_id._UNSEEN)

    def log_total(word):
        at = [np.zeros(2)]
        for end in range(1, len(word) + 1):
            found = [(s, by_name.get(word[s:end], odd if end - s == 1 else None)) for s in range(max(0, end - longest), end)]
            at.append(np.logaddexp.reduce([at[s] + np.log(p) for s, p in found if p is not None]))
        return at[-1]

    words = ["▁considered", "▁administrationeinwohner", "▁a", "▁" + "consideredadministration" * 60, "▁" + "x" * 900, "▁日本語" * 30]
    assert language_id.words_of("X" * 900) == ["▁" + "x" * 900]
    want = [log_total(w) for w in words]
    assert np.allclose(language_id.Forward(pieces, model.probabilities).log_likelihood(words), want)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "_PART", 100)
        assert np.allclose(language_id.Forward(pieces, model.probabilities).log_likelihood(words), want)


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[q : q + k]) for q in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_ngram_join(spark, monkeypatch, odd, k, num, den):
    """Families of near copies around the threshold, with cells cut into small blocks."""
    for name, value in (("BLOCK", 20), ("CROWD", 4), ("RUN_KEYS", 800)):
        monkeypatch.setattr(ngram_join, name, value)
    random_, words, rows = random.Random(k), [f"w{i}" for i in range(60)], []
    for _ in range(4):
        base = [random_.choice(words) for _ in range(random_.choice([12, 40, 90]))]
        for _ in range(35):
            copy = list(base)
            for _ in range(random_.randint(0, 4)):
                copy[random_.randrange(len(copy))] = random_.choice(words)
            rows.append((len(rows), " ".join(copy[: len(copy) - random_.choice([0, 0, 2])])))
    rows += [(1000 + i, t) for i, t in enumerate(ODD + ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(df, k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


def test_ngram_join_rows(odd, empty):
    assert ngram_join.similar_components(odd).count() == odd.count()
    assert ngram_join.similar_components(empty).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns and {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in odd.collect()}


def test_keep_one_tells_rows_apart(spark):
    """Of rows that share an id the texts decide: a copy goes, a text of its own stays, of equal rows one stays."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, one, "x"), (2, one, "y"), (2, two, "y"), (3, three, "b"), (3, three, "a"), (4, three + " more", "z"), (None, one, "n"), (5, None, "e"), (6, "", "e")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "doc_id long, text string, source string").repartition(3)
        kept = sorted(ngram_join.keep_one(df).collect(), key=str)
        assert kept == sorted((r for r in spark.createDataFrame([rows[0], rows[2], rows[5], rows[6], rows[7], rows[8]], df.schema).collect()), key=str)


def test_shingles_long_words(monkeypatch):
    text = b"one " + b"y" * 3_000_000 + b" two Three\tfour " + b"z z " * 400_000
    whole = shingles.word_hashes(text)
    assert len(whole) == 5 + 800_000 and whole[0] == shingles.word_hashes(b"ONE")[0] and whole[4] == shingles.word_hashes(b"four")[0]


def test_components(spark):
    random_ = random.Random(5)
    links = [(random_.randrange(200), random_.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(x):
        return x if root.setdefault(x, x) == x else find(root[x])

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_packing(odd, empty, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    docs = odd.dropDuplicates(["doc_id"]).select("doc_id", "text").union(documents.select(F.col("doc_id") + 10_000, "text")).repartition(3)
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in texts_of(docs)}
    rows = packing.pack(docs, BPE).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == ids.keys()
    for i, spans in list(by_doc.items()) + list(by_sequence.items()):
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i]) if spans is by_doc.get(i) else at <= 1024
    sizes = [sum(n for _, n in s) for s in by_sequence.values()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding <= 0.02 * sum(sizes)
    assert packing.pack(empty, BPE).count() == 0


def test_encoder_joins_chunks():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    seen: list[str] = []

    class Counting:
        def encode_batch_fast(self, strings, **options):
            seen.extend(strings)
            return library.encode_batch_fast(strings, **options)

    encoder = packing.IdEncoder(BPE)
    encoder._tokenizer = Counting()
    drawn = random.Random(3)
    words = ["".join(drawn.choices("abtheré日😀0.,'<|>\n", k=drawn.randint(1, 9))).strip() or "x" for _ in range(5000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 5000, 50)] + [t or "" for t in ODD] + ["x <|endoftext|> <|endoftext|>y z<|endoftext|>"]
    whole = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder(texts) == whole == encoder(texts)
    assert len(seen) < 1000  # one by one they are over 4000
    # Tokens that do not end where the chunks do: each chunk is encoded by itself.
    encoder = packing.IdEncoder(BPE)
    encoder._bytes[:] = 3
    assert encoder(texts) == whole


def test_encoder_meets_a_chunk_once():
    from tokenizers import Tokenizer

    encoder, library = packing.IdEncoder(BPE), Tokenizer.from_file(BPE)
    asked: list[str] = []

    class Counting(dict):
        def get(self, key, default=None):
            asked.append(key)
            return dict.get(self, key, default)

    encoder._memo._led, encode, computed = Counting(), encoder._memo._compute, []
    encoder._memo._compute = lambda chunks: computed.extend(chunks) or encode(chunks)
    texts = ["one two two, two. three's! été; 3, 3" * 50] * 40
    assert encoder(texts) == [np.array(library.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()] * 40
    assert len(asked) <= 10  # it was over 14,000, one for each occurrence
    assert len(computed) == len(set(computed)) and not {" two,", " two."} & set(computed)


def test_encoder_cuts():
    """Marks, letters outside the known ones, line breaks and runs of white space: the ids of the whole text."""
    from tokenizers import Tokenizer

    library, drawn = Tokenizer.from_file(BPE), random.Random(8)
    parts = ["foo", "Bar", "é", "ª", "ɐ", "ꟍ", "\n", "\n\n", " ", "  ", ".", ",", "!?", "'s", "'", "12", "½", "<|endoftext|>", "\r\n", "_", "日", " x", " y", "\x1c"]
    texts = ["".join(drawn.choices(parts, k=drawn.randint(0, 14))) for _ in range(4000)]
    assert packing.IdEncoder(BPE)(texts) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    firsts, keys, places, starts, ends = chunks.distinct_chunks(texts)
    keys = keys.to_pylist()
    assert len(keys) == len(set(keys))
    for i, text in enumerate(texts):
        assert [firsts[i]] + [" " + keys[p] for p in places[starts[i] : ends[i]]] == chunks.cut(text)
    assert packing.IdEncoder(BPE)([]) == [] and packing.IdEncoder(BPE)([""]) == [b""]


def test_no_shuffle_files_stay(tmp_path):
    """Finished steps leave no shuffle files to the garbage collection of the driver."""
    code = """
import pathlib, sys, time
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from pyspark.sql import functions as F
from signalbook.llm.components import components
from signalbook.session import local_session, materialize
spark = local_session("files", 2)
files = lambda: [p for p in pathlib.Path(sys.argv[2]).rglob("shuffle_*") if p.exists()]
def left():
    for _ in range(50):
        if not files():
            break
        time.sleep(0.2)
    return len(files())
grouped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
kept = materialize(grouped)
a = left()
links = components(spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
b = left()
print("left", a, b, "rows", sorted(map(tuple, grouped.collect())) == sorted(map(tuple, kept.collect())), links.filter("root = 0").count(),
      spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None))
"""
    env = os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[2]), str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "left 0 0 rows True 20 None" in done.stdout, done.stdout + done.stderr[-2000:]


def test_chat(spark):
    odd = ["\\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|end|>", "\\", "\\\\<|", "<", "<\\|", "é日本", "", None, "<|endoftext|> a", "x" * 5000]
    random_ = random.Random(4)
    rows = [(c, t, random_.choice(["user", "assistant", "system", None, "<|end|>"]), random_.choice(odd), 1) for c in range(12) for t in range(random_.randint(1, 9))]
    rows += [(99, t, "assistant", f"turn {t} \\<|", 1) for t in range(700)] + [(None, None, "user", "lost", 1)]
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(3)
    rendered = chat_format.render(df, BPE, part_chars=2000)
    got = {r["conv_id"]: r for r in chat_format.digests(rendered).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.render(df.filter("false"), BPE)).count() == 0


def brute_nearest(rows, k):
    ok = sorted({i: v for i, v in reversed(rows) if v and None not in v and np.isfinite(v).all() and any(v)}.items())
    x, ids, out = np.array([v for _, v in ok], float), np.array([i for i, _ in ok]), set()
    for n, i in enumerate(ids):
        if i % 10 == 0:
            d = np.sqrt(((x - x[n]) ** 2).sum(1))
            rest = [j for j in np.lexsort((ids, d)) if j != n][:k]
            out |= {(int(i), r, int(ids[j]), round(float(d[j]), 9)) for r, j in enumerate(rest, 1)}
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 360)]
    rows += [(400, None), (410, [0.0] * 8), (420, [1.0] * 7 + [None]), (430, [float("nan")] * 8), (440, [float("inf")] + [1.0] * 7), (450, []), (460, [1e-300] * 8), (470, [1e150] * 8)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, block int").repartition(3)
    queries = df.filter("vec_id % 10 = 0")
    for k, sizes in ((10, (16, 50, 4)), (1000, (512, 4096, 2))):
        got = neighbours.nearest(df, queries, k, query_block=sizes[0], vector_block=sizes[1], spans=sizes[2]).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got} == brute_nearest(rows, k)
    assert neighbours.nearest(df.filter("false"), queries).count() == 0
    assert neighbours.nearest(df, queries.filter("false")).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """Of rows that share an id the smallest vector counts, in whatever order they come."""
    rows = [(1, [0.0, 1.0]), (2, [5.0, 0.0]), (2, [1.0, 1.0]), (2, [None, 0.0]), (3, [4.0, 1.0]), (1, [0.0, 3.0])]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "vec_id long, embedding array<double>").repartition(3)
        got = neighbours.nearest(df, df.filter("vec_id = 1"), k=2).collect()
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 1.0), (2, 3, 4.0)]


def test_neighbour_bounds():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(40, 16)) * rng.lognormal(size=(40, 1)), rng.normal(size=(60, 16))
    low, high = neighbours.tile_bounds(neighbours.quantize(x), neighbours.quantize(y))
    real = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    assert (low <= real).all() and (real <= high).all()


def test_pipeline(spark):
    """The stages against brute force on the smallest tables."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    clean = corpus_pipeline.lines(spark, kept, SF)
    assert clean.columns == docs.columns and clean.count() == kept.count()
    roots = brute_components(texts_of(clean), 5, 80, 100)
    single = corpus_pipeline.near_duplicates(spark, clean, SF)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, r) in roots.items() if i == r}
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in single.collect()}
