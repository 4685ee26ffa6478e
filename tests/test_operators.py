"""Table operators on hand-made rows, including skewed groups."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbook.operators import dedup, dialog, documents, evidence, mix, netops, profile, registry, scans, similarity, skew
from signalbook.sources import chat as chat_io
from signalbook.sources import specs


def questions(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t) for i, t in enumerate(texts)], "row_id long, question string")


# --- two-level scans and skew helpers --------------------------------------------------------
def test_running_equals_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randint(0, 1), rng.choice([None, "x", "y"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v int, t string")
    got = scans.running(df, ["k"], ["i"], F.floor(F.col("i") / 7), sums={"s": F.col("v")}, lasts={"l": F.col("t")}, totals={"n": F.lit(1)})
    w = W.partitionBy("k").orderBy("i")
    want = df.select("*", F.sum("v").over(w).alias("s"), F.last("t", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("l"), F.count("*").over(W.partitionBy("k")).alias("n"))
    key = lambda d: sorted(map(str, d.select("k", "i", "s", "l", "n").collect()))
    assert key(got) == key(want)


def test_context_over_block_borders(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(40)], "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("agent", F.lit(None).cast("string"))
    old, dialog.BLOCK = dialog.BLOCK, 7
    try:
        rows = {r.turn: r.context for r in dialog.context_at_turn(turns).collect()}
    finally:
        dialog.BLOCK = old
    assert len(rows) == 40 and rows[0] == ""
    for i in range(1, 40):
        assert [x.split(": ")[1] for x in rows[i].split("\n")[1:]] == [f"t{j}" for j in range(max(0, i - 6), i)]


def test_key_stats_with_hot_keys(spark):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 100), ("cold", 101), ("one", 200)], "k string, i long")
    out = skew.attach_key_stats(df, ["k"], [F.min("i").alias("first")], hot_rows=10, keep=F.col("_rows") > 1)
    assert sorted((r.k, r.first) for r in out.collect()) == [("cold", 100)] * 2 + [("hot", 0)] * 50
    names = spark.createDataFrame([("hot", "h"), ("cold", "c")], "k string, name string")
    assert skew.join_lookup(df, names, "k", hot_rows=10).groupBy("name").count().count() == 2


# --- duplicates ------------------------------------------------------------------------------
def test_exact_and_removal(spark):
    q = questions(spark, ["What is X?", "  what is x? ", "other", "WHAT IS X?", ""])
    assert {(r.dup_row, r.first_row) for r in dedup.exact_dups(q).collect()} == {(1, 0), (3, 0)}
    once = dedup.dedup_exact(q)
    assert {r.row_id for r in once.collect()} == {0, 2, 4}
    assert dedup.dedup_exact(once).count() == once.count()


def test_chain_removes_both_later_rows(spark):
    base = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    a, b, c = base, base[:-3] + "xyz", base[:-6] + "uvwxyz"
    q = questions(spark, [a, b, c])
    near = similarity.near_dups(q, 0.9)
    pairs = {(r.row_i, r.row_j) for r in near.collect()}
    assert (1, 0) in pairs and (2, 1) in pairs
    assert [r.row_id for r in dedup.apply_dups(q, dedup.exact_dups(q), near).collect()] == [0]


def _far_apart(n):
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(n)]


def test_window_reaches_200_rows_back(spark):
    for gap, found in ((200, 1), (201, 0)):
        texts = _far_apart(gap + 1)
        texts[gap] = texts[0][:-1] + "!"
        assert similarity.near_dups(questions(spark, texts), 0.85).count() == found


def test_repeat_of_a_repeat_is_near(spark):
    pairs = similarity.near_dups(questions(spark, ["the same text", "the same text", "THE SAME TEXT"])).collect()
    assert [(r.row_i, r.row_j, r.sim) for r in pairs] == [(2, 1, 1.0)]  # (1,0) and (2,0) are exact pairs


def _grams(t):
    t = t.strip().lower()
    return {t[i:i + 3] for i in range(len(t) - 2)}


def _sim(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def _family():
    """Copies and near copies of one text for a third of the rows, short texts, and noise."""
    rng, out = random.Random(3), []
    stem = "".join(rng.choice("abcdefgh ") for _ in range(120))
    for i in range(180):
        if i % 3 == 0:
            at = rng.randrange(100)
            out.append(stem[:at] + rng.choice("xyz") + stem[at + 1:] if i % 2 else stem)
        else:
            out.append("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 2, 3, 5, 12, 80, 130]))))
    return out


def test_full_comparison_is_exact(spark):
    texts = _family()
    grams = [_grams(t) for t in texts]
    want = {i for i in range(len(texts)) if any(_sim(grams[i], grams[j]) >= 0.8 for j in range(i))}
    q = questions(spark, texts)
    assert {r.row_id for r in similarity.near_dups_all(q, 0.8).collect()} == want
    new, base = q.filter("row_id % 2 = 1"), q.filter("row_id % 2 = 0")
    want = {i for i in range(1, len(texts), 2) if not any(_sim(grams[i], grams[j]) >= 0.8 for j in range(0, len(texts), 2))}
    assert {r.row_id for r in similarity.dedup_against(new, base, 0.8).collect()} == want


def test_full_comparison_with_crowded_keys(spark):
    texts = sorted(set(t.strip().lower() for t in _family() if len(t.strip()) >= 3))
    grams = [_grams(t) for t in texts]
    want = {i for i in range(len(texts)) if any(_sim(grams[i], grams[j]) >= 0.8 for j in range(i))}
    df = spark.createDataFrame([(i, t, True, True) for i, t in enumerate(texts)], "uid long, text string, in_index boolean, in_probe boolean")
    got = similarity.rows_with_partner(df, 0.8, earlier_only=True, bucket_rows=3, hot_rows=20)
    assert {r.uid for r in got.collect()} == want


def test_full_comparison_moves_few_rows(spark, monkeypatch):
    """Long texts of one language share most of their parts; what is written stays a few rows a text, and exact over all sizes."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (60, 150, 160, 400, 420, 900) for _ in range(6)]
    for i in range(0, len(texts), 3):
        copy = texts[i].split()
        for at in rng.sample(range(len(copy)), max(1, len(copy) // (9 if i % 2 else 40))):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    grams = [_grams(t) for t in texts]
    want = {i for i in range(len(texts)) if any(_sim(grams[i], grams[j]) >= 0.8 for j in range(i))}
    assert want and len({similarity.sketch_words(len(g)) for g in grams}) > 2
    written, real = [], similarity.materialize

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(similarity, "materialize", counted)
    monkeypatch.setattr(similarity, "RANGE_ROWS", 10)
    assert {r.row_id for r in similarity.near_dups_all(questions(spark, texts), 0.8).collect()} == want
    assert sum(written) < 20 * len(texts)


def test_full_comparison_moves_no_text_per_pair(spark, monkeypatch):
    """Blocks of texts meet where they are written: between them and their comparison nothing is shuffled. Sets of more trigrams than 16 bits number, too."""
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    texts = ["".join(rng.choice(letters) for _ in range(900)) for _ in range(80)]
    for i in range(0, 80, 4):
        copy = list(texts[i])
        for at in rng.sample(range(900), 10 if i % 8 else 60):
            copy[at] = rng.choice(letters)
        texts.append("".join(copy))
    grams = [_grams(t) for t in texts]
    assert len(set().union(*grams)) > 1 << 16
    want = {i for i in range(len(texts)) if any(_sim(grams[i], grams[j]) >= 0.8 for j in range(i))}
    df = spark.createDataFrame([(i, t, True, True) for i, t in enumerate(texts)], "uid long, text string, in_index boolean, in_probe boolean")
    for bucket_rows in (1000, 9):
        plans, real = [], similarity.materialize
        with monkeypatch.context() as m:
            m.setattr(similarity, "materialize", lambda x: (plans.append(x._jdf.queryExecution().sparkPlan().toString()), real(x))[1])
            assert want and {r.uid for r in similarity.rows_with_partner(df, 0.8, earlier_only=True, bucket_rows=bucket_rows).collect()} == want
        (met,) = (p for p in plans if "CartesianProduct" in p)
        assert "Exchange" not in met.split("CartesianProduct")[1] and "RepartitionByExpression" not in met
        assert sum("MapInArrow _pack" in p for p in plans) == 1


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", min_size=3, max_size=40), st.text("abcd", min_size=3, max_size=40), st.sampled_from([0.5, 0.8, 0.85, 0.95]))
def test_similar_sets_share_a_key(a, b, t):
    x, y = similarity.trigram_codes(a), similarity.trigram_codes(b)
    sim = similarity.overlap_ratio(x, y)
    assert sim == similarity.overlap_ratio(y, x) == _sim(_grams(a), _grams(b))
    if sim >= t:
        assert set(similarity.part_keys(x, t)) & set(similarity.part_keys(y, t))
        import numpy as np

        differ = np.bitwise_count(similarity.parity_sketch(x) ^ similarity.parity_sketch(y)).sum()
        assert differ <= similarity.max_difference(len(x) + len(y), t)


def test_eval_overlap(spark):
    items = spark.createDataFrame([("Held Out?",)], "text string")
    kept = similarity.drop_eval_overlap(questions(spark, [" held out? ", "train"]), items)
    assert [r.row_id for r in kept.collect()] == [1]


# --- profiles, splits, quotas ----------------------------------------------------------------
def test_lengths(spark):
    df = spark.createDataFrame([(n,) for n in (499, 500, 99998, 99999)], "n long")
    assert [r.n for r in profile.length_buckets(df, "n").collect()] == [1, 1, 0, 0, 1]
    p = profile.length_profile(spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "n long"), "n").first()
    assert (p.min_len, p.p10, p.median, p.p90, p.max_len, p.mean_len) == (1, 1, 3, 4, 4, 2)


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(137).withColumnRenamed("id", "row_id")
    parts = mix.split(df)
    assert {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"train": 123, "val": 14}
    assert sorted(r.split_rank for r in parts.collect()) == list(range(137))
    assert sorted(r.row_id for r in mix.split(df).filter("part = 'val'").collect()) == sorted(r.row_id for r in parts.filter("part = 'val'").collect())
    both = mix.split_with_base(df, spark.range(1000, 1055).withColumnRenamed("id", "row_id"))
    assert both.filter("part = 'val'").count() == 5 and both.count() == 192
    assert mix.sample_k(df, 20, 1).count() == 20


def test_quota(spark):
    grid = spark.createDataFrame([(0, "a", 10), (1, "b", 5), (2, "c", 7)], "grid_pos int, topic string, target long")
    for existing, remaining in ((0, [10, 5, 7]), (12, [0, 3, 7]), (15, [0, 0, 7]), (99, [0, 0, 0])):
        rows = mix.quota_remaining(grid, F.lit(existing)).orderBy("grid_pos").collect()
        assert [r.remaining for r in rows] == remaining
    df = spark.createDataFrame([(i, "b" if i % 2 else "c") for i in range(40)], "row_id long, topic string")
    filled = mix.fill_quota(df, mix.quota_remaining(grid, F.lit(12))).groupBy("topic").count().collect()
    assert {r.topic: r["count"] for r in filled} == {"b": 3, "c": 7}
    shares = mix.apportion(spark.createDataFrame([("x",), ("y",), ("z",)], "p string"), 11, "p").orderBy("p").collect()
    assert [r.share for r in shares] == [4, 4, 3]


# --- network and agents ----------------------------------------------------------------------
def test_anomaly_hours_are_inclusive(spark):
    kpi = spark.createDataFrame([("c", h) for h in (7, 8, 22, 23)], "cell_id string, hour int")
    anomalies = spark.createDataFrame([("c", "x", 8, 22, "major")], "cell_id string, type string, start_hour int, end_hour int, severity string")
    rows = netops.flag_anomalies(kpi, anomalies).orderBy("hour").collect()
    assert [r.anomaly for r in rows] == [None, "x", "x", None]


def test_site_prefix_is_not_a_match(spark):
    changes = spark.createDataFrame([("S-1",), ("S-1-S2",), ("S-10-S1",)], "cell_id string")
    sites = spark.createDataFrame([("S-1",)], "site_id string")
    assert {r.cell_id for r in netops.changes_for_sites(changes, sites).collect()} == {"S-1", "S-1-S2"}


def test_verdicts(spark):
    cols = "inv_id string, tool string, error boolean, n_results long, n_degraded long, n_alarms long, n_changes long, has_overrides boolean"
    rows = [("empty", "kpi_lookup", False, 0, 0, 0, 0, False), ("failed", "kpi_lookup", True, 3, 0, 0, 0, False),
            ("partial", "kpi_lookup", False, 3, 1, 0, 0, False), ("full", "kpi_lookup", False, 3, 1, 0, 0, False),
            ("full", "config_audit", False, 0, 0, 0, 0, True)]
    got = {r.inv_id: r.verdict for r in evidence.evidence_verdict(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"empty": "NO_DATA", "failed": "NO_DATA", "partial": "PARTIAL_DATA", "full": "FULL_DATA"}


def test_promotion_is_sticky(spark):
    runs = spark.createDataFrame(
        [(i, 1, f"2024-01-01 00:0{i}:00", ok) for i, ok in enumerate([True, True, False, False, False])]
        + [(10, 2, "2024-01-01 00:00:00", True), (11, 2, "2024-01-02 00:00:00", False)], "run_id long, agent_id long, created_at string, success boolean"
    ).withColumn("created_at", F.to_timestamp_ntz("created_at"))
    agents = spark.createDataFrame([(1, "candidate"), (2, "candidate"), (3, "candidate"), (4, "disabled")], "agent_id long, status string")
    agents = agents.withColumn("created_at", F.lit("2023-01-01").cast("timestamp_ntz"))
    out = registry.lifecycle(agents, runs, F.lit("2024-02-01").cast("timestamp_ntz"))
    assert {r.agent_id: r.status for r in out.collect()} == {1: "active", 2: "candidate", 3: "pruned", 4: "disabled"}


# --- documents -------------------------------------------------------------------------------
def test_sections(spark):
    body = "w " * 60
    text = f"intro\n## One\n{body}\n### Two ##\nshort\n## A\n## B\n{body}\n## Last\n{'x' * 3000}"
    rows = documents.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.title, len(r.content)) for r in rows] == [("One", 119), ("Last", 2000)]


def test_chunks_cover_all_words(spark):
    df = spark.createDataFrame([(n, " ".join(str(i) for i in range(n))) for n in (1, 512, 513, 974, 975)], "doc_id long, text string")
    rows = documents.chunk(df).collect()
    counts = {n: sum(r.doc_id == n for r in rows) for n in (1, 512, 513, 974, 975)}
    assert counts == {1: 1, 512: 1, 513: 2, 974: 2, 975: 3}
    assert {w for r in rows if r.doc_id == 975 for w in r.chunk.split()} == {str(i) for i in range(975)}


def test_knn_in_several_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [i + 0.4, 0.0]) for i in range(9)], "query_id long, embedding array<double>")
    old, documents.QUERY_BLOCK = documents.QUERY_BLOCK, 4
    try:
        rows = documents.knn(queries, vectors, 2).orderBy("query_id", "rank").collect()
    finally:
        documents.QUERY_BLOCK = old
    assert [r.vec_id for r in rows] == [v for i in range(9) for v in (i, i + 1)]


# --- sources and sinks -----------------------------------------------------------------------
def test_chat_files(spark, tmp_path):
    good = {"messages": [{"role": "user", "content": "é?"}], "category": "x"}
    (tmp_path / "a.jsonl").write_text(json.dumps(good, ensure_ascii=False) + "\n\n{broken\n[1]\n" + json.dumps(good) + "\n", encoding="utf-8")
    rows = chat_io.read_chat(spark, str(tmp_path / "a.jsonl")).orderBy("row_id").collect()
    assert [(r.row_id, r.parse_ok, r.issue) for r in rows] == [(0, True, None), (1, False, None), (2, True, "not a dict"), (3, True, None)]
    assert rows[0].messages[0].content == "é?"
    chat_io.write_chat(chat_io.read_chat(spark, str(tmp_path / "a.jsonl")).filter("row_id = 0").select("messages", "category", "source"), str(tmp_path / "out"))
    written = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert json.loads(written) == good and "é" in written


def test_append_new_and_report(spark, tmp_path):
    target = str(tmp_path / "t")
    for rows in ([(1, "a"), (2, "b")], [(2, "again"), (3, "c")]):
        chat_io.append_new(spark.createDataFrame(rows, "id long, v string"), target, "id")
    assert {(r.id, r.v) for r in spark.read.parquet(target).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    chat_io.write_report(spark.createDataFrame([(1, 0.5)], "n long, share double"), str(tmp_path / "r"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("*.txt"))) == {"n": 1, "share": 0.5}


def test_spec_files(spark, tmp_path):
    (tmp_path / "Rel-15" / "38_series").mkdir(parents=True)
    (tmp_path / "Rel-15" / "38_series" / "38211.f40.md").write_bytes(b"text \xff end")
    (tmp_path / "top.md").write_text("t")
    (tmp_path / "x.TXT").write_text("no")
    rows = {r.filename: r for r in specs.read_specs(spark, str(tmp_path)).collect()}
    r = rows["38211.f40.md"]
    assert (r.release, r.series, r.spec, r.source) == ("Rel-15", "38_series", "38211.f40", "Rel-15/38_series/38211.f40.md")
    assert rows["top.md"].series == "unknown" and len(rows) == 2
    assert {r.extension: r.files for r in specs.file_inventory(spark, str(tmp_path)).collect()} == {".md": 2, ".txt": 1}


def test_csv_and_mcq(spark, tmp_path):
    (tmp_path / "bank.csv").write_text('archetype,question_preview\nx,"a, b"\ny,c\nx,d\n')
    rows = specs.load_scenarios(spark, str(tmp_path / "bank.csv")).orderBy("archetype", "pos").collect()
    assert [(r.archetype, r.pos, r.preview, r.n) for r in rows] == [("x", 0, "a, b", 2), ("x", 1, "d", 2), ("y", 0, "c", 1)]
    (tmp_path / "m.jsonl").write_text('{"question":"q","choices":["a","b"],"answer":1,"subject":"Lexicon"}\n')
    assert chat_io.read_mcq(spark, str(tmp_path / "m.jsonl"), "LEXICON").first().answer == 1
    assert chat_io.read_mcq(spark, str(tmp_path / "m.jsonl"), "other").count() == 0


def test_overnight_interval_flags_nothing(spark):
    kpi = spark.createDataFrame([("c", h) for h in (5, 12, 22)], "cell_id string, hour int")
    odd = spark.createDataFrame([("c", 22, 6, "x", "major"), ("c", 12, 12, "y", "minor")], "cell_id string, start_hour int, end_hour int, type string, severity string")
    from signalbook.operators import netops

    assert {(r["hour"], r["anomaly"]) for r in netops.flag_anomalies(kpi, odd).collect()} == {(5, None), (12, "y"), (22, None)}


def test_change_age_counts_fractions(spark):
    from signalbook.operators import netops

    alarms = spark.sql("SELECT 'a' AS alarm_id, 'c' AS affected_element, TIMESTAMP_NTZ'2024-01-01 00:00:10.9' AS raised_time, 1L AS event_id")
    changes = spark.sql("SELECT 'c' AS cell_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS time, 'p' AS param, 7L AS change_id")
    assert netops.correlate_changes(alarms, changes, 10).count() == 0
    assert netops.correlate_changes(alarms, changes, 11).first()["age_seconds"] == 10


def test_diff_of_one_sided_ids(spark):
    from signalbook.operators import evals

    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "id long, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.1), (4, 0.1)], "id long, score double")
    assert {(r["id"], r["kind"]) for r in evals.diff_results(a, b).collect()} == {(1, "only_old"), (2, "gains"), (3, None), (4, "only_new")}


def test_knn_without_queries_and_with_null_vectors(spark):
    from signalbook.operators import documents

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 1.0]), (8, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in documents.knn(queries, vectors, 3).collect()] == [(9, 1)]
    assert documents.knn(queries.filter("false"), vectors, 3).count() == 0


def test_spec_paths_with_odd_names(spark, tmp_path):
    folder = tmp_path / "c++ x"
    (folder / "R1" / "s 2").mkdir(parents=True)
    (folder / "R1" / "s 2" / "b#1+2.md").write_text("text")
    row = specs.read_specs(spark, str(folder)).collect()[0]
    assert (row["release"], row["series"], row["filename"], row["source"]) == ("R1", "s 2", "b#1+2.md", "R1/s 2/b#1+2.md")


def test_contained_items(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(1, f"Lead  words {item.upper()} and more"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, item)], "row_id long, question string")
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {tuple(r) for r in similarity.contained_items(docs, items).collect()}
    assert got == {(1, 7, 3, 3), (5, 7, 3, 3)}
    assert similarity.contained_items(docs.filter("false"), items).count() == 0
    assert similarity.contained_items(docs, items.filter("false")).count() == 0


def test_contained_items_without_comparing_all_ngrams(spark, monkeypatch):
    """n-grams of a text are made distinct by hash, not each against all, and stay in place beside few items; many items give the same."""
    item = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"x{i % 9000}" for i in range(18_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long} {item}"), (2, long), (2, item), (2, item)], "row_id long, question string")
    items = spark.createDataFrame([(7, item), (8, long), (8, long)], "item_id long, text string")
    want = [(1, 7, 13, 13), (1, 8, 18_000, 9000), (2, 7, 26, 13), (2, 8, 18_000, 9000)]
    for few in (200_000, 0):
        monkeypatch.setattr(similarity, "ITEM_GRAMS", few)
        got = similarity.contained_items(docs, items)
        plan = got._jdf.queryExecution()
        assert "array_distinct(transform" in plan.analyzed().toString() and "struct(a," not in plan.analyzed().toString()
        assert ("BroadcastHashJoin" in plan.executedPlan().toString()) or not few
        assert sorted(map(tuple, got.collect())) == want


def test_inventory(spark):
    df = spark.createDataFrame([("a/b.TXT", 3), ("a/c.txt", 4), ("a/.hidden", 1), ("d", None), (None, 2)], "p string, n long")
    got = {tuple(r) for r in specs.inventory(df, "p", "n").collect()}
    assert got == {(".txt", 2, 7), ("", 3, 3), (None, 5, 10)}
    assert [tuple(r) for r in specs.inventory(df.filter("false"), "p", "n").collect()] == []


def test_hot_words_are_salted(spark):
    """The hits are the same however few rows make a word hot."""
    from signalbook.operators import registry

    left = spark.createDataFrame([(i, w) for i in range(60) for w in (["the"] if i % 3 else ["the", "cell", f"w{i}"])], "q_id long, word string")
    right = spark.createDataFrame([(1, "the"), (2, "the"), (2, "cell"), (3, "none")], "agent_id long, word string")
    want = sorted((q, a) for q in range(60) for a in ([1, 2] if q % 3 else [1, 2, 2]))
    for rows in (1, 7, 100_000):
        assert sorted((r.q_id, r.agent_id) for r in registry._word_hits(left, right, rows).collect()) == want
