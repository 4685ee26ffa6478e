"""Column functions on hand-made rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbook import rules
from signalbook.functions import answers, cleaning, entities, network, scoring, text
from signalbook.operators import chat, netops

STR = T.StringType()


def one(spark, expr, **values):
    """Value of an expression over one row of text (or typed) columns."""
    fields = [T.StructField(k, v[1] if isinstance(v, tuple) else STR) for k, v in values.items()]
    row = [v[0] if isinstance(v, tuple) else v for v in values.values()]
    return spark.createDataFrame([row], T.StructType(fields)).select(expr.alias("x")).first().x


def test_strip_is_unicode_and_keeps_inner(spark):
    assert one(spark, text.strip(F.col("a")), a=" \n a b\t ") == "a b"


def test_trailing_followups(spark):
    f = cleaning.strip_trailing_followups(F.col("a"))
    assert one(spark, f, a="Do X.\nWould you like more?") == "Do X."
    assert one(spark, f, a="Do X.\n\nHope this helps!\n\nAnything else?\n") == "Do X."
    assert one(spark, f, a="Do X.\n\n\n") == "Do X.\n\n\n"  # nothing matched: unchanged
    assert one(spark, f, a="Hope this helps!") == "Hope this helps!"  # never empty
    assert one(spark, f, a="I said: hope this helps") == "I said: hope this helps"  # filler only at line start
    assert one(spark, f, a="") == ""


def test_leading_restatement(spark):
    f = cleaning.strip_leading_restatement(F.col("u"), F.col("a"))
    q = "explain handover failure causes"
    for n, dropped in ((50, False), (51, True)):
        a = "handover failure causes explain:\n" + "x" * n
        assert one(spark, f, u=q, a=a) == ("x" * n if dropped else a)
    rest = "y" * 60
    assert one(spark, f, u="alpha beta gamma delta", a="alpha and beta here\n" + rest).startswith("alpha")  # 50 percent
    assert one(spark, f, u="what about cells", a="You asked about towers. " + rest) == rest
    assert one(spark, f, u="a b c", a="You asked this\n" + rest).startswith("You")  # no words of four letters
    assert one(spark, f, u="élève rapide", a="élève rapide\n" + rest) == rest  # accented words count


def test_filler_lines(spark):
    f = cleaning.drop_filler_lines(F.col("a"))
    assert one(spark, f, a="One\n  Happy to help!\nTwo") == "One\nTwo"
    assert one(spark, f, a="Happy to help!") == "Happy to help!"


def test_domain(spark):
    f = cleaning.infer_domain(F.col("u"), F.col("a"), F.col("c"))
    assert one(spark, f, u="", a="the AMF and the SMF", c="") == "Core"
    assert one(spark, f, u="", a="the AMF", c="") is None  # one match is not enough
    assert one(spark, f, u="", a="PRB and AMF, gNB and SMF", c=None) == "RAN"  # tie: earlier domain
    assert one(spark, f, u="", a="nothing here", c="core") is None  # hints need a match
    assert one(spark, f, u="", a="backhaul", c="transport") == "Transport"
    assert one(spark, f, u="", a="AMF", c="transport") == "RAN"  # "transport" also contains "ran"
    assert one(spark, cleaning.tag_domain(F.col("a"), F.lit("IMS")), a=" [Core] x") == " [Core] x"
    assert one(spark, cleaning.tag_domain(F.col("a"), F.lit("IMS")), a="x") == "[IMS] x"


def test_sentences(spark):
    assert one(spark, cleaning.sentences(F.col("a")), a="One. Two! three\n\nFour? 5") == ["One.", "Two! three", "Four?", "5"]


def test_chat_issue(spark):
    kind = T.ArrayType(T.StructType([T.StructField("role", STR), T.StructField("content", STR)]))
    issue = chat.chat_issue(F.col("m"))
    good = [("system", "s"), ("user", "u"), ("assistant", "a")]
    assert one(spark, issue, m=(good, kind)) is None
    assert one(spark, issue, m=(None, kind)) == "messages length=missing"
    assert one(spark, issue, m=(good[:2], kind)) == "messages length=2"
    assert one(spark, issue, m=([good[1], good[0], good[2]], kind)) == "wrong roles: ['user', 'system', 'assistant']"
    assert one(spark, issue, m=([*good[:2], ("assistant", "")], kind)) == "empty content"
    assert one(spark, chat.question(F.col("m")), m=([("user", " a "), ("user", "b")], kind)) == "a"
    assert one(spark, chat.last_user(F.col("m")), m=([("user", "a"), ("user", "b")], kind)) == "b"
    assert one(spark, chat.last_assistant_index(F.col("m")), m=(good, kind)) == 2
    swapped = one(spark, chat.with_answer(F.col("m"), F.lit("z")), m=(good, kind))
    assert [m.content for m in swapped] == ["s", "u", "z"]


def test_trigrams_and_jaccard(spark):
    assert one(spark, text.char_trigrams(F.col("a")), a=" AB ") == []
    assert sorted(one(spark, text.char_trigrams(F.col("a")), a="Abcd")) == ["abc", "bcd"]
    j = text.jaccard(text.char_trigrams(F.col("a")), text.char_trigrams(F.col("b")))
    assert one(spark, j, a="abcd", b="abcx") == 1 / 3 == one(spark, j, a="abcx", b="abcd")
    assert one(spark, j, a="ab", b="ab") == 0.0


def test_extract_answer(spark):
    f = answers.extract_answer(F.col("a"), F.lit(4))
    cases = {"2": 2, " 3) because": 3, "Answer: 1": 1, "the option  2": 2, "It is 9, so B": 1, "9": -1, "Answer: 7 or 2": -1,
             "maybe E": -1, "none": -1, "I pick (C).": 2, "": -1}
    for response, expected in cases.items():
        assert one(spark, f, a=response) == expected, response
    assert one(spark, answers.extract_digit(F.col("a"), F.lit(4)), a="I pick C") == -1
    assert one(spark, answers.extract_loose(F.col("a")), a="It is 9") == 9


def test_key_concepts(spark):
    f = answers.key_concepts(F.col("c"), F.col("e"))
    assert one(spark, f, c="The QoS flow of 5G-NR", e="flow uses qos") == ["qos", "flow", "5g-nr", "qos flow"]
    many = " ".join(f"word{i}" for i in range(30))
    assert len(one(spark, f, c=many, e="")) == 15
    cov = answers.concept_coverage(F.col("a"), F.split("k", ","))
    got = one(spark, cov, a="QOS flows", k="qos,flow,cell")
    assert (round(got.score, 3), got.found, got.missing) == (0.667, ["qos", "flow"], ["cell"])


def test_scores(spark):
    arr = T.ArrayType(STR)
    inc = scoring.score_incident(F.col("a"), F.col("d"), F.col("m"), F.col("n"))
    assert one(spark, inc, a="billing wap", d=None, m=([], arr), n=(["billing", "WAP"], arr)) == -1.0  # no floor
    assert one(spark, inc, a="RAN critical cause step", d="RAN", m=([], arr), n=([], arr)) == 1.0
    assert one(spark, inc, a="cpu", d="RAN", m=(["CPU"], arr), n=(None, arr)) == 0.5
    cfg = scoring.score_config(F.col("a"), F.col("m"))
    assert one(spark, cfg, a="a: b\nc", m=(["zz"], arr)) == 0.5
    assert one(spark, cfg, a="a: b\n" * 12, m=([], arr)) == 0.0  # repeated lines
    kn = scoring.score_knowledge(F.col("a"), F.col("m"))
    assert one(spark, kn, a="|" * 21 + " amf", m=(["AMF"], arr)) == 0.0
    assert one(spark, kn, a="amf " * 60, m=(["AMF", "smf"], arr)) == 0.0
    details = one(spark, scoring.score_details(F.col("a"), F.col("d"), F.col("m"), F.col("n")), a="cpu wap", d="RAN", m=(["CPU"], arr), n=(["WAP"], arr))
    assert details == {"domain": "wrong (expected RAN)", "contains_CPU": "true", "wrongly_contains_WAP": "true"}


def test_entities(spark):
    f = entities.extract_entities(F.col("a"))
    assert one(spark, f, a="compare SITE-METRO-001-S2, SITE-METRO-002-S1").cell_ids == ["SITE-METRO-001-S2", "SITE-METRO-002-S1"]
    assert one(spark, f, a="check SITE-METRO-001.").cell_id == "SITE-METRO-001"
    assert one(spark, f, a="SITE-A-1 or SITE-B-2 or SITE-A-1").site_ids == ["SITE-A-1", "SITE-B-2"]
    assert one(spark, f, a="cell 23 fails").cell_id == "23"
    assert one(spark, f, a="problem at 31203").cell_id == "31203"
    assert one(spark, f, a="5G at 120").cell_id is None
    assert one(spark, entities.skill_chain(F.col("a")), a="Config change?") == rules.SKILL_CHAINS["config_change"]
    assert one(spark, entities.normalize_label(F.col("a"), ["kpi", "incident"]), a=" It is a Follow-up. ") == "followup"
    assert one(spark, entities.normalize_label(F.col("a"), ["kpi", "incident"]), a="??") == "general"


def test_json(spark):
    f = entities.json_array(F.col("a"), "struct<tool:string>")
    for raw, n in {'```json\n[{"tool": "x"}]\n```': 1, 'ok [{"tool": "x"}, {"tool": "y"}] end': 2, '[{"tool":': 0, "": 0, "[]": 0}.items():
        assert len(one(spark, f, a=raw)) == n, raw
    steps = entities.valid_steps(f, rules.TOOLS, 2)
    assert len(one(spark, steps, a='[{"tool":"kpi_lookup"},{"tool":"rm"},{"tool":"alarm_query"},{"tool":"config_audit"}]')) == 2


def test_network(spark):
    assert one(spark, network.clamp_kpi("prb_utilization_dl_pct", F.col("a").cast("double")), a="123.45") == 100.0
    assert one(spark, network.clamp_kpi("erab_drop_rate_pct", F.col("a").cast("double")), a="-0.5") == 0.0
    esc = network.escalation(F.col("c").cast("double"), F.col("s"))
    assert [one(spark, esc, c=c, s="minor") for c in ("0.8", "0.6", "0.4", "0.39")] == ["auto_respond", "respond_with_caveat", "escalate", "refuse"]
    assert one(spark, esc, c="0.9", s="critical") == "escalate"
    assert one(spark, network.in_scope(F.col("a"), ["SITE-METRO-*"]), a="SITE-METRO-001") is True
    dev = netops.config_deviation(F.col("v"), F.col("s"))
    assert one(spark, dev, v="-95 dBm", s="-110 to -90 dBm") is False
    assert one(spark, dev, v="7 dB", s="2-5 dB") is True
    assert one(spark, dev, v="max_rate", s="proportional_fair / round_robin") is True
    ids = network.normalize_ids(F.col("c"), F.col("s"), F.lit(False), F.lit(True))
    assert one(spark, ids, c=" SITE-M-1-S1 , SITE-M-1-S2", s=None).site_id == "SITE-M-1"
    assert one(spark, ids, c="  ", s="X").asDict() == {"cell_id": None, "site_id": "X"}
    assert one(spark, ids, c="SITE-M-1", s=None).site_id == "SITE-M-1"


def test_stable_hash(spark):
    import hashlib

    expected = int(hashlib.md5(b"c-3-0").hexdigest()[:8], 16)
    assert one(spark, text.stable_hash(F.col("a"), F.lit(3), F.lit(0)), a="c") == expected
