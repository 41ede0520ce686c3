import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plenaria.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_collapse_and_no_value(spark):
    for given_, want in {" a \t\n b ": "a b", "": None, "None": None, "nan": None, " nan ": None, None: None, "None x": "None x"}.items():
        assert one(spark, given_, T.cleaned) == want


def test_topic_tokens(spark):
    got = one(spark, "De financiën van X2 en wet_a: Water, water! ab stemmen over klimaat", T.topic_tokens)
    assert sorted(got) == ["klimaat", "stemmen", "water"]
    assert one(spark, None, T.topic_tokens) == [] and one(spark, "", T.topic_tokens) == []


def test_overlap(spark):
    rows = [("water natuur bos", "bos water"), ("water", "water"), ("", "water"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(T.overlap(T.topic_tokens(F.col("a")), T.topic_tokens(F.col("b")), 2)).collect()]
    assert got == [True, False, False, False]


def test_attribution(spark):
    keep = "Minister Y zegt iets\nDan dit"
    cases = {
        "De heer X (VVD):\nVoorzitter. Dit": "Voorzitter. Dit",
        "Jan Jansen (A-B/c) :\nDit": "Dit",
        keep: keep,
        "x" * 118 + ":\nna": "na",
        "x" * 119 + ":\nna": "x" * 119 + ":\nna",
        "een regel": "een regel",
        "": "",
        None: None,
    }
    for given_, want in cases.items():
        assert one(spark, given_, T.without_attribution) == want
    assert one(spark, keep, T.flattened) == "Dan dit"
    assert one(spark, None, T.flattened) == ""
    assert one(spark, "  a\n b  c ", T.flattened) == "a b c"


def test_sentences(spark):
    assert one(spark, "Eén. Twee!  Drie? ", T.sentences) == ["Eén.", "Twee!", "Drie?"]
    assert one(spark, "geen einde", T.sentences) == ["geen einde"] and one(spark, None, T.sentences) == []


def test_stance_by_presence(spark):
    df = spark.createDataFrame([("de voorzitter voor voor",), ("STEM TEGEN",), ("niets",), (None,)], "t string")
    assert [tuple(r) for r in df.select(*T.stance(F.col("t"))).collect()] == [(1, 0), (0, 2), (0, 0), (0, 0)]


def test_small_ones(spark):
    assert one(spark, " a; ;b ", T.id_list) == ["a", "b"]
    assert one(spark, " TRUE ", T.truth) is True and one(spark, None, T.truth) is False and one(spark, "", T.truth) is False
    assert one(spark, "2021-2022", T.session_year) == 2021 and one(spark, "x", T.session_year) is None
    assert one(spark, "a b c\n", T.word_count) == 3 and one(spark, None, T.length) == 0
    assert one(spark, "Gent, België", lambda c: T.replaced(c, {", België": " (BE)"})) == "Gent (BE)"
    assert one(spark, None, lambda c: T.model_input(c, c, F.lit("abcdef"), (1, 1, 3))) == " </s>  </s> abc"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé'1_ .!?\n-", max_size=30)), min_size=1, max_size=20))
def test_words_and_sentences_equal_a_plain_regex(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", T.word_tokens(F.col("t")).alias("w"), T.sentences(F.col("t")).alias("s")).collect():
        t = texts[r.i] or ""
        assert r.w == re.findall(r"\b[\w']+\b", t)
        assert r.s == [p.strip() for p in re.split(r"(?<=[.!?])\s+", t) if p.strip()]
