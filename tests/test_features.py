import datetime as dt

import pytest
from pyspark.sql import functions as F

from plenaria.operators import features, metrics, reports


def test_majority_ties_nulls_and_empty_groups(spark):
    rows = [("a", "Voor"), ("a", "Tegen"), ("b", "Voor"), ("b", "Voor"), ("b", None), ("c", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    assert {r.k: r.majority for r in features.majority(df, ["k"], "v").collect()} == {"a": "Tegen", "b": "Voor", "c": None}
    assert {r.k: r.m for r in features.majority(df, ["k"], "v", "m", "Voor").collect()}["c"] == "Voor"


def test_split_is_disjoint_and_complete(spark):
    days = ["2021-12-31", "2022-01-01", "2022-12-31", "2023-01-01", None, "x"]
    df = spark.createDataFrame([(d,) for d in days], "datum string")
    assert {r.datum: r.split for r in features.split_by_year(df, "datum").collect()} == {"2021-12-31": "train", "2022-01-01": "val", "2022-12-31": "val", "2023-01-01": "test"}


VOTES = "persoon_id string, fractie string, besluit_id string, onderwerp string, vote string"
TRAIN = [("p", "A", "1", "t", "Voor"), ("q", "A", "1", "t", "Voor"), ("r", "A", "1", "t", "Tegen"), ("p", "A", "2", "u", "Tegen"), (None, "A", "2", "u", "Tegen"), ("p", None, "2", "u", "Voor")]


def test_loyalty_and_defaults(spark):
    train = spark.createDataFrame(TRAIN, VOTES)
    df = spark.createDataFrame([("p",), ("r",), ("nieuw",), (None,)], "persoon_id string")
    got = {r.persoon_id: r.speaker_loyalty for r in features.speaker_loyalty(train, df).collect()}
    assert got == {"p": 1.0, "r": 0.0, "nieuw": 0.5, None: 0.5}
    assert features.speaker_loyalty(train.limit(0), df).select("speaker_loyalty").distinct().first()[0] == 0.5


def test_history(spark):
    train = spark.createDataFrame(TRAIN, VOTES)
    df = spark.createDataFrame([("r", "A", "t"), ("x", "B", "t"), (None, None, None)], "persoon_id string, fractie string, onderwerp string")
    got = {r.persoon_id: r for r in features.history(train, df, "onderwerp").collect()}
    r = got["r"]
    assert (round(r.party_domain_voor_rate, 4), r.party_domain_vote_count, r.party_recent_voor_rate, r.speaker_topic_loyalty) == (0.6667, 3, 0.4, 0.0)
    assert tuple(got["x"])[3:] == (0.5, 0, 0.5, 0.5) and tuple(got[None])[3:] == (0.5, 0, 0.5, 0.5)


def test_enrich(spark):
    cases = spark.createDataFrame(
        [("Motie", "water natuur", None, "Ontraden"), ("Motie", "water", None, "Aangenomen"), ("Amendement", "natuur", "bos", None), ("Brief", "water natuur", None, "x")],
        "Soort string, Titel string, Onderwerp string, Kabinetsappreciatie string",
    )
    topics = ["water natuur", "een motie dus", "het amendement", "motie en amendement", "iets anders", "moti", "42424242", None, "natuur bos"]
    df = spark.createDataFrame([(t,) for t in topics], "t string")
    got = {r.t: (r.kabinetsappreciatie, r.zaak_soort, r.score) for r in features.enrich_topics(df, "t", cases).collect()}
    assert got == {
        "water natuur": ("Ontraden", "Motie", 2), "een motie dus": ("Onbekend", "Motie", 0), "het amendement": ("Onbekend", "Amendement", 0),
        "motie en amendement": ("Onbekend", "Motie", 0), "iets anders": ("Onbekend", "Onbekend", 0), "moti": ("Onbekend", "Onbekend", 0),
        "42424242": ("Onbekend", "Onbekend", 0), "": ("Onbekend", "Onbekend", 0), "natuur bos": ("Onbekend", "Amendement", 2),
    }


def test_coalition(spark):
    t = spark.createDataFrame([(2020, "A"), (2021, "B"), (2021, "B")], "jaar int, fractie string")
    df = spark.createDataFrame([(1, "A", "2020-05-01"), (2, "A", "2021-05-01"), (3, "A", None), (4, "B", "2021-01-01"), (5, "B", "2030-01-01"), (6, None, None)], "i int, fractie string, datum string")
    assert {r.i: r.is_coalition for r in features.in_coalition(df, t, "datum").collect()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0}


def test_sample_is_exact_and_the_same_whatever_the_partitions(spark):
    df = spark.range(1000)
    a, b = ({r.id for r in features.sample_exact(d, "id", 100).collect()} for d in (df, df.repartition(7)))
    assert a == b and len(a) == 100 and features.sample_exact(df, "id", 5000).count() == 1000


def test_scores(spark):
    rows = [("V", "V")] * 3 + [("V", "T")] + [("T", "T")] * 2 + [("N", "V")] + [("T", "X")] + [(None, "V")]
    df = spark.createDataFrame(rows, "t string, g string")
    got = {r.label: (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4), r.support) for r in metrics.report(df.where("t is not null"), "t", "g").collect()}
    assert got == {"V": (0.75, 0.75, 0.75, 4), "T": (0.6667, 0.6667, 0.6667, 3), "N": (0.0, 0.0, 0.0, 1), "X": (0.0, 0.0, 0.0, 0)}
    s = metrics.scores(df.where("t is not null"), "t", "g").first()
    assert round(s.accuracy, 4) == 0.625 and round(s.macro_f1, 4) == round((0.75 + 2 / 3) / 4, 4)
    assert metrics.agreement(df, "t", "g").first()[0] == pytest.approx(5 / 9)
    c = {r.label: (r.V, r.T) for r in metrics.confusion(df, "t", "g", ["V", "T"]).collect()}
    assert c == {"V": (3, 1), "T": (0, 2), "N": (1, 0)}


def test_published_confusion_is_consistent(spark):
    cells = [("Tegen", "Tegen", 13137), ("Tegen", "Voor", 5870), ("Voor", "Tegen", 7602), ("Voor", "Voor", 21412)]
    df = spark.createDataFrame(cells, "t string, g string, n int").select("t", "g", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    s = metrics.scores(df, "t", "g").first()
    assert (round(s.accuracy, 3), round(s.macro_f1, 3)) == (0.719, 0.711)
    r = {x.label: (round(x.precision, 3), round(x.recall, 3), round(x.f1, 3)) for x in metrics.report(df, "t", "g").collect()}
    assert r == {"Tegen": (0.633, 0.691, 0.661), "Voor": (0.785, 0.738, 0.761)}


def test_bands_and_weights(spark):
    df = spark.createDataFrame([(0.8, "a", "a"), (0.81, "a", "b"), (0.6, "a", "a"), (0.59, "b", "b"), (None, "b", "b")], "p double, t string, g string")
    got = {r.band: (r.n, r.accuracy, r.aandeel) for r in metrics.confidence_bands(df, "p", "t", "g").collect()}
    assert got == {"hoog": (1, 0.0, 0.25), "midden": (2, 1.0, 0.5), "laag": (1, 1.0, 0.25)}
    assert {r.t: round(r.weight, 4) for r in metrics.class_weights(df, "t").collect()} == {"a": 0.8333, "b": 1.25}
    e = features.confident(df, F.col("p"), F.lit("s"), F.lit("b"), 0.8)
    assert [r.ensemble for r in e.collect()] == ["s", "s", "b", "b", "b"]


def test_reports(spark):
    df = spark.createDataFrame([("a", "Voor"), ("a", "Tegen"), ("b", "Niet"), ("b", "Voor"), ("c", "Niet"), (None, "Voor")], "k string, vote string")
    assert [(r.value, r.n) for r in reports.value_counts(df, "k", 2).collect()] == [("a", 2), ("b", 2)]
    got = {r.row: (r.Voor, r.Tegen, r.voor_pct) for r in reports.approval(df, "k").collect()}
    assert got == {"a": (1, 1, 50.0), "b": (1, 0, 100.0), "c": (0, 0, None)}
    assert reports.largest_groups(df, "k", 1).count() == 2
    d = spark.createDataFrame([(dt.date(1849, 1, 1),), (dt.date(1850, 1, 1),), (dt.date(1999, 1, 1),), (None,)], "d date")
    assert [tuple(r) for r in reports.decades(d, "d").collect()] == [(1850, 1), (1990, 1)]
    s = spark.createDataFrame([("x", 0.5), ("w", 0.7), ("v", 0.7)], "m string, acc double")
    assert tuple(reports.best_of(s, "m", "acc").first()) == ("v", 0.7)


def test_weights_difficulty_and_averages(spark):
    """Mastered 0.3, plain 1, unsure 1.5, wrong 2 (also if sure or unsure), each halfway from the weight before, then by their mean."""
    rows = [("a", "a", 0.9), ("a", "a", 0.85), ("a", "a", 0.65), ("a", "a", 0.64), ("a", "b", 0.99), ("a", "b", 0.1), ("a", None, 0.9), ("a", "a", None)]
    df = spark.createDataFrame([(i, *r, 1.0) for i, r in enumerate(rows)], "i int, t string, g string, p double, w double")
    plain = [0.65, 1.0, 1.0, 1.25, 1.5, 1.5, 1.5, 1.25]
    got = [r.w for r in metrics.reweight(df, "t", "g", "p", "w").orderBy("i").collect()]
    assert [round(x, 9) for x in got] == [round(x * 8 / sum(plain), 9) for x in plain]
    assert {r.stand: r.n for r in metrics.difficulty(df, "t", "g", "p").collect()} == {"mastered": 2, "learning": 3, "struggling": 3}
    assert {r.stand: r.n for r in metrics.difficulty(df.limit(0), "t", "g", "p").collect()} == {"mastered": 0, "learning": 0, "struggling": 0}
    two = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "t string, g string")
    r = {x.label: x for x in metrics.full_report(two, "t", "g").collect()}
    assert set(r) == {"a", "b", "accuracy", "macro avg", "weighted avg"} and r["accuracy"].f1 == 0.75 and r["macro avg"].support == 4
    assert round(r["macro avg"].precision, 4) == round((1 + 2 / 3) / 2, 4) and round(r["weighted avg"].recall, 4) == 0.75


def test_fallbacks(spark):
    d = spark.createDataFrame([(i, "Voor" if i % 3 else None) for i in range(30)], "i int, vote string")
    assert features.validation(d, d.limit(0), "i", tail=5).count() == 5 and {r.i for r in features.validation(d, d.limit(0), "i", tail=2).collect()} == {29, 28}
    assert features.validation(d.limit(0), d, "i").count() == 20 and features.validation(d, d.where("i < 4"), "i", tail=50).count() == 20
    assert features.usable_or_all(d, labels=("Tegen",)).count() == 20 and features.usable_or_all(d, labels=("Voor",), least=20).count() == 20
    assert features.usable_or_all(d.limit(0)).count() == 0
