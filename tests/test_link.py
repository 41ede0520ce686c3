import datetime as dt
import random


from plenaria.operators import dedup, link


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def tables(spark, speeches, votes):
    s = spark.createDataFrame(speeches, "ord long, persoon_id string, fractie string, activiteit_id string, activiteit_onderwerp string, activiteithoofd_onderwerp string, dag date, speech_text string")
    acts = spark.createDataFrame([("act", "Debat", "2020-01-01"), ("stem", "Stemmingen", "2020-01-02"), ("leeg", None, None)], "Id string, Soort string, Datum string")
    agenda = spark.createDataFrame([("a1", "act", "water en natuur"), ("a2", "stem", "Motie over schoon water"), ("a3", "stem", None)], "Id string, Activiteit_Id string, Onderwerp string")
    decisions = spark.createDataFrame(
        [("b1", "a1", "s", "x", "t"), ("b2", "a2", "s", "x", "t"), ("b3", "a3", "s", "x", "schoon water ook hier"), ("b4", "a2", "s", "x", "zonder stemmen")],
        "Id string, Agendapunt_Id string, StemmingsSoort string, BesluitSoort string, BesluitTekst string",
    )
    v = spark.createDataFrame(votes, "ord long, Besluit_Id string, Persoon_Id string, ActorFractie string, Soort string, FractieGrootte int, Vergissing boolean")
    return dict(speeches=s, activities=acts, agenda=agenda, decisions=decisions, votes=v)


VOTES = [
    (1, "b1", "p1", "A", "Voor", 1, False), (2, "b1", "p1", "A", "Tegen", 1, True), (3, "b1", None, "A", "Voor", 9, None), (4, "b1", None, "Bb", "Tegen", 5, None),
    (5, "b2", None, "A", "Voor", 9, None), (6, "b3", None, "A", "Tegen", 9, None),
]


def linked(spark, speeches, votes=VOTES):
    return {(r.persoon_id, r.besluit_id): r for r in link.pairs(link.link(**tables(spark, speeches, votes))).collect()}


def test_person_before_party_before_lower_case_and_the_last_vote_wins(spark):
    got = linked(spark, [(1, "p1", "A", "act", None, None, None, "x"), (2, "p2", "A", "act", None, None, None, "xx"), (3, "p3", "bB", "act", None, None, None, "x"), (4, "p4", "C", "act", None, None, None, "x")])
    assert {k: (r.vote, r.vote_is_individual, r.link_quality) for k, r in got.items()} == {
        ("p1", "b1"): ("Tegen", True, 1), ("p2", "b1"): ("Voor", False, 1), ("p3", "b1"): ("Tegen", False, 1),
    }


def test_by_day_needs_the_day_the_topic_and_no_activity(spark):
    t = "over schoon en veilig water"
    speeches = [
        (1, "p1", "A", None, t, None, day(1), "x"), (2, "p2", "A", "onbekend", t, None, day(0), "x"), (3, "p3", "A", None, t, None, day(2), "x"),
        (4, "p4", "A", None, "water", None, day(1), "x"), (5, "p5", "A", None, "schoon", "water", day(0), "x"), (6, "p6", "A", None, t, None, None, "x"),
    ]
    got = {k for k, r in linked(spark, speeches).items() if r.link_quality == 3}
    assert got == {("p1", "b2"), ("p1", "b3"), ("p2", "b2"), ("p2", "b3"), ("p5", "b2"), ("p5", "b3")}


def test_longest_speech_whatever_the_quality_and_unknown_persons_share(spark):
    t = "schoon water"
    speeches = [(1, None, "A", "act", None, None, None, "x"), (2, None, "A", "act", None, None, None, "xxx"), (3, None, "A", "act", None, None, None, "xxx"), (4, "p", "A", None, t, None, day(1), None)]
    got = linked(spark, speeches)
    assert got[(None, "b1")].speech_length == 3 and len([k for k in got if k[0] is None]) == 1 and got["p", "b2"].speech_length is None


def test_empty(spark):
    assert linked(spark, []) == {}
    assert linked(spark, [(1, "p1", "A", "act", None, None, None, "x")], []) == {}


def test_substantive(spark):
    t = "x" * 51
    rows = [(1, None, None, "A", t), (2, True, None, "A", t), (3, False, True, "A", t), (4, False, False, None, t), (5, False, False, "A", "x" * 50), (6, False, False, "A", None)]
    df = spark.createDataFrame(rows, "i int, is_voorzitter boolean, is_interruptie boolean, fractie string, speech_text string")
    assert [r.i for r in link.substantive(df).collect()] == [1]


def test_positions(spark):
    df = spark.createDataFrame([(n, g) for n, g in enumerate(["a", "a", None, "b", "a"])], "n long, g string")
    got = {r.n: r.speech_position for r in link.positions(df, "g", "n", bucket_rows=2).collect()}
    assert got == {0: 0.0, 1: 1 / 3, 4: 2 / 3, 3: 0.0, 2: None}


def test_coverage(spark):
    c, p = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "k string"), spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert tuple(link.coverage(c, "k", p, "k").first()) == (2, 1, 1, 1)


def test_keep_by_is_unique_and_best(spark):
    g = random.Random(3)
    rows = [(n, g.choice(["a", "b", None]), g.choice([None, 1, 2, 3]), "t") for n in range(60)]
    df = spark.createDataFrame(rows, "n long, k string, length int, x string")
    got = {r.k: (r.length, r.n) for r in dedup.keep_longest(df, ["k"], "length", "n").collect()}
    for k in {r[1] for r in rows}:
        length, minus = max((-1 if r[2] is None else r[2], -r[0]) for r in rows if r[1] == k)
        assert got[k] == (length if length >= 0 else None, -minus)
    assert len(got) == len({r[1] for r in rows})


def test_best_version(spark):
    rows = [(1, "m", "Casco"), (2, "m", "Ongecorrigeerd"), (3, "m", None), (4, None, "Casco"), (5, None, "x"), (6, "n", "vreemd"), (7, "n", "Casco"), (8, "o", "Casco"), (9, "o", "Casco")]
    from plenaria.plans.reference import VERSIONS

    df = spark.createDataFrame(rows, "i int, v string, s string")
    assert sorted(r.i for r in dedup.best_version(df, "v", "s", VERSIONS, "i").collect()) == [2, 4, 5, 7, 8]


def test_topics_meet_as_their_pairs_would(spark):
    import random

    g = random.Random(6)
    words = ["water", "dijk", "haven", "bodem", "school", "zorg"]
    topic = lambda: " ".join(g.sample(words, g.randrange(0, 5))) if g.random() < 0.9 else None
    s = spark.createDataFrame([(i, f"2021-03-0{g.randrange(1, 5)}" if i % 9 else None, topic(), topic()) for i in range(60)], "ord long, d string, activiteit_onderwerp string, activiteithoofd_onderwerp string").selectExpr("*", "cast(d as date) dag")
    d = spark.createDataFrame([(f"b{i}", f"2021-03-0{g.randrange(1, 5)}" if i % 7 else None, topic(), topic()) for i in range(40)], "besluit_id string, d string, Agendapunt_Onderwerp string, BesluitTekst string").selectExpr("*", "cast(d as date) stem_dag").drop("d")
    keys = lambda x: sorted(map(tuple, x.select("ord", "besluit_id", "link_quality").collect()))
    assert keys(link.by_topic(s, d, "dag")) == keys(link.on_topic(link.by_day(s, d, "dag"))) and keys(link.by_topic(s, d, "dag"))
