import random

import pytest

from pyspark.sql import functions as F

from plenaria.operators import asof

DAY = 86_400_000_000
FACTS = "entity string, version string, value string, known_us long, start long, finish long, seq int"


def brute(facts, entity, day):
    last = {}
    for f in sorted((f for f in facts if f[3] < day * DAY), key=lambda f: (f[3], f[6])):
        last[f[1]] = f
    ok = [f for f in last.values() if f[0] == entity and f[4] <= day and (f[5] is None or day <= f[5])]
    return max(ok, key=lambda f: (f[3], f[6]))[2] if ok else None


@pytest.mark.parametrize("period, rows", [(5, 10**6), (91, 0), (1000, 10**6)])
def test_random_against_a_loop(spark, period, rows):
    g = random.Random(period)
    facts = [
        (g.choice("ab"), str(g.randrange(6)), g.choice("xyz"), g.randrange(300) * DAY + n * g.choice([0, 1]), g.randrange(250), g.choice([None, 100, 200, 280]), n)
        for n in range(60)
    ]
    facts = list({(f[0], f[3]): f for f in facts}.values())  # no two at one moment
    events = [(n, g.choice(["a", "b", "c", None]), g.randrange(-20, 400), None) for n in range(200)]
    f = asof.effective(spark.createDataFrame(facts, FACTS), "entity", "version", "value", "known_us", "start", "finish", ["seq"])
    e = spark.createDataFrame(events, "id int, who string, day long, snapshot string")
    got = {r.id: r.out for r in asof.join(e, "who", "day", asof.known_state(f, period), "out", period, rows).collect()}
    assert got == {i: brute(facts, w, d) for i, w, d, _ in events}


def test_never_known_later(spark):
    facts = [("a", "1", "early", 10 * DAY, 0, None, 1), ("a", "1", "late", 20 * DAY + 1, 0, None, 2)]
    f = asof.effective(spark.createDataFrame(facts, FACTS), "entity", "version", "value", "known_us", "start", "finish", ["seq"])
    e = spark.createDataFrame([(d, "a", d) for d in (5, 10, 11, 20, 21)], "id int, who string, day long")
    got = {r.id: r.out for r in asof.join(e, "who", "day", asof.known_state(f), "out").collect()}
    assert got == {5: None, 10: None, 11: "early", 20: "early", 21: "late"}


def test_a_replaced_version_no_longer_counts(spark):
    facts = [("a", "1", "x", 0, 0, None, 1), ("a", "1", "x", 50 * DAY, 0, 60, 2)]
    f = asof.effective(spark.createDataFrame(facts, FACTS), "entity", "version", "value", "known_us", "start", "finish", ["seq"])
    e = spark.createDataFrame([(d, "a", d) for d in (30, 60, 61)], "id int, who string, day long")
    assert {r.id: r.out for r in asof.join(e, "who", "day", asof.known_state(f), "out").collect()} == {30: "x", 60: "x", 61: None}


PAIRS = "pair_id long, persoon_id string, fractie string, is_coalition int, datum string, Id string"
MEMBER = "Id string, Persoon_Id string, Fractie_Id string, Van timestamp, TotEnMet timestamp, GewijzigdOp timestamp, ApiGewijzigdOp timestamp"
COAL = "coalitie_id long, fractie_id string, is_coalition int, van timestamp, tot_en_met timestamp, bekend_op timestamp"


def test_found_with_nulls_repeats_and_nothing_known(spark):
    m = spark.sql("select 'm' Id, 'p' Persoon_Id, 'f' Fractie_Id, timestamp'2010-01-01' Van, cast(null as timestamp) TotEnMet, timestamp'2009-12-01' GewijzigdOp, timestamp'2009-12-01' ApiGewijzigdOp")
    c = spark.sql("select 1L coalitie_id, 'f' fractie_id, 1 is_coalition, timestamp'2010-01-01' van, cast(null as timestamp) tot_en_met, timestamp'2010-02-01 12:00:00' bekend_op")
    names = spark.createDataFrame([("f", "FF")], "Id string, Afkorting string")
    rows = [
        (1, "p", "FF", 0, "2010-01-15", "z"), (2, "p", "FF", 0, "2010-02-02", "z"), (3, "p", None, 1, "2010-02-02", None), (3, "p", None, 1, "2010-02-02", None),
        (4, "q", None, 0, "2010-02-02", None), (5, "q", "FF", 0, "2010-02-02", None), (6, None, "FF", 1, "2010-02-02", None), (7, "p", "GG", 1, "geen", None), (8, "p", "FF", None, "2010-02-02", None),
    ]
    got = sorted(tuple(r) for r in asof.found(spark.createDataFrame(rows, PAIRS), m, c, names).collect())
    assert got == [(2, "f", 1), (3, "f", 1), (5, "", 0), (8, "f", 1)]


def test_found_on_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (PAIRS, MEMBER, COAL, "Id string, Afkorting string")]
    assert asof.found(*empty).count() == 0
    one = spark.createDataFrame([(1, "p", "FF", 0, "2010-01-15", "z")], PAIRS)
    assert [tuple(r) for r in asof.found(one, *empty[1:]).collect()] == [(1, "", 0)]


def test_a_filler_date_makes_no_snapshots(spark):
    """An end in 9999 is open; one far year adds the periods of its own entity only."""
    facts = [(f"e{k}", None, "x", k * DAY, 0, 9_000, k) for k in range(60)]
    state = lambda rows: asof.known_state(asof.effective(spark.createDataFrame(rows, FACTS), "entity", None, "value", "known_us", "start", "finish", ["seq"]))
    plain = state(facts).count()
    assert state([*facts, ("e0", None, "y", DAY, 10, 2_932_896, 99)]).count() <= 2 * plain
    late = state([*facts, ("e0", None, "y", DAY, 2_932_800, None, 99), ("e1", None, "y", 2_932_800 * DAY, 10, None, 99)])
    assert late.count() == plain
    e = spark.createDataFrame([("e0", 8_999), ("e0", 9_001), ("e0", 2_932_896)], "who string, day long")
    assert [r.out for r in asof.join(e, "who", "day", state([*facts, ("e0", None, "y", DAY, 10, 2_932_896, 99)]), "out").orderBy("day").collect()] == ["y", "y", "y"]


def test_spans_cover_exactly(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a, 70, 3)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", asof._spans(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        held = [x for s in r.s for x in range(s.node << s.level, (s.node + 1) << s.level)]
        assert sorted(held) == list(range(r.a, r.b)) and len(r.s) <= 2 * 8


def test_plans_before_they_are_cut_have_no_multiplying_join(spark, monkeypatch):
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(asof, "cut", keep)
    empty = [spark.createDataFrame([], s) for s in (PAIRS, MEMBER, COAL, "Id string, Afkorting string")]
    plans.append(asof.found(*empty)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not [p for p in plans if "CartesianProduct" in p or "NestedLoop" in p]


def test_nothing_is_known_before_a_first_change_at_a_period_start(spark):
    facts = [("a", "1", "x", 9 * DAY, 10, None, 1)]
    f = asof.effective(spark.createDataFrame(facts, FACTS), "entity", "version", "value", "known_us", "start", "finish", ["seq"])
    e = spark.createDataFrame([(d, "a", d) for d in (-3, 9, 10, 400)], "id int, who string, day long")
    assert {r.id: r.out for r in asof.join(e, "who", "day", asof.known_state(f, 5), "out", 5).collect()} == {-3: None, 9: None, 10: "x", 400: "x"}
