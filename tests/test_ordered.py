from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plenaria.functions.ordered import carry, index

ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 9))), max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS)
def test_carry_and_index_equal_a_plain_loop(spark, rows):
    unique = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    df = spark.createDataFrame(unique, "k string, t long, v int").selectExpr("*", "t div 7 as b")
    forward = {(r.k, r.t): r.o for r in carry(df, ["k"], "b", ["t"], {"o": "v"}).collect()}
    strict = {(r.k, r.t): r.o for r in carry(df, ["k"], "b", ["t"], {"o": "v"}, inclusive=False).collect()}
    back = {(r.k, r.t): r.o for r in carry(df, ["k"], "b", ["t"], {"o": "v"}, forward=False).collect()}
    place = {(r.k, r.t): (r.i, r.n) for r in index(df, ["k"], "b", ["t"], "i", "n").collect()}
    for k, t, _ in unique:
        own = sorted((x for x in unique if x[0] == k), key=lambda x: x[1])
        before = [x[2] for x in own if x[1] <= t and x[2] is not None]
        earlier = [x[2] for x in own if x[1] < t and x[2] is not None]
        after = [x[2] for x in own if x[1] >= t and x[2] is not None]
        assert forward[k, t] == (before[-1] if before else None)
        assert strict[k, t] == (earlier[-1] if earlier else None)
        assert back[k, t] == (after[0] if after else None)
        assert place[k, t] == ([x[1] for x in own].index(t), len(own))
    assert len(forward) == len(strict) == len(back) == len(place) == len(unique)


def test_carry_both_is_two_carries(spark):
    import random

    from plenaria.functions.ordered import carry, carry_both

    g = random.Random(4)
    rows = [(g.choice(["a", "b", None]), i // 7, i, g.choice([None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, b int, t int, v int")
    two = carry(carry(df, ["k"], "b", ["t"], {"p": "v"}), ["k"], "b", ["t"], {"n": "v"}, forward=False)
    assert sorted(map(str, carry_both(df, ["k"], "b", ["t"], "v", "p", "n").collect())) == sorted(map(str, two.collect()))
    assert carry_both(df.limit(0), ["k"], "b", ["t"], "v", "p", "n").count() == 0
