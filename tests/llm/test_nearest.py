import random

import pytest

from plenaria.llm import nearest

L, R = "id long, e string, t long, out string", "rid string, e string, t long"


@pytest.mark.parametrize("bucket", [3, 50, 10_000])
def test_random_against_a_loop(spark, bucket):
    g = random.Random(bucket)
    left = [(n, g.choice(["a", "b", None]), g.choice([None, g.randrange(300)]), "x") for n in range(150)]
    right = [(g.choice([None, f"r{n}"]), g.choice(["a", "b", None]), g.choice([None, g.randrange(300)])) for n in range(40)]
    got = {r.id: (r.m, r.m_us) for r in nearest.nearest(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ("e", "e"), ("t", "t"), "rid", "m", 20, bucket).collect()}
    for i, e, t, _ in left:
        c = [(abs(rt - t), rt, rid) for rid, re_, rt in right if None not in (e, t, rt, rid) and re_ == e and abs(rt - t) <= 20]
        assert got[i] == ((min(c)[2], min(c)[0]) if c else (None, None))
    assert len(got) == 150


def test_ties_limits_and_columns(spark):
    left = spark.createDataFrame([(1, "a", 100, "x"), (1, "a", 100, "x"), (2, "a", 121, "x")], L)
    right = spark.createDataFrame([("q", "a", 80), ("p", "a", 80), ("p", "a", 80), ("n", "a", 120)], R)
    got = nearest.nearest(left, right, ("e", "e"), ("t", "t"), "rid", "m", 20)
    assert got.columns == ["id", "e", "t", "out", "m", "m_us"]
    assert sorted((r.id, r.m, r.m_us) for r in got.collect()) == [(1, "p", 20), (1, "p", 20), (2, "n", 1)]


def test_found(spark):
    s = spark.sql("select 1L speech_id, 'v' vergadering_id, timestamp'2020-01-01 10:00:00' verg_date, 'eigen' activiteit_id union all select 2L, 'v', timestamp'2020-01-01 11:30:00', null union all select 3L, null, null, null")
    a = spark.createDataFrame([("x", "v", "2020-01-01T11:45"), ("y", "v", "volgt"), ("z", "v", "2020-01-01 09:15 UTC"), ("z", "v", "2020-01-01 09:15 UTC"), ("w", None, None)], "Id string, Vergadering_Id string, Datum string")
    # 09:15 UTC is 45 minutes before 10:00; 11:45 Dutch time is 10:45 UTC, 45 minutes before 11:30
    assert sorted(tuple(r) for r in nearest.found(s, a).collect()) == [(1, "z"), (2, "x")]
    assert nearest.found(s.limit(0), a).count() == 0 and nearest.found(s, a.limit(0)).count() == 0
