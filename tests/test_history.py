import datetime as dt
import random

from plenaria.operators import history

S = "snapshot_id long, Id string, AantalZetels int, DatumActief timestamp, DatumInactief timestamp, ApiGewijzigdOp timestamp, entity string, bucket long"


def at(d):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=d)


def us(d):
    return round((at(d) - dt.datetime(1970, 1, 1)).total_seconds() * 10**6)


def brute(rows):
    one = {}
    for r in rows:
        if r[1] is not None and r[5] is not None:
            k = (r[1], r[5])
            if k not in one or one[k][0] < r[0]:
                one[k] = r
    out = []
    for i in {k[0] for k in one}:
        seq = [one[k] for k in sorted((k for k in one if k[0] == i), key=lambda k: k[1])]
        starts = [r for n, r in enumerate(seq) if n == 0 or r[2:5] != seq[n - 1][2:5]]
        for n, r in enumerate(starts):
            e = lambda t: round((t - dt.datetime(1970, 1, 1)).total_seconds() * 10**6)
            out.append((i, e(r[5]), e(starts[n + 1][5]) if n + 1 < len(starts) else -1))
    return sorted(out)


def test_random_against_a_loop(spark):
    g = random.Random(7)
    rows = [
        (n, g.choice(["a", "b", None]), g.choice([1, 2, None]), g.choice([at(0), None]), g.choice([None, None, at(900)]), g.choice([at(g.randrange(400)), None]), "x", 1)
        for n in range(250)
    ]
    got = sorted(tuple(r) for r in history.found(spark.createDataFrame(rows, S)).collect())
    assert got == brute(rows)


def test_null_is_a_value_and_the_highest_snapshot_counts(spark):
    rows = [
        (1, "a", 5, at(0), None, at(1), None, None),
        (9, "a", None, at(0), None, at(2), None, None),
        (8, "a", 5, at(0), None, at(2), None, None),
        (3, "a", 5, at(0), None, at(3), None, None),
        (3, "a", 5, at(0), None, at(3), None, None),
        (4, "a", 5, at(0), None, at(99), None, None),
    ]
    got = sorted((r.van_us, r.tot_us) for r in history.found(spark.createDataFrame(rows, S)).collect())
    assert got == [(us(1), us(2)), (us(2), us(3)), (us(3), -1)]


def test_empty(spark):
    assert history.found(spark.createDataFrame([], S)).count() == 0


def test_intervals_of_each_attribute(spark):
    rows = [(1, "a", 5, at(0), None, at(1), None, None), (2, "a", 6, at(0), None, at(2), None, None)]
    df = spark.createDataFrame(rows, S).selectExpr("*", "unix_micros(ApiGewijzigdOp) as at_us")
    from pyspark.sql import functions as F

    log = history.change_log(df, "Id", "at_us", {"AantalZetels": F.col("AantalZetels"), "DatumActief": F.unix_micros("DatumActief")})
    got = {(r.attribute, r.value, r.from_us, r.to_us) for r in history.intervals(log).collect()}
    assert got == {("AantalZetels", "5", us(1), us(2)), ("AantalZetels", "6", us(2), None), ("DatumActief", str(us(0)), us(1), None)}
