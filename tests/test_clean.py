import datetime as dt

from plenaria.operators import clean


def test_whole_cleaning(spark):
    df = spark.createDataFrame(
        [(" AB ", " x  y ", "2014", "2020-01-01T00:00:00+02:00", "a", None, False), ("c", "nan", None, "2021-05-05", "2020-01-01", None, False)],
        "Id string, Naam string, Datum string, GewijzigdOp string, VervangerNaam string, Leeg string, Verwijderd boolean",
    )
    got = clean.preprocess(df)
    assert got.columns == ["Id", "Naam", "Datum", "GewijzigdOp", "VervangerNaam"]
    rows = sorted(got.collect())
    assert [r.Id for r in rows] == ["ab", "c"] and [r.Naam for r in rows] == ["x y", None]
    assert rows[0].Datum == dt.datetime(2014, 1, 1) and rows[1].Datum is None
    assert rows[0].VervangerNaam == "a"  # one value is no moment: the column stays text


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], "Id string, x int")
    assert clean.preprocess(empty).columns == ["Id", "x"]
    plain = spark.createDataFrame([(1,)], "x int")
    assert clean.standard_ids(plain).columns == ["x"] and clean.moments(plain).columns == ["x"]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "a int, `b.c` string")
    got = {r.kolom: (r.rijen, r.gevuld, r.leeg_pct, r.vooral_leeg) for r in clean.profile(df).collect()}
    assert got == {"a": (3, 3, 0.0, False), "b.c": (3, 1, 66.7, True)}


def test_summary_and_range(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 2),), (None,)], "d date")
    assert [tuple(r) for r in clean.summary({"x": df, "y": df.limit(0)}).collect()] == [("x", 2, 1), ("y", 0, 1)]
    assert tuple(clean.date_range(df, "d").first()) == ("2020-01-02", "2020-01-02")


def test_explore_and_mentions(spark):
    df = spark.createDataFrame([("A", "Voor", "2020-01-01", "Klimaat"), ("A", "Tegen", "x", None)], "fractie string, vote string, datum string, speech_text string")
    assert clean.explore(df, party="A", year=2020, keyword="klim.at").count() == 1
    assert clean.explore(df, rows=1).count() == 1
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(clean.mentions(F.col("speech_text"), "KLIM")).collect()] == [True, False]
