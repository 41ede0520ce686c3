import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from plenaria.operators import instants

NL, UTC = ZoneInfo("Europe/Amsterdam"), dt.timezone.utc


def civil(*a):
    """Microseconds of a Dutch civil time; a skipped time moves on by the hour."""
    t = dt.datetime(*a, tzinfo=NL)  # fold=0: the first of two; before a gap the old offset, which moves on
    return round((t.astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


def utc(*a):
    return round((dt.datetime(*a, tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


CASES = {
    "2022-11-23T10:15:10": civil(2022, 11, 23, 10, 15, 10),
    "13-01-2010 16:28": civil(2010, 1, 13, 16, 28),
    "05.02.2018 13:11": civil(2018, 2, 5, 13, 11),
    "  18-03-2019 11:00 ": civil(2019, 3, 18, 11),
    "05/01/2009 17:16": civil(2009, 1, 5, 17, 16),
    "06/24/2009 2:16 PM": civil(2009, 6, 24, 14, 16),
    "03/13/2014 12:22 PM": civil(2014, 3, 13, 12, 22),
    "03/13/2014 12:22 AM": civil(2014, 3, 13, 0, 22),
    "20091007T1045": civil(2009, 10, 7, 10, 45),
    "20100523": civil(2010, 5, 23),
    "2022/07/14 13:33": civil(2022, 7, 14, 13, 33),
    "1676376423": 1676376423 * 10**6,
    "1292853408692": 1292853408692 * 10**3,
    "/Date(1654159618023)/": 1654159618023 * 10**3,
    "/Date(1509972921312+0100)/": 1509972921312 * 10**3,
    "2020-02-17T19:53:59.5233780+05:30": utc(2020, 2, 17, 14, 23, 59, 523378),
    "2019-07-22T07:16:41.5894270-03:30": utc(2019, 7, 22, 10, 46, 41, 589427),
    "2017-01-09T09:07:34.765+01": utc(2017, 1, 9, 8, 7, 34, 765000),
    "2010-04-12T08:30:20z": utc(2010, 4, 12, 8, 30, 20),
    "2017-04-05 14:04 UTC": utc(2017, 4, 5, 14, 4),
    "23-03-2020 14:21 CET": utc(2020, 3, 23, 13, 21),
    "2021-07-05 11:40:25 CEST": utc(2021, 7, 5, 9, 40, 25),
    "2021-01-07T11:37:58[Europe/Amsterdam]": civil(2021, 1, 7, 11, 37, 58),
    "22-4-2011 13.12 uur": civil(2011, 4, 22, 13, 12),
    "29 maart 2009 2.06 uur": civil(2009, 3, 29, 2, 6),
    "25 aug. 2009, 16.02 uur": civil(2009, 8, 25, 16, 2),
    "maandag 17 augustus 2015 om 14.32 uur": civil(2015, 8, 17, 14, 32),
    "Mon, 09 Apr 2012 12:27:46 GMT": utc(2012, 4, 9, 12, 27, 46),
    "3 april 2013": civil(2013, 4, 3),
    "2014-10-26T02:30:00": civil(2014, 10, 26, 2, 30),
    "2012-02-29": civil(2012, 2, 29),
    None: None, "": None, "  ": None, "volgt": None, "-": None, "25:70": None, "2021-13-05": None, "31-04-2019 10:00": None,
    "29 februari 2015 11:00": None, "9999-12-31T00:00:00": None, "0001-01-01T00:00:00": None, "2020-01-01T24:00:00": None,
    "13/13/2014 1:00 PM": None, "x" * 100_000: None, "1900-02-29": None, "2020-01-01 10:00 " * 5_000: None,
}


def test_formats(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(CASES)], "t string, i int")
    got = {r.i: r.u for r in df.select("i", instants.utc_micros(F.col("t")).alias("u")).collect()}
    assert {k: got[i] for i, k in enumerate(CASES)} == CASES


def test_every_hour_of_the_changes(spark):
    texts, want = [], []
    for y in range(1997, 2037, 3):
        for m in (3, 10):
            for d in range(24, 32):
                for h in range(0, 5):
                    texts.append(f"{y}-{m:02}-{d:02}T{h:02}:30")
                    want.append(civil(y, m, d, h, 30))
    df = spark.createDataFrame(list(zip(texts, want)), "t string, w long")
    assert df.where(~instants.utc_micros(F.col("t")).eqNullSafe(F.col("w"))).count() == 0


def test_day_arithmetic(spark):
    days = spark.sql("select explode(sequence(date'0002-01-01', date'9998-12-31', interval 997 days)) d").selectExpr("d", "cast(year(d) as long) y", "cast(month(d) as long) m", "cast(day(d) as long) k")
    assert days.where(instants.days_from_civil(F.col("y"), F.col("m"), F.col("k")) != F.unix_date("d")).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_session_zone_does_not_matter(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2014-10-26T02:30:00",)], "t string")
        assert df.select(instants.utc_micros(F.col("t"))).first()[0] == CASES["2014-10-26T02:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tables_empty_repeated_and_with_extra_columns(spark):
    a = spark.createDataFrame([("x", "20100523", 1), ("x", "20100523", 1), (None, "20100523", 2), ("y", None, 3)], "Id string, Datum string, utc_us int")
    f = spark.createDataFrame([], "snapshot_id long, GewijzigdOp string")
    assert sorted((str(r.sleutel), r.utc_us) for r in instants.found(a, f).collect()) == [("None", civil(2010, 5, 23)), ("x", civil(2010, 5, 23))]
    assert instants.found(a.limit(0), f).count() == 0
    assert instants.normalise(a, "Datum").columns == ["Id", "Datum", "utc_us"]
