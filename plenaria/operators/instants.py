"""Texts in many date formats and zones to unambiguous UTC instants (problem 4).

Method: one regex alternation with named groups over all formats; a single replace extracts every
component at once, ranges are checked against the calendar, and the instant is put together by
integer day arithmetic. All of it is built-in expressions, so it runs in generated code and
shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Europe/Amsterdam"

# Month names and abbreviations, Dutch and English.
MONTHS = {
    "januari": 1, "january": 1, "jan": 1,
    "februari": 2, "february": 2, "feb": 2, "febr": 2,
    "maart": 3, "march": 3, "mrt": 3, "mar": 3,
    "april": 4, "apr": 4,
    "mei": 5, "may": 5,
    "juni": 6, "june": 6, "jun": 6,
    "juli": 7, "july": 7, "jul": 7,
    "augustus": 8, "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9,
    "oktober": 10, "october": 10, "okt": 10, "oct": 10,
    "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}

_S = r"[\s\x{A0}\x{202F}]"
_ZONES = rf"(?:{_S}*(?<z#>Z|UTC|GMT|CEST|CET|[+-]\d\d(?::?\d\d)?)?(?:\[Europe/Amsterdam\])?)?"
_CLOCK = rf"(?<h#>\d{{1,2}})[:.](?<i#>\d\d)(?:[:.](?<s#>\d\d)(?:[.,](?<f#>\d+))?)?(?:{_S}*uur)?"

#: One alternative for each family of formats; # stands for the number of the alternative.
FORMATS = [
    rf"(?<y#>\d{{4}})[-/.](?<m#>\d{{1,2}})[-/.](?<d#>\d{{1,2}})(?:(?:T|,?{_S}+(?:om{_S}+)?){_CLOCK})?{_ZONES}",
    rf"(?<y#>\d{{4}})(?<m#>\d\d)(?<d#>\d\d)(?:[T ](?<h#>\d\d):?(?<i#>\d\d)(?::?(?<s#>\d\d)(?:[.,](?<f#>\d+))?)?{_ZONES})?",
    rf"(?<m#>\d{{1,2}})[-/.](?<d#>\d{{1,2}})[-/.](?<y#>\d{{4}}),?{_S}+{_CLOCK}{_S}*(?<p#>[AP])\.?M\.?{_ZONES}",
    rf"(?<d#>\d{{1,2}})[-/.](?<m#>\d{{1,2}})[-/.](?<y#>\d{{4}})(?:,?{_S}+(?:om{_S}+)?{_CLOCK})?{_ZONES}",
    rf"(?:\p{{L}}+\.?,?{_S}+)?(?<d#>\d{{1,2}})[-{_S[1:-1]}]+(?<n#>\p{{L}}+)\.?[-{_S[1:-1]}]+(?<y#>\d{{4}})(?:,?{_S}+(?:om{_S}+)?{_CLOCK})?{_ZONES}",
    r"(?<e#>-?\d{9,10})",
    r"(?<k#>\d{12,13})",
    r"/Date\((?<k#>-?\d{1,15})(?:[+-]\d{4})?\)/",
]

#: Components in the order of the template below.
PARTS = "ymdnhisfpzek"


def pattern() -> str:
    """The alternation of all formats, anchored, with numbered group names."""
    alternatives = [f.replace("#", str(k)) for k, f in enumerate(FORMATS)]
    return rf"(?i)\A{_S}*(?:" + "|".join(alternatives) + rf"){_S}*\z"


def template() -> str:
    """Replacement that writes every component once: groups that took no part are empty."""
    def of(part: str) -> str:
        return "".join(f"${{{part}{k}}}" for k, f in enumerate(FORMATS) if f"(?<{part}#>" in f)

    return "\u0001" + "\u0001".join(of(p) for p in PARTS)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integers only (years from 1 on)."""
    def div(a: Column, n: int) -> Column:
        return F.floor(a / F.lit(n)).cast("long")

    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = div(yy, 400)
    yoe = yy - era * 400
    doy = div((m + F.when(m > 2, -3).otherwise(9)) * 153 + 2, 5) + d - 1
    doe = yoe * 365 + div(yoe, 4) - div(yoe, 100) + doy
    return era * 146097 + doe - 719468


def utc_micros(text: Column, zone: str = ZONE) -> Column:
    """Microseconds since 1970 UTC that ``text`` denotes, or null.

    Without zone the text is civil time of ``zone``: of a time that occurs twice the first counts,
    a skipped one moves on by the hour skipped, a day without time is its 00:00. Figures with the
    year last are day first, with AM/PM month first. Null, empty or unreadable texts, impossible
    dates and the filler years 1 and 9999 give null; long texts fail at the anchor.
    """
    got = F.split(F.regexp_replace(text, pattern(), template()), "\u0001")
    whole = F.when((F.size(got) == len(PARTS) + 1) & (F.get(got, F.lit(0)) == ""), got)
    # each step is bound once and used by every part of the next
    numbers = F.transform(F.array(whole), _numbers)
    return F.transform(numbers, lambda n: _assemble(n, zone))[0]


def _numbers(g: Column) -> Column:
    """The components as numbers; the zone as minutes, null for civil time and -9999 for one that cannot be."""
    part = {p: F.get(g, F.lit(k + 1)) for k, p in enumerate(PARTS)}

    def number(p: str) -> Column:
        return part[p].try_cast("long")

    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    z = F.upper(part["z"])
    digits = F.regexp_replace(z, "[^0-9]", "")
    hours = F.substring(digits, 1, 2).try_cast("long")
    minutes = F.coalesce(F.substring(digits, 3, 2).try_cast("long"), F.lit(0))
    offset = (
        F.when(z == "", None)
        .when(z.isin("Z", "UTC", "GMT"), 0)
        .when(z == "CET", 60)
        .when(z == "CEST", 120)
        .when((hours <= 18) & (minutes <= 59), (hours * 60 + minutes) * F.when(z.startswith("-"), -1).otherwise(1))
        .otherwise(-9999)
    )
    return F.struct(
        number("y").alias("y"),
        F.coalesce(number("m"), F.when(part["n"] != "", F.try_element_at(names, F.lower(part["n"]))).cast("long")).alias("m"),
        number("d").alias("d"),
        *[F.coalesce(number(p), F.lit(0)).alias(p) for p in "his"],
        F.coalesce(F.rpad(F.substring(part["f"], 1, 6), 6, "0").try_cast("long"), F.lit(0)).alias("f"),
        F.lower(part["p"]).alias("p"),
        offset.alias("z"),
        F.coalesce(number("e") * 1_000_000, number("k") * 1000).alias("epoch"),
    )


def _assemble(n: Column, zone: str) -> Column:
    y, m, d, h0, i, s = (n[c] for c in "ymdhis")
    h = F.when(n["p"] == "", h0).when((h0 < 1) | (h0 > 12), F.lit(99)).otherwise(h0 % 12 + F.when(n["p"] == "p", 12).otherwise(0))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = (y > 1) & (y < 9999) & m.between(1, 12) & (d >= 1) & (d <= length) & (h <= 23) & (i <= 59) & (s <= 59) & F.coalesce(n["z"] != -9999, F.lit(True))
    local = (((days_from_civil(y, m, d) * 24 + h) * 60 + i) * 60 + s) * 1_000_000 + n["f"]
    civil = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))
    return F.when(n["epoch"].isNotNull(), n["epoch"]).when(valid, F.when(n["z"].isNull(), civil).otherwise(local - n["z"] * 60_000_000))


def normalise(df: DataFrame, text: str, out: str = "utc_us", zone: str = ZONE) -> DataFrame:
    """``df`` with the instant of column ``text`` in ``out``; other columns stay, a clashing ``out`` is replaced."""
    return df.withColumn(out, utc_micros(F.col(text), zone))


def denoted(df: DataFrame, text: str, out: str = "utc_us") -> DataFrame:
    """``df`` with the instant of ``text``, without the rows that denote none.

    The rows are left out by an explode, as a filter on the instant would compute it a second time.
    """
    return df.select("*", F.explode(F.filter(F.array(utc_micros(F.col(text))), lambda u: u.isNotNull())).alias(out))


def found(activiteit: DataFrame, fractie: DataFrame) -> DataFrame:
    """Distinct (tabel, sleutel, utc_us) of every row whose text denotes an instant.

    Rows without key are kept with a null key; re-delivered rows come out once.
    """
    a = activiteit.select(F.lit("activiteit").alias("tabel"), F.col("Id").alias("sleutel"), F.col("Datum").alias("t"))
    f = fractie.select(F.lit("fractie").alias("tabel"), F.col("snapshot_id").cast("string").alias("sleutel"), F.col("GewijzigdOp").alias("t"))
    return denoted(a.unionByName(f), "t").select("tabel", "sleutel", "utc_us").distinct()
