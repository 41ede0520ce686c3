"""Raw entity tables to clean, typed ones, and profiles of tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from plenaria.functions.text import cleaned

# Fixed value: parts of column names that mark a moment (found anywhere in the name, in any case).
MOMENT_NAMES = re.compile(
    "Datum|GewijzigdOp|ApiGewijzigdOp|Geboortedatum|Overlijdensdatum|DatumActief|DatumInactief|DatumSoort|Van|TotEnMet|"
    "Aanvang|Einde|DatumRegistratie|DatumVerzoek|DatumVergadering|Aangemaakt",
    re.IGNORECASE,
)


def drop_deleted_mark(df: DataFrame) -> DataFrame:
    return df.drop("Verwijderd")


def standard_ids(df: DataFrame) -> DataFrame:
    """Id in lower case without spaces; foreign keys stay as they are."""
    return df.withColumn("Id", F.lower(F.trim(F.col("Id").cast("string")))) if "Id" in df.columns else df


def clean_strings(df: DataFrame) -> DataFrame:
    """Every string column collapsed, with '', 'None' and 'nan' as null; other types stay."""
    return df.withColumns({f.name: cleaned(F.col(_q(f.name))) for f in df.schema if isinstance(f.dataType, StringType)})


def _is_moment(f: StructField) -> bool:
    return isinstance(f.dataType, StringType) and MOMENT_NAMES.search(f.name) is not None


def _seen(df: DataFrame) -> tuple[int, dict[str, int], set[str]]:
    """By one aggregate: rows, values of each column, and the string columns with a moment's name whose every value can be read."""
    names = [f.name for f in df.schema if _is_moment(f)]
    bad = [F.count_if(F.col(_q(c)).isNotNull() & F.col(_q(c)).try_cast("timestamp").isNull()).alias(f"b{k}") for k, c in enumerate(names)]
    got = df.agg(F.count("*").alias("n"), *[F.count(F.col(_q(c))).alias(f"c{k}") for k, c in enumerate(df.columns)], *bad).first()
    return got["n"], {c: got[f"c{k}"] for k, c in enumerate(df.columns)}, {c for k, c in enumerate(names) if got[f"b{k}"] == 0}


def _typed(df: DataFrame, readable: set[str]) -> DataFrame:
    return df.withColumns({c: F.col(_q(c)).try_cast("timestamp") for c in df.columns if c in readable})


def _filled(df: DataFrame, rows: int, values: dict[str, int]) -> DataFrame:
    return df if rows == 0 else df.select(*[F.col(_q(c)) for c in df.columns if values[c] > 0])


def moments(df: DataFrame) -> DataFrame:
    """String columns with a moment's name become timestamps if every value can be read; else they stay.

    One aggregate over all such columns decides; an all-null column counts as readable.
    """
    return _typed(df, _seen(df)[2]) if any(_is_moment(f) for f in df.schema) else df


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns without any value dropped, found by one aggregate; a table without rows keeps its columns."""
    return _filled(df, *_seen(df)[:2]) if df.columns else df


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the columns that cleaning may have dropped as empty, null and of the types given."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def preprocess(df: DataFrame, strings: bool = True, dates: bool = True, empty: bool = True) -> DataFrame:
    """The whole cleaning in its order; one pass over the table decides on types and empty columns together."""
    df = df.transform(drop_deleted_mark).transform(standard_ids)
    if strings:
        df = df.transform(clean_strings)
    if not df.columns or not (dates or empty):
        return df
    rows, values, readable = _seen(df)
    # a column is typed only if all its values stay, so what is empty does not change
    df = _typed(df, readable) if dates else df
    return _filled(df, rows, values) if empty else df


def profile(df: DataFrame) -> DataFrame:
    """Rows (kolom, rijen, gevuld, leeg_pct, vooral_leeg), one for each column, by one aggregate."""
    n = F.count("*").alias("n")
    counts = df.agg(n, *[F.count(F.col(_q(c))).alias(f"c{k}") for k, c in enumerate(df.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("kolom"), F.col("n").alias("rijen"), F.col(f"c{k}").alias("gevuld")) for k, c in enumerate(df.columns)])
    pct = F.round(100.0 * (F.col("rijen") - F.col("gevuld")) / F.greatest(F.col("rijen"), F.lit(1)), 1)
    return counts.select(F.inline(each)).withColumn("leeg_pct", pct).withColumn("vooral_leeg", F.col("leeg_pct") > 50)


def date_range(df: DataFrame, moment: str) -> DataFrame:
    """First and last day of a column as text."""
    return df.agg(F.date_format(F.min(moment), "yyyy-MM-dd").alias("van"), F.date_format(F.max(moment), "yyyy-MM-dd").alias("tot"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (tabel, rijen, kolommen) of several tables; row counts come from the files' footers."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rijen")).select(F.lit(name).alias("tabel"), "rijen", F.lit(len(df.columns)).alias("kolommen"))
        out = one if out is None else out.unionByName(one)
    return out


def active(df: DataFrame, ended: str, size: str) -> DataFrame:
    """Rows that have not ended and have a positive size."""
    return df.where(F.col(ended).isNull() & (F.col(size) > 0))


def without_status(df: DataFrame, status: str, unwanted: str) -> DataFrame:
    """Rows whose status is another one; a null status is another one."""
    return df.where(~F.col(status).eqNullSafe(F.lit(unwanted)))


def mentions(text: Column, part: str) -> Column:
    """Whether the text holds ``part`` in any case; null does not."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def explore(df: DataFrame, party: str | None = None, vote: str | None = None, year: int | None = None, keyword: str | None = None, rows: int | None = None) -> DataFrame:
    """The explorer's filters, each optional; the keyword is a regular expression over the speech."""
    if party:
        df = df.where(F.col("fractie") == party)
    if vote:
        df = df.where(F.col("vote") == vote)
    if year:
        df = df.where(F.year(F.col("datum").try_cast("date")) == year)
    if keyword:
        df = df.where(F.coalesce(F.col("speech_text").rlike(f"(?i){keyword}"), F.lit(False)))
    return df.limit(rows) if rows else df


def _q(c: str) -> str:
    return f"`{c}`"
