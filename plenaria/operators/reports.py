"""Counts, shares, pivots and rankings of the report panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n) by falling count, of equals by value; nulls do not count. ``top`` makes it a top-k."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(top) if top else out


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with the percentage of all non-null rows, rounded to one place."""
    c = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def crosstab(df: DataFrame, row: Column, column: str, values: list[str]) -> DataFrame:
    """Counts of ``column``'s values by ``row``, 0 where there are none; values are given, so no extra pass finds them."""
    return df.where(row.isNotNull()).groupBy(row.alias("row")).pivot(column, values).count().na.fill(0).select("row", *values)


def approval(df: DataFrame, by: str, vote: str = "vote") -> DataFrame:
    """Votes for and against by group and the percentage for."""
    t = crosstab(df, F.col(by), vote, ["Voor", "Tegen"])
    return t.withColumn("voor_pct", F.round(100.0 * F.col("Voor") / F.nullif(F.col("Voor") + F.col("Tegen"), F.lit(0)), 1))


def decades(df: DataFrame, moment: str, least: int = 1850) -> DataFrame:
    y = F.year(moment)
    return df.where(y >= least).groupBy((F.floor(y / 10) * 10).alias("decennium")).agg(F.count("*").alias("n")).orderBy("decennium")


def years(df: DataFrame, year: Column, first: int = 0, last: int = 9999) -> DataFrame:
    return df.where(year.between(first, last)).groupBy(year.cast("int").alias("jaar")).agg(F.count("*").alias("n")).orderBy("jaar")


def per_day(df: DataFrame, day: Column, what: str) -> DataFrame:
    """Distinct ``what`` per day: mean and most, and the number of days."""
    d = df.where(day.isNotNull()).groupBy(day.alias("dag")).agg(F.count_distinct(what).alias("n"))
    return d.agg(F.count("*").alias("dagen"), F.round(F.avg("n"), 6).alias("gemiddeld"), F.max("n").alias("meeste"))


def largest_groups(df: DataFrame, by: str, k: int) -> DataFrame:
    """All rows of the ``k`` groups with most rows, by a semi join with the ranking."""
    top = value_counts(df, by, k).select(F.col("value").alias("__v"))
    return df.join(top, F.col(by) == F.col("__v"), "left_semi")


def best_of(df: DataFrame, name: str, score: str) -> DataFrame:
    """The name with the highest score, of equals the smallest."""
    return df.agg(F.min(F.struct((-F.col(score)).alias("s"), name))[name].alias(name), F.max(score).alias(score))


def totals(df: DataFrame) -> DataFrame:
    """Key figures of the pairs: rows, speakers, parties, decisions, first and last day."""
    d = F.col("datum").try_cast("date")
    return df.agg(
        F.count("*").alias("paren"), F.count_distinct("persoon_id").alias("sprekers"), F.count_distinct("fractie").alias("fracties"),
        F.count_distinct("besluit_id").alias("besluiten"), F.date_format(F.min(d), "yyyy-MM-dd").alias("van"), F.date_format(F.max(d), "yyyy-MM-dd").alias("tot"),
    )
