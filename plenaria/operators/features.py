"""Features from the past of parties and speakers, learnt on the training years only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.text import length, stance, topic_tokens

UNKNOWN = "Onbekend"


def split_by_year(df: DataFrame, moment: str, train_to: int = 2021, test_from: int = 2023, out: str = "split") -> DataFrame:
    """train up to a year, test from a year, val between; rows without a readable day are dropped."""
    y = F.year(F.col(moment).try_cast("timestamp"))
    return df.withColumn(out, F.when(y <= train_to, "train").when(y >= test_from, "test").when(y.isNotNull(), "val")).where(F.col(out).isNotNull())


def usable(df: DataFrame, label: str = "vote", labels: tuple[str, ...] = ("Voor", "Tegen")) -> DataFrame:
    return df.where(F.col(label).isin(*labels))


def usable_or_all(df: DataFrame, label: str = "vote", labels: tuple[str, ...] = ("Voor", "Tegen", "Niet deelgenomen"), least: int = 100) -> DataFrame:
    """Rows with one of ``labels``; if there are fewer than ``least``, all rows with any label. The count stops at ``least``."""
    good = usable(df, label, labels)
    return good if good.limit(least).count() >= least else df.where(F.col(label).isNotNull())


def validation(train: DataFrame, val: DataFrame, order: str, label: str = "vote", least: int = 10, tail: int = 500) -> DataFrame:
    """The usable rows of ``val``; if there are fewer than ``least``, the last ``tail`` of ``train`` by ``order`` (a top-k, no full sort)."""
    good = usable(val, label)
    return good if good.limit(least).count() >= least else usable(train, label).orderBy(F.desc(order)).limit(tail)


def majority(df: DataFrame, keys: list[str], value: str, out: str = "majority", default: str | None = None) -> DataFrame:
    """The most frequent value of each group, of equals the smallest; nulls do not count.

    Counts are aggregated first, so a group's rows never meet in one task. A group without any
    value gets ``default``.
    """
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))["v"]
    got = n.groupBy(*keys).agg(best.alias(out))
    return got.withColumn(out, F.coalesce(out, F.lit(default))) if default is not None else got


def rate(value: Column) -> Column:
    """Share of rows where ``value`` holds; null does not."""
    return F.avg(F.when(value, 1.0).otherwise(0.0))


def attach(df: DataFrame, stats: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """``stats`` joined back on ``keys``; what is missing gets its default. Spark picks the join by the size of ``stats``.

    Columns of ``df`` with the names of ``defaults`` are replaced.
    """
    s = stats.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__s_{c}") for c in defaults])
    on = None
    for k in keys:
        c = F.col(k) == F.col(f"__{k}")
        on = c if on is None else on & c
    kept = [c for c in df.columns if c not in defaults]
    return df.join(s, on, "left").select(*kept, *[F.coalesce(F.col(f"__s_{c}"), F.lit(v)).alias(c) for c, v in defaults.items()])


def speaker_loyalty(train: DataFrame, df: DataFrame, out: str = "speaker_loyalty", neutral: float = 0.5) -> DataFrame:
    """Share of a speaker's votes that follow the majority of the party on the decision; ``neutral`` if unseen."""
    lines = majority(train.where("fractie is not null and besluit_id is not null"), ["besluit_id", "fractie"], "vote", "__line")
    own = train.where("persoon_id is not null").join(lines, ["besluit_id", "fractie"])
    loyal = own.groupBy("persoon_id").agg(rate(F.col("vote") == F.col("__line")).alias(out))
    return attach(df, loyal, ["persoon_id"], {out: neutral})


def history(train: DataFrame, df: DataFrame, topic: str) -> DataFrame:
    """Rates of the party in the topic, of the party overall and the speaker's loyalty in the topic, with their counts."""
    domain = train.groupBy("fractie", topic).agg(rate(F.col("vote") == "Voor").alias("party_domain_voor_rate"), F.count("*").alias("party_domain_vote_count"))
    party = train.groupBy("fractie").agg(rate(F.col("vote") == "Voor").alias("party_recent_voor_rate"))
    lines = majority(train.where(F.col("fractie").isNotNull() & F.col(topic).isNotNull()), ["fractie", topic], "vote", "__line", "Voor")
    loyal = train.where("persoon_id is not null").join(lines, ["fractie", topic], "left")
    loyal = loyal.groupBy("persoon_id", topic).agg(rate(F.col("vote") == F.col("__line")).alias("speaker_topic_loyalty"))
    out = attach(df, domain, ["fractie", topic], {"party_domain_voor_rate": 0.5, "party_domain_vote_count": 0})
    out = attach(out, party, ["fractie"], {"party_recent_voor_rate": 0.5})
    return attach(out, loyal, ["persoon_id", topic], {"speaker_topic_loyalty": 0.5})


def basic(df: DataFrame, text: str = "speech_text") -> DataFrame:
    """Length and counts of words for and against."""
    pro, contra = stance(F.col(text))
    return df.withColumns({"speech_length": length(F.col(text)), "n_voor": pro, "n_tegen": contra})


def in_coalition(df: DataFrame, table: DataFrame, moment: str, year_if_unknown: int = 2020, out: str = "is_coalition") -> DataFrame:
    """1 if (year, party) is in ``table`` (jaar, fractie), else 0; rows without a day count as ``year_if_unknown``."""
    y = F.coalesce(F.year(F.col(moment).try_cast("timestamp")), F.lit(year_if_unknown))
    t = table.select(F.col("jaar").alias("__y"), F.col("fractie").alias("__f")).distinct().withColumn("__in", F.lit(1))
    got = df.join(t, (y == F.col("__y")) & (F.col("fractie") == F.col("__f")), "left")
    return got.select(*[c for c in df.columns if c != out], F.coalesce("__in", F.lit(0)).alias(out))


def enrich_topics(topics: DataFrame, topic: str, cases: DataFrame, least: int = 2) -> DataFrame:
    """(topic, kabinetsappreciatie, zaak_soort, score) of each distinct topic by shared tokens with all cases.

    Cases are first counted by (token, appreciation, kind), so a token in a third of all cases is a
    few rows on that side; topics are distinct. Of equal scores the smallest pair counts. Below
    ``least`` the kind is read from the topic's own words; topics under five characters or without
    tokens stay unknown.
    """
    kinds = cases.where(F.col("Soort").isin("Motie", "Amendement"))
    text = F.trim(F.concat_ws(" ", F.coalesce("Titel", F.lit("")), F.coalesce("Onderwerp", F.lit(""))))
    index = kinds.select(
        F.explode(topic_tokens(text)).alias("w"), F.substring(F.coalesce("Kabinetsappreciatie", F.lit(UNKNOWN)), 1, 80).alias("ka"), F.col("Soort").alias("soort")
    ).groupBy("w", "ka", "soort").agg(F.count("*").alias("n"))
    distinct = topics.select(F.coalesce(topic, F.lit("")).alias("t")).distinct()
    tokens = distinct.where(F.length("t") >= 5).select("t", F.explode(topic_tokens(F.col("t"))).alias("w"))
    scores = tokens.join(index, "w").groupBy("t", "ka", "soort").agg(F.sum("n").alias("score"))
    best = scores.groupBy("t").agg(F.min(F.struct((-F.col("score")).alias("s"), "ka", "soort")).alias("b"))
    has = tokens.select("t").distinct().withColumn("__has", F.lit(True))
    low = F.lower("t")
    own = F.when(F.contains(low, F.lit("motie")), "Motie").when(F.contains(low, F.lit("amendement")), "Amendement").otherwise(UNKNOWN)
    good = -F.col("b")["s"] >= least
    return distinct.join(has, "t", "left").join(best, "t", "left").select(
        F.col("t").alias(topic),
        F.when(good, F.col("b")["ka"]).otherwise(UNKNOWN).alias("kabinetsappreciatie"),
        F.when(good, F.col("b")["soort"]).when(F.col("__has"), own).otherwise(UNKNOWN).alias("zaak_soort"),
        F.coalesce(-F.col("b")["s"], F.lit(0)).alias("score"),
    )


def party_baseline(train: DataFrame, df: DataFrame, default: str = "Voor", out: str = "baseline") -> DataFrame:
    """The party's majority vote of the training years."""
    return attach(df, majority(train.where("fractie is not null"), ["fractie"], "vote", out), ["fractie"], {out: default})


def confident(df: DataFrame, sure: Column, speech: Column, base: Column, threshold: float = 0.75, out: str = "ensemble") -> DataFrame:
    """The text model's prediction where it is sure enough, else the baseline's."""
    return df.withColumn(out, F.when(sure >= threshold, speech).otherwise(base))


def own_group_majority(df: DataFrame, keys: list[str], value: str, out: str = "majority") -> DataFrame:
    """Every row with the majority of its own group."""
    return attach(df, majority(df, keys, value, out), keys, {out: None})


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), drawn by a digest of a unique key: the same rows whatever the partitions.

    A distributed top-n; no full sort.
    """
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)
