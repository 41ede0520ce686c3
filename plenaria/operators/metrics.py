"""Scores of predictions, all from one small confusion aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement(df: DataFrame, a: str, b: str, out: str = "accuracy") -> DataFrame:
    """Share of rows where a equals b; a null never does and stays in the denominator."""
    return df.agg(F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double")).alias(out))


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """Counts by true label (rows) and predicted label (columns)."""
    return df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("label")).pivot(guess, labels).count().na.fill(0)


def report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, f1 and support of every label that is true or predicted; undefined is 0."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    each = F.array(
        F.struct(F.col("t").alias("label"), F.lit(0).alias("guessed"), F.col("n").alias("support")),
        F.struct(F.col("g").alias("label"), F.col("n").alias("guessed"), F.lit(0).alias("support")),
    )
    hit = F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)
    parts = cells.select(F.inline(each), hit.alias("hit"), F.lit(0).alias("k"))
    # a hit is on both structs; it counts once, on the true side
    per = parts.groupBy("label").agg(F.sum("guessed").alias("guessed"), F.sum("support").alias("support"), F.sum(F.when(F.col("support") > 0, F.col("hit")).otherwise(0)).alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.where("label is not null").withColumns({"precision": ratio(F.col("hits"), F.col("guessed")), "recall": ratio(F.col("hits"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.withColumn("f1", f1).select("label", "precision", "recall", "f1", "support")


def full_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``report`` with the rows 'accuracy' (in f1, as reports print it), 'macro avg' and 'weighted avg'."""
    r = report(df, truth, guess)
    names = ("precision", "recall", "f1")
    n = F.sum("support")
    macro = r.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], n.alias("support"))
    weighted = r.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in names], n.alias("support"))
    none = F.lit(None).cast("double")
    hit = df.where(F.col(truth).isNotNull()).agg(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"), F.avg(F.coalesce(F.col(truth) == F.col(guess), F.lit(False)).cast("double")).alias("f1"), F.count("*").alias("support"))
    return r.unionByName(hit).unionByName(macro).unionByName(weighted)


def scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, macro f1 and support-weighted f1."""
    r = report(df, truth, guess)
    means = r.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return agreement(df, truth, guess).crossJoin(means)  # one row each


def by_group(df: DataFrame, keys: list[str], truth: str, guess: str, least: int = 20) -> DataFrame:
    """Rows, hits and accuracy of every group with at least ``least`` rows."""
    hit = F.coalesce(F.col(truth) == F.col(guess), F.lit(False)).cast("long")
    g = df.groupBy(*keys).agg(F.count("*").alias("total"), F.sum(hit).alias("correct")).where(F.col("total") >= least)
    return g.withColumn("accuracy", F.col("correct") / F.col("total"))


def confidence_bands(df: DataFrame, sure: str, truth: str, guess: str, high: float = 0.8, low: float = 0.6) -> DataFrame:
    """Share and accuracy above ``high``, below ``low`` and between."""
    s = F.col(sure)
    band = F.when(s > high, "hoog").when(s < low, "laag").when(s.isNotNull(), "midden")
    hit = F.coalesce(F.col(truth) == F.col(guess), F.lit(False)).cast("double")
    g = df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")).where("band is not null")
    return g.withColumn("aandeel", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class), over one row for each class."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return g.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def reweighted(correct: Column, sure: Column, before: Column, mastered: float = 0.3, uncertain: float = 1.5, wrong: float = 2.0, memory: float = 0.5) -> Column:
    """A sample's next weight, before ``normalised``: 1, less if the model is right and sure, more if it is unsure, most if it is wrong;
    smoothed with the weight before. What is not known to be right is wrong."""
    right = F.coalesce(correct, F.lit(False))
    now = F.when(~right, wrong).when(F.coalesce(sure, F.lit(0.0)) < 0.65, uncertain).when(sure > 0.85, mastered).otherwise(1.0)
    return memory * before + (1 - memory) * now


def reweight(df: DataFrame, truth: str, guess: str, sure: str, weight: str) -> DataFrame:
    """``df`` with its ``weight`` renewed by how well each sample is predicted, of mean 1."""
    w = reweighted(F.col(truth) == F.col(guess), F.col(sure), F.col(weight))
    return normalised(df.withColumn(weight, w), weight)


def difficulty(df: DataFrame, truth: str, guess: str, sure: str, high: float = 0.8) -> DataFrame:
    """(stand, n): how many samples are mastered (right and surer than ``high``), still learning (right) and struggling (wrong or unknown)."""
    right = F.coalesce(F.col(truth) == F.col(guess), F.lit(False))
    stand = F.when(~right, "struggling").when(F.col(sure) > high, "mastered").otherwise("learning")
    counted = df.agg(*[F.count_if(stand == k).alias(k) for k in ("mastered", "learning", "struggling")])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stand"), F.col(k).cast("long").alias("n")) for k in ("mastered", "learning", "struggling")])))


def normalised(df: DataFrame, weight: str) -> DataFrame:
    """``weight`` divided by its mean over all rows, so that the weights keep their sum; all zero stays zero."""
    mean = df.agg(F.avg(weight).alias("__mean"))
    w = F.when(F.col("__mean") != 0, F.col(weight) / F.col("__mean")).otherwise(F.col(weight))
    return df.crossJoin(F.broadcast(mean)).select(*[w.alias(c) if c == weight else F.col(c) for c in df.columns])  # one row
