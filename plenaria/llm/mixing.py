"""A training mixture with target shares of tokens by source (problem 9).

Method: every source has a weight that changes over training time and integrates to its target; a
document's cumulative tokens within its source are inverted through the integrated schedule to the
moment at which they are due, and the mixture is range-sorted by that moment. Cumulative tokens come
from two-level prefix sums, so a source with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenaria.llm import tokens
from plenaria.runtime import bounded, cut

#: Sources with a target: one row each.
MAX_SOURCES = 100_000
#: Buckets of one source in the prefix sums: at least so many, and so many texts in one.
BUCKETS, TEXTS_PER_BUCKET = 512, 100_000


@dataclass(frozen=True)
class Plan:
    """What a source contributes: its target among the sources that have texts, and its tokens in the mixture."""

    source: str
    target: float
    share: float
    natural: float
    available: int
    repeats: int
    demand: float


def distinct_texts(documents: DataFrame, folder: str, name: str) -> DataFrame:
    """One row (source, doc_id, n_tokens) for each distinct text: that of its smallest doc_id.

    A text published under several ids or sources thus counts once for the cap. Null and empty texts
    have no tokens and are left out. Only digests are shuffled, pre-aggregated.
    """
    sized = tokens.count(documents.where("text is not null and text != ''").select("doc_id", "source", "text"), "text", "n_tokens", folder, name)
    digests = sized.select("doc_id", "source", "n_tokens", F.sha2("text", 256).alias("digest"))
    one = digests.groupBy("digest").agg(F.min_by(F.struct("source", "doc_id", "n_tokens"), "doc_id").alias("v"))
    return one.select("digest", "v.*").where("n_tokens > 0")


def plan(texts: DataFrame, targets: DataFrame) -> list[Plan]:
    """The largest mixture that gives every source with texts its share without exceeding any cap.

    Targets of sources without texts cannot be reached; the others keep their proportions. Sources
    without target take no part. Null or non-positive targets and caps count as none.
    """
    want = bounded(targets.groupBy("source").agg(F.max("doel_aandeel").alias("t"), F.max("max_herhaling").alias("m")), MAX_SOURCES, "the list of targets")
    # within the bound that has just been looked at
    have = {r["source"]: int(r["n"]) for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(targets.select("source").distinct()), "source").collect()}
    rows = [(r["source"], float(r["t"] or 0), max(int(r["m"] or 0), 0), have.get(r["source"], 0)) for r in want if r["source"] is not None]
    live = [r for r in rows if r[1] > 0 and r[2] > 0 and r[3] > 0]
    total = sum(r[1] for r in live)
    size = min((n * m / (t / total) for _, t, m, n in live), default=0.0)
    stock = sum(n for _, _, _, n in live)
    out = []
    for s, t, m, n in sorted(rows):
        on = (s, t, m, n) in live
        share = t / total if on else 0.0
        out.append(Plan(s, t, share, n / stock if on else 0.0, n, m, share * size))
    return out


def tilt(plans: list[Plan]) -> float:
    """How far the schedule leans from natural proportions at the start to the reverse at the end, so that no weight is negative."""
    return min([1.0, *(0.999 * p.share / abs(p.natural - p.share) for p in plans if p.share > 0 and p.natural != p.share)])


def moment(offset: Column, share: Column, lean: Column, size: float) -> Column:
    """The t in [0, 1] at which a source has been asked for ``offset`` tokens.

    Its weight at t is share + lean * (1 - 2 t); the demand until t is size * (share t + lean (t - t^2)),
    a quadratic whose root is taken in the form that stays exact as lean goes to 0.
    """
    c = offset / F.lit(size)
    b = share + lean
    return F.least(F.lit(1.0), 2 * c / (b + F.sqrt(F.greatest(b * b - 4 * lean * c, F.lit(0.0)))))


def with_offsets(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``texts`` with ``before``: the tokens of the same source that come first, in an order drawn by digest."""
    at = texts.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    sums = at.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("__base"))
    within = Window.partitionBy("source", "bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    near = at.withColumn("__near", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    joined = near.join(sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return joined.select(*texts.columns, (F.col("__base") + F.col("__near")).alias("before"))


def mix(documents: DataFrame, targets: DataFrame, folder: str = tokens.TOKENIZERS, name: str = tokens.VOCABULARY) -> tuple[DataFrame, list[Plan]]:
    """The mixture (positie, doc_id, source, herhaling, n_tokens) in order of training, and its plan.

    herhaling counts from 1. A copy is in if its middle lies within its source's demand, so a source
    misses its share by less than half a document. No text occurs more than max_herhaling times.
    """
    texts = cut(distinct_texts(documents, folder, name))
    plans = plan(texts, targets)
    size, lean = sum(p.demand for p in plans), tilt(plans)
    spark = documents.sparkSession
    rows = [(p.source, p.share, lean * (p.natural - p.share), p.demand, p.available, p.repeats) for p in plans if p.demand > 0]
    table = spark.createDataFrame(rows, "__src string, share double, lean double, demand double, stock long, cap int")
    buckets = max(BUCKETS, -(-texts.count() // TEXTS_PER_BUCKET))
    drawn = with_offsets(texts, buckets).join(F.broadcast(table), F.col("source") == F.col("__src"))
    # passes over the source that its demand reaches
    last = F.least(F.col("cap") - 1, F.floor((F.col("demand") - F.col("before") - F.col("n_tokens") / 2) / F.col("stock")).cast("int"))
    copies = drawn.where(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    offset = F.col("before") + F.col("pass").cast("long") * F.col("stock")
    out = copies.select(
        moment(offset.cast("double"), F.col("share"), F.col("lean"), size or 1.0).alias("positie"),
        "doc_id", "source", (F.col("pass") + 1).alias("herhaling"), "n_tokens",
    )
    return out.orderBy("positie", "doc_id", "herhaling"), plans


def shares(documents: DataFrame, targets: DataFrame, folder: str = tokens.TOKENIZERS, name: str = tokens.VOCABULARY) -> DataFrame:
    """Per source of the targets: the share wanted and reached, tokens, texts and the most repeats of a text."""
    mixture, plans = mix(documents, targets, folder, name)
    got = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("teksten"), F.max("herhaling").alias("herhalingen")
    )
    wanted = documents.sparkSession.createDataFrame([(p.source, p.target, p.available, p.repeats) for p in plans], "source string, doel_aandeel double, voorraad long, max_herhaling int")
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # over one row for each source
    joined = wanted.join(got, "source", "left")
    return joined.select(
        "source", "doel_aandeel", "max_herhaling", "voorraad",
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("teksten", F.lit(0)).alias("teksten"), F.coalesce("herhalingen", F.lit(0)).alias("herhalingen"),
        F.round(F.coalesce(F.col("tokens") / all_tokens, F.lit(0.0)), 6).alias("aandeel"),
    )
