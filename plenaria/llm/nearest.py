"""Records of two tables paired by nearest time within a tolerance (problem 6).

Method: both tables are united, ordered by entity and time, the last and the next right-side record
are carried onto every left row, and the nearer one within the tolerance is taken. Both sides are
first reduced to distinct (entity, time), and entities are bucketed by time, so neither an entity nor
a moment with a third of all rows ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.ordered import carry_both
from plenaria.operators.instants import denoted
from plenaria.runtime import cut

TOLERANCE_US = 45 * 60 * 1_000_000
BUCKET_US = 15 * 60 * 1_000_000


def nearest(
    left: DataFrame, right: DataFrame, entity: tuple[str, str], time_us: tuple[str, str], right_id: str, out: str,
    tolerance_us: int = TOLERANCE_US, bucket_us: int = BUCKET_US,
) -> DataFrame:
    """``left`` with ``out``, the ``right_id`` nearest in time of the same entity, and ``out + '_us'``, its distance.

    Null where none lies within the tolerance (inclusive). Rows with a null entity or time match
    nothing and stay. Of right rows at the same moment the smallest id counts; of two equally near
    moments the earlier. Extra columns of ``left`` stay, those of ``right`` are not read.
    """
    (el, er), (tl, tr) = entity, time_us
    r = right.select(F.col(er).alias("__e"), F.col(tr).alias("__t"), F.col(right_id).alias("__id"), F.lit(False).alias("__left"))
    q = left.select(F.col(el).alias("__e"), F.col(tl).alias("__t"), F.lit(None).cast(r.schema["__id"].dataType).alias("__id"), F.lit(True).alias("__left"))
    both = r.where("__id is not null").unionByName(q).where("__e is not null and __t is not null")
    moments = both.groupBy("__e", "__t").agg(F.min("__id").alias("__id"), F.max("__left").alias("__left"))
    moments = moments.select(
        "__e", "__t", "__left", F.floor(F.col("__t") / bucket_us).alias("__b"),
        F.when(F.col("__id").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("__id").alias("id"))).alias("__r"),
    )
    # distinct moments, written once: rows and bucket summaries read them
    moments = carry_both(cut(moments), ["__e"], "__b", ["__t"], "__r", "__last", "__next")

    def off(side: str) -> Column:
        return F.abs(F.col(side)["t"] - F.col("__t"))

    best = F.when(F.col("__next").isNull() | (off("__last") <= off("__next")), F.col("__last")).otherwise(F.col("__next"))
    near = moments.where("__left").select("__e", "__t", best.alias("__best"))
    near = near.select(F.col("__e").alias("__ke"), F.col("__t").alias("__kt"), F.col("__best")["id"].alias("__oid"), F.abs(F.col("__best")["t"] - F.col("__t")).alias("__od"))
    near = near.where(F.col("__od") <= tolerance_us)
    joined = left.join(near, (left[el] == near["__ke"]) & (left[tl] == near["__kt"]), "left")
    return joined.select(*[left[c] for c in left.columns], F.col("__oid").alias(out), F.col("__od").alias(f"{out}_us"))


def found(speeches: DataFrame, activiteit: DataFrame) -> DataFrame:
    """Distinct (speech_id, activiteit_id) of the speeches with an activiteit of their vergadering near enough."""
    left = speeches.select("speech_id", "vergadering_id", F.unix_micros("verg_date").alias("__at"))
    right = denoted(activiteit.select("Id", "Vergadering_Id", "Datum").where("Vergadering_Id is not null"), "Datum", "__at")
    got = nearest(left, right, ("vergadering_id", "Vergadering_Id"), ("__at", "__at"), "Id", "activiteit_id")
    return got.where("activiteit_id is not null").select("speech_id", "activiteit_id").distinct()
