"""History of changing attributes out of periodic snapshots (problem 7).

Method: an event-sourced change log with one row for each change of one attribute, each attribute
with its own intervals; the version history is the log split at the union of all boundaries, with
equal neighbours coalesced. Sequences are bucketed (``functions.ordered``), so an entity with a
third of all snapshots is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.ordered import carry
from plenaria.runtime import cut

#: Width of a bucket of one entity's snapshots; a task holds one entity's snapshots of this span.
BUCKET_US = 30 * 86_400_000_000


def latest_delivery(df: DataFrame, keys: list[str], arrival: str, columns: list[str]) -> DataFrame:
    """Of the rows with the same ``keys`` the one with the highest ``arrival``; pre-aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(arrival)).alias("__v")).select(*keys, *[F.col("__v")[c].alias(c) for c in columns])


def change_log(
    snapshots: DataFrame, entity: str, at_us: str, attributes: dict[str, Column], bucket_us: int = BUCKET_US
) -> DataFrame:
    """Rows (entity, attribute, value as text or null, from_us), one for each change of one attribute.

    ``snapshots`` must have one row for each entity and moment. The first snapshot of an entity
    changes every attribute; null is a value like any other.
    """
    state = F.struct(*[c.cast("string").alias(a) for a, c in attributes.items()])
    rows = snapshots.select(
        F.col(entity).alias("entity"), F.col(at_us).alias("at_us"), F.floor(F.col(at_us) / bucket_us).alias("bucket"), state.alias("state")
    )
    seen = carry(rows, ["entity"], "bucket", ["at_us"], {"before": "state"}, inclusive=False)
    changes = F.array(
        *[
            F.when(
                F.col("before").isNull() | ~F.col("before")[a].eqNullSafe(F.col("state")[a]),
                F.struct(F.lit(a).alias("attribute"), F.col("state")[a].alias("value")),
            )
            for a in attributes
        ]
    )
    return seen.select("entity", F.col("at_us").alias("from_us"), F.inline(F.filter(changes, lambda c: c.isNotNull())))


def intervals(log: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """The change log with ``to_us``, the end of each attribute's own interval (null: still valid), by buckets of time."""
    at = log.withColumn("bucket", F.floor(F.col("from_us") / bucket_us))
    return carry(at, ["entity", "attribute"], "bucket", ["from_us"], {"to_us": "from_us"}, forward=False, inclusive=False).drop("bucket")


def versions(spans: DataFrame, attributes: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """Rows (entity, van_us, tot_us, attributes), the combined history of ``intervals``; ``tot_us`` is null for the last.

    An entity is split at the union of all ends of its attributes' intervals; at each the intervals that hold there are
    carried on, one that has ended counts no more; neighbours with equal values become one version.
    """
    held = F.struct(F.col("value").alias("v"), F.coalesce("to_us", F.lit(1 << 62)).alias("until"))  # so that null is carried as a value
    starts = spans.select("entity", "from_us", "attribute", held.alias("held"))
    # an interval that another of its attribute follows ends where that begins; only last ones add a boundary of their own
    at = starts.groupBy("entity", "from_us").agg(*[F.max(F.when(F.col("attribute") == a, F.col("held"))).alias(f"__c_{a}") for a in attributes])
    at = at.withColumn("bucket", F.floor(F.col("from_us") / bucket_us))
    full = carry(at, ["entity"], "bucket", ["from_us"], {f"__s_{a}": f"__c_{a}" for a in attributes})
    now = lambda a: F.when(F.col("from_us") < F.col(f"__s_{a}")["until"], F.col(f"__s_{a}")["v"])
    full = full.select("entity", "from_us", "bucket", F.struct(*[now(a).alias(a) for a in attributes]).alias("state"))
    full = carry(full, ["entity"], "bucket", ["from_us"], {"before": "state"}, inclusive=False)
    starts = full.where(F.col("before").isNull() | ~F.col("before").eqNullSafe(F.col("state")))
    ends = carry(cut(starts), ["entity"], "bucket", ["from_us"], {"tot_us": "from_us"}, forward=False, inclusive=False)
    return ends.select("entity", F.col("from_us").alias("van_us"), "tot_us", *[F.col("state")[a].alias(a) for a in attributes])


def party_versions(fractie: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Versions of DatumActief, DatumInactief and AantalZetels of every party.

    Of deliveries with the same Id and ApiGewijzigdOp the highest snapshot_id counts. Rows without Id
    or ApiGewijzigdOp belong to no history and are left out. An empty table gives an empty history.
    """
    attributes = {"DatumActief": F.unix_micros("DatumActief"), "DatumInactief": F.unix_micros("DatumInactief"), "AantalZetels": F.col("AantalZetels")}
    rows = fractie.where(F.col("Id").isNotNull() & F.col("ApiGewijzigdOp").isNotNull()).withColumn("__at", F.unix_micros("ApiGewijzigdOp"))
    rows = rows.select("Id", "__at", "snapshot_id", *attributes)
    one = latest_delivery(rows, ["Id", "__at"], "snapshot_id", list(attributes))
    log = cut(change_log(one, "Id", "__at", attributes, bucket_us))  # rows are changes, not snapshots
    return versions(intervals(log, bucket_us), list(attributes), bucket_us)


def found(fractie: DataFrame) -> DataFrame:
    """Distinct (fractie_id, van_us, tot_us), tot_us -1 where the version is the last."""
    v = party_versions(fractie)
    return v.select(F.col("entity").alias("fractie_id"), "van_us", F.coalesce("tot_us", F.lit(-1)).cast("long").alias("tot_us"))
