"""Carrying values along an ordered sequence whose keys may be hot.

A window over a whole key is one task for that key. Here every key is first split into buckets of
its order; windows run within (key, bucket), and one summary row for each bucket (not for each row)
carries values over bucket borders. A key with a third of all rows is thus spread over as many
tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[str],
    columns: dict[str, str],
    forward: bool = True,
    inclusive: bool = True,
) -> DataFrame:
    """Adds for each ``out: source`` the last non-null ``source`` at or before a row.

    ``forward=False`` gives the first non-null one at or after it. ``inclusive=False`` leaves out
    the row itself. ``order`` must be unique within a key, else ties are in no defined order, and
    ``bucket`` must not decrease along ``order``. Null keys form a key of their own. An empty
    table stays empty.
    """
    by = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
    end = Window.currentRow if inclusive else -1
    near = Window.partitionBy(*keys, bucket).orderBy(*by).rowsBetween(Window.unboundedPreceding, end)
    far = (
        Window.partitionBy(*keys)
        .orderBy(F.col(bucket).asc() if forward else F.col(bucket).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rank = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    total = df.groupBy(*keys, bucket).agg(
        *[pick(F.col(s), F.when(F.col(s).isNotNull(), rank)).alias(f"__b_{o}") for o, s in columns.items()]
    )
    total = total.select(
        *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("__k_b"),
        *[F.last(f"__b_{o}", ignorenulls=True).over(far).alias(f"__f_{o}") for o in columns],
    )
    here = df.select("*", *[F.last(s, ignorenulls=True).over(near).alias(f"__n_{o}") for o, s in columns.items()])
    same: Column = F.col(bucket) == F.col("__k_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    joined = here.join(total, same, "left")
    return joined.select(
        *df.columns, *[F.coalesce(f"__n_{o}", f"__f_{o}").alias(o) for o in columns]
    )


def carry_both(df: DataFrame, keys: list[str], bucket: str, order: list[str], source: str, before: str, after: str) -> DataFrame:
    """Adds the last non-null ``source`` at or before a row and the first one at or after it: two ``carry`` with one shuffle of the rows."""
    near, far, picks = [], [], []
    for out, forward in ((before, True), (after, False)):
        by = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
        near.append(F.last(source, ignorenulls=True).over(Window.partitionBy(*keys, bucket).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)).alias(f"__n_{out}"))
        by = F.col("__k_b").asc() if forward else F.col("__k_b").desc()
        here = Window.partitionBy(*[f"__k_{i}" for i in range(len(keys))]).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        far.append(F.last(f"__b_{out}", ignorenulls=True).over(here).alias(f"__f_{out}"))
        pick = F.max_by if forward else F.min_by
        picks.append(pick(F.col(source), F.when(F.col(source).isNotNull(), F.struct(*order))).alias(f"__b_{out}"))
    ks = [F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)]
    total = df.groupBy(*ks, F.col(bucket).alias("__k_b")).agg(*picks).select(*[f"__k_{i}" for i in range(len(keys))], "__k_b", *far)
    same: Column = F.col(bucket) == F.col("__k_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    joined = df.select("*", *near).join(total, same, "left")
    return joined.select(*df.columns, *[F.coalesce(f"__n_{o}", f"__f_{o}").alias(o) for o in (before, after)])


def index(df: DataFrame, keys: list[str], bucket: str, order: list[str], out: str, total: str | None = None) -> DataFrame:
    """Adds the place of a row within its key, from 0, and in ``total`` the rows of the key.

    Rows are numbered within (key, bucket); the numbers of rows in earlier buckets come from the
    bucket summary. Null keys form a key of their own.
    """
    far = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("__n"))
    sizes = sizes.select(
        *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("__k_b"),
        F.coalesce(F.sum("__n").over(far), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    here = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    same: Column = F.col(bucket).eqNullSafe(F.col("__k_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    more = [F.col("__total").alias(total)] if total else []
    return here.join(sizes, same, "left").select(*df.columns, (F.col("__before") + F.col("__i")).alias(out), *more)
