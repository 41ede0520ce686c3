"""One row for each key: first, last, best or longest, always by a stated order.

All are aggregates with a partial step before the shuffle, so a key with a third of all rows sends one
row from each task instead of all its rows to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_by(df: DataFrame, keys: list[str], order: list[Column], last: bool = True) -> DataFrame:
    """For each key the row with the highest (or lowest) ``order``; null keys are keys.

    ``order`` should end in a unique column, else which of equal rows stays is open. Nulls are the
    lowest values.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    one = df.groupBy(*keys).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__row"))
    return one.select(*[F.col(k) if c == k else F.col("__row")[c].alias(c) for c in df.columns for k in [c if c in keys else ""]])


def keep_longest(df: DataFrame, keys: list[str], length: str, tie: str) -> DataFrame:
    """For each key the row with the greatest ``length``, of equals the one with the lowest ``tie``."""
    return keep_by(df, keys, [-F.coalesce(F.col(length), F.lit(-1)), F.col(tie)], last=False)


def best_version(df: DataFrame, key: str, status: str, ranks: dict[str, int], tie: str, unknown: int = 99) -> DataFrame:
    """For each key the row whose status ranks best (of equals the lowest ``tie``); rows without key all stay."""
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    rank = F.coalesce(F.try_element_at(table, F.col(status)), F.lit(unknown))
    best = keep_by(df.where(F.col(key).isNotNull()), [key], [rank, F.col(tie)], last=False)
    return best.unionByName(df.where(F.col(key).isNull()))
