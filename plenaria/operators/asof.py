"""Attributes as they were valid and known at the time of an event (problem 3).

Method: the facts become, for every entity, as-known snapshots at the start of each period plus a
log of the changes within the period. An event joins the snapshot before it by (entity, period) and
replays only the changes up to its day. The event side is never sorted or shuffled as long as the
snapshots have a proven small size; beyond it the same equi join is shuffled.

A period's snapshot and log come from the facts that begin or end within it and from the one fact, known last, that
holds throughout; the latter is looked up in maxima over dyadic spans of periods. So no task holds more of
an entity than what changes within one period.
"""

from __future__ import annotations

import datetime
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenaria.functions.ordered import carry
from plenaria.runtime import broadcast_within, cut

PERIOD_DAYS = 91
FOREVER = 10_000_000
#: Days from here on are fillers: such an end is open, such a start never comes.
FILLER_DAY = datetime.date(9000, 1, 1).toordinal() - datetime.date(1970, 1, 1).toordinal()
#: Snapshots and change logs up to this many rows and characters are broadcast.
BROADCAST_ROWS, BROADCAST_SIZE = 200_000, 20_000_000


def effective(facts: DataFrame, entity: str, version_of: str | None, value: str, known_us: str, start_day: str, end_day: str, tie: list[str]) -> DataFrame:
    """Rows (entity, value, first_day, last_day, known_us): the days on which a fact is known, not replaced, and valid.

    A fact is known at 00:00 UTC of a day if its ``known_us`` lies before. Later facts of the same
    ``version_of`` replace earlier ones. Facts without entity, ``known_us`` or start say nothing. A year from 9000
    on is a filler: an end there is open, and what is known or starts only there says nothing.
    """
    rows = facts.where(F.col(entity).isNotNull() & F.col(known_us).isNotNull() & F.col(start_day).isNotNull())
    rows = rows.withColumn("__known", F.floor(F.col(known_us) / 86_400_000_000).cast("long") + 1)
    replaced = F.lit(None).cast("long")
    if version_of:
        rows = rows.withColumn("__bucket", F.floor(F.col("__known") / PERIOD_DAYS))
        rows = carry(rows, [version_of], "__bucket", [known_us, *tie], {"__replaced": "__known"}, forward=False, inclusive=False)
        replaced = F.when(F.col(version_of).isNotNull(), F.col("__replaced"))
    end = F.col(end_day).cast("long")
    rows = rows.select(
        F.col(entity).alias("entity"),
        F.col(value).cast("string").alias("value"),
        F.col(known_us).alias("known_us"),
        F.struct(*tie).cast("string").alias("tie") if tie else F.lit("").alias("tie"),
        F.greatest(F.col("__known"), F.col(start_day).cast("long")).alias("first_day"),
        F.least(F.when(end < FILLER_DAY, end).otherwise(FOREVER), F.coalesce(replaced, F.lit(FOREVER + 1)) - 1).alias("last_day"),
    )
    return rows.where((F.col("first_day") <= F.col("last_day")) & (F.col("first_day") < FILLER_DAY))


def _spans(low: Column, high: Column) -> Column:
    """The dyadic spans (level, node) that make up low .. high - 1, both from 0 on: two for each level at most."""
    empty = F.expr("cast(array() as array<struct<level: int, node: bigint>>)")

    def climb(a: Column, level: Column) -> Column:
        l, r = a["l"], a["r"]
        left, right = (l < r) & (l % 2 == 1), (l < r) & (r % 2 == 1)
        one = lambda ok, node: F.when(ok, F.array(F.struct(level.cast("int").alias("level"), node.alias("node")))).otherwise(empty)
        # where both ends are odd and meet, the left span is the right one too
        both = F.concat(a["out"], one(left, l), one(right & ~(left & (l + 1 == r)), r - 1))
        up = F.when(l < r, F.struct(F.floor((l + 1) / 2).alias("l"), F.floor(r / 2).alias("r"))).otherwise(F.struct(l.alias("l"), l.alias("r")))
        return F.struct(up["l"].alias("l"), up["r"].alias("r"), both.alias("out"))

    begin = F.struct(low.cast("long").alias("l"), high.cast("long").alias("r"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begin, climb, lambda a: a["out"])


#: Levels of dyadic spans; periods of a day from year 1 to 9000 take 22.
LEVELS = 22


def _sweep(start: int, end: int, facts: list[tuple]) -> tuple[str | None, list[dict], str | None]:
    """State at day ``start``, changes after it and state on day ``end`` of the fact known last; facts (first, last, known, tie, value)."""
    held = [(max(f, start), min(l, end), k, t, v) for f, l, k, t, v in facts if max(f, start) <= min(l, end)]
    rank = {t: n for n, t in enumerate(sorted({x[3] for x in held}))}
    waiting = sorted(held, key=lambda x: -x[0])
    heap: list = []
    out: list[tuple] = []
    for day in sorted({start, *(x[0] for x in held), *(x[1] + 1 for x in held if x[1] < end)}):
        while waiting and waiting[-1][0] <= day:
            _, last, known, tie, value = waiting.pop()
            heapq.heappush(heap, (-known, -rank[tie], len(waiting), last, value))
        while heap and heap[0][3] < day:
            heapq.heappop(heap)
        now = heap[0][4] if heap else None
        if not out or now != out[-1][1]:
            out.append((day, now))
    return out[0][1], [{"day": d, "value": {"v": v}} for d, v in out[1:]], out[-1][1]


def _swept(period_days: int):
    """Sweeps the periods of entities out of rows sorted by them; holds one period at a time."""
    names = ["entity", "period", "snapshot", "log", "after"]

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, facts = None, []

        def done() -> tuple:
            entity, period = key
            return (entity, period, *_sweep(period * period_days, (period + 1) * period_days - 1, facts))

        for d in parts:
            rows = []
            d = d.astype(object).where(d.notna(), None)
            for entity, period, *fact in d[["entity", "period", "first_day", "last_day", "known_us", "tie", "value"]].itertuples(index=False):
                if (entity, period) != key:
                    if key is not None:
                        rows.append(done())
                    key, facts = (entity, period), []
                facts.append(tuple(fact))
            yield pd.DataFrame(rows, columns=names, dtype=object)
        if key is not None:
            yield pd.DataFrame([done()], columns=names, dtype=object)

    return of


_STATE = "entity string, period long, snapshot string, log array<struct<day: bigint, value: struct<v: string>>>"


def known_state(facts: DataFrame, period_days: int = PERIOD_DAYS) -> DataFrame:
    """Rows (entity, period, snapshot, log) from ``effective`` facts.

    ``snapshot`` is the value at the start of the period and ``log`` the sorted changes within it. Periods run from
    an entity's first to its own last change; beyond them nothing changes.
    """
    at = lambda c: F.floor(F.col(c) / period_days).cast("long")
    closed = F.col("last_day") < FOREVER
    facts = cut(facts.withColumn("begins", at("first_day")).withColumn("ends", F.when(closed, F.floor((F.col("last_day") + 1) / period_days).cast("long"))))
    local = facts.withColumn("period", F.explode(F.array_compact(F.array_distinct(F.array("begins", "ends")))))
    periods = local.select("entity", "period").distinct()
    reach = periods.groupBy("entity").agg(F.min("period").alias("low"), F.max("period").alias("high"))
    # facts that hold throughout periods, as the one known last of each dyadic span
    said = F.struct("known_us", "tie", "value").alias("said")
    through = facts.join(reach, "entity").select("entity", said, F.explode(_spans(F.col("begins") + 1 - F.col("low"), F.coalesce("ends", F.col("high") + 1) - F.col("low"))).alias("s"))
    spans = through.groupBy("entity", F.col("s")["level"].alias("level"), F.col("s")["node"].alias("node")).agg(F.max("said").alias("said"))
    above = periods.join(reach, "entity").select("entity", "period", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"), (F.col("period") - F.col("low")).alias("k"))
    above = above.select("entity", "period", "level", F.floor(F.col("k") / F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("node"))
    cover = above.join(spans, ["entity", "level", "node"]).groupBy("entity", "period").agg(F.max("said").alias("said"))
    columns = ["entity", "period", "known_us", "tie", "value", "first_day", "last_day"]
    whole = cover.select("entity", "period", "said.*", (F.col("period") * period_days).alias("first_day"), F.lit(FOREVER).cast("long").alias("last_day"))
    changing = local.select(*columns).unionByName(whole.select(*columns))
    swept = changing.repartition("entity", "period").sortWithinPartitions("entity", "period").mapInPandas(_swept(period_days), _STATE + ", after string")
    # at most one row for each period of an entity
    swept = swept.withColumn("next", F.lead("period").over(Window.partitionBy("entity").orderBy("period")))
    swept = cut(swept)
    none = F.expr("cast(array() as array<struct<day: bigint, value: struct<v: string>>>)")
    gaps = swept.where(F.col("next") > F.col("period") + 1).select("entity", F.explode(F.sequence(F.col("period") + 1, F.col("next") - 1)).alias("period"), F.col("after").alias("snapshot"), none.alias("log"))
    return swept.select("entity", "period", "snapshot", "log").unionByName(gaps)


def join(events: DataFrame, entity: str, day: str, state: DataFrame, out: str, period_days: int = PERIOD_DAYS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``events`` with the value as known at 00:00 UTC of ``day`` (days since 1970) in ``out``; null if none was.

    Before the first period of its entity nothing is known; an event after the last takes that.
    """
    reach = state.groupBy(F.col("entity").alias("__r")).agg(F.min("period").alias("__low"), F.max("period").alias("__high"))
    right = state.select(F.col("entity").alias("__e"), F.col("period").alias("__p"), F.col("snapshot").alias("__snapshot"), F.col("log").alias("__log"))
    reach, right = (broadcast_within(d, broadcast_rows, BROADCAST_SIZE) for d in (reach, right))
    now = F.floor(F.col(day) / period_days).cast("long")
    at = F.when(now >= F.col("__low"), F.least(now, F.col("__high")))
    done = F.filter("__log", lambda c: c["day"] <= F.col(day))
    value = F.when(F.size(done) > 0, F.element_at(done, -1)["value"]["v"]).otherwise(F.col("__snapshot"))
    placed = events.join(reach, F.col(entity) == F.col("__r"), "left").withColumn("__at", at)
    return placed.join(right, (F.col(entity) == F.col("__e")) & (F.col("__at") == F.col("__p")), "left").select(*events.columns, value.alias(out))


def found(pairs: DataFrame, membership: DataFrame, coalitie: DataFrame, fractie: DataFrame) -> DataFrame:
    """Distinct (pair_id, fractie_id, is_coalition) of the pairs whose fractie or is_coalition was wrong.

    Pairs without persoon_id or with an unreadable datum are no case. Without a known membership
    fractie_id is '' and is_coalition 0, and the right fractie is null. A null is_coalition is wrong.
    """
    d = lambda c: F.unix_date(F.to_date(c))
    member = effective(
        membership.select("Id", "Persoon_Id", "Fractie_Id", F.unix_micros("GewijzigdOp").alias("k"), d("Van").alias("a"), d("TotEnMet").alias("z"), F.unix_micros("ApiGewijzigdOp").alias("api")),
        "Persoon_Id", "Id", "Fractie_Id", "k", "a", "z", ["api", "Fractie_Id", "z"],
    )
    part = effective(
        coalitie.select("coalitie_id", "fractie_id", "is_coalition", F.unix_micros("bekend_op").alias("k"), d("van").alias("a"), d("tot_en_met").alias("z")),
        "fractie_id", None, "is_coalition", "k", "a", "z", ["coalitie_id"],
    )
    names = fractie.where(F.col("Id").isNotNull()).groupBy("Id").agg(F.min("Afkorting").alias("__afk"))
    e = pairs.select("pair_id", "persoon_id", "fractie", "is_coalition", F.unix_date(F.col("datum").try_cast("date")).cast("long").alias("__day"))
    e = e.where(F.col("persoon_id").isNotNull() & F.col("__day").isNotNull())
    e = join(e, "persoon_id", "__day", known_state(member), "__f")
    e = join(e, "__f", "__day", known_state(part), "__c")
    e = e.join(broadcast_within(names, BROADCAST_ROWS, BROADCAST_SIZE), F.col("__f") == F.col("Id"), "left")
    right = F.coalesce(F.col("__c").cast("int"), F.lit(0))
    wrong = e.where(~F.col("fractie").eqNullSafe(F.col("__afk")) | ~F.col("is_coalition").eqNullSafe(right))
    return wrong.select("pair_id", F.coalesce("__f", F.lit("")).alias("fractie_id"), right.alias("is_coalition")).distinct()
