"""Speeches linked to the votes they were about: the core query.

Two strategies: by the activity a speech belongs to (quality 1); for speeches whose activity has no
voted decision, by the day (the same or the next) and a topic overlap (quality 3). A vote is looked up
by person, then party, then party in lower case. Everything is equi joins: the two-day band is a
two-element explode of the speech side, and topics meet by (day, token), each distinct topic of a day once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.ordered import index
from plenaria.functions.text import joined, overlap, topic_tokens
from plenaria.operators.clean import mentions
from plenaria.operators.dedup import keep_by, keep_longest
from plenaria.runtime import cut

VOTE = ["Soort", "FractieGrootte", "Persoon_Id", "ActorFractie", "Vergissing"]


def voted(decisions: DataFrame, votes: DataFrame) -> DataFrame:
    """Decisions on which there is a vote."""
    return decisions.join(votes.select(F.col("Besluit_Id").alias("__b")), F.col("Id") == F.col("__b"), "left_semi")


def vote_context(votes: DataFrame, decisions: DataFrame, agenda: DataFrame) -> DataFrame:
    """Votes with the text of their decision and the topic of its agenda item (which may be missing)."""
    a = agenda.select(F.col("Id").alias("__a"), F.col("Onderwerp").alias("Agendapunt_Onderwerp"))
    d = decisions.join(a, decisions["Agendapunt_Id"] == a["__a"], "left").drop("__a")
    d = d.select(F.col("Id").alias("__d"), "StemmingsSoort", "BesluitSoort", "BesluitTekst", "Agendapunt_Onderwerp")
    return votes.join(d, votes["Besluit_Id"] == d["__d"]).drop("__d")


def lookup(votes: DataFrame, by: Column, order: str) -> DataFrame:
    """(besluit, key, vote) with the last row of each (besluit, key)."""
    rows = votes.where(by.isNotNull()).select(F.col("Besluit_Id").alias("besluit"), by.alias("key"), F.struct(*VOTE).alias("vote"), order)
    return keep_by(rows, ["besluit", "key"], [F.col(order)]).drop(order)


def resolve(candidates: DataFrame, votes: DataFrame, order: str) -> DataFrame:
    """Candidates (with besluit_id, persoon_id, fractie) and the struct ``stem``: person before party before lower-case party.

    Candidates without any such vote are dropped.
    """
    out = candidates
    for n, (mine, theirs) in enumerate(
        [(F.col("persoon_id"), F.col("Persoon_Id")), (F.col("fractie"), F.col("ActorFractie")), (F.lower("fractie"), F.lower("ActorFractie"))]
    ):
        t = lookup(votes, theirs, order).select(F.col("besluit").alias(f"__b{n}"), F.col("key").alias(f"__k{n}"), F.col("vote").alias(f"__v{n}"))
        mine = F.when(mine != "", mine)
        out = out.join(t, (F.col("besluit_id") == F.col(f"__b{n}")) & (mine == F.col(f"__k{n}")), "left").drop(f"__b{n}", f"__k{n}")
    return out.withColumn("stem", F.coalesce("__v0", "__v1", "__v2")).drop("__v0", "__v1", "__v2").where("stem is not null")


def substantive(speeches: DataFrame, least: int = 50) -> DataFrame:
    """Speeches of a party's member, neither chair nor interruption, longer than ``least`` characters."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return speeches.where(no("is_voorzitter") & no("is_interruptie") & F.col("fractie").isNotNull() & (F.length("speech_text") > least))


def positions(speeches: DataFrame, group: str, order: str, out: str = "speech_position", ties: list[str] | None = None, bucket_rows: int = 65_536) -> DataFrame:
    """Place of a speech among those of its activity, in [0, 1); null without activity.

    ``order`` is a number that is unique within an activity, or with ``ties``; buckets of it keep a hot activity out of one task.
    """
    placed = index(speeches.withColumn("__bucket", F.floor(F.col(order) / bucket_rows)), [group], "__bucket", [order, *(ties or [])], "__i", "__n")
    place = F.when(F.col(group).isNotNull(), F.col("__i") / F.greatest(F.col("__n"), F.lit(1)))
    return placed.withColumn(out, place).drop("__bucket", "__i", "__n")


def by_activity(speeches: DataFrame, decided: DataFrame) -> DataFrame:
    """Strategy 1: every decision of the speech's own activity."""
    d = decided.select(F.col("Activiteit_Id").alias("__act"), F.col("besluit_id"))
    return speeches.join(d, F.col("activiteit_id") == F.col("__act")).drop("__act").withColumn("link_quality", F.lit(1))


def unmatched(speeches: DataFrame, decided: DataFrame) -> DataFrame:
    """Speeches whose activity has no decision; those without activity are among them."""
    d = decided.select(F.col("Activiteit_Id").alias("__act"))
    return speeches.join(d, F.col("activiteit_id") == F.col("__act"), "left_anti")


def by_day(speeches: DataFrame, decided: DataFrame, day: str, days: int = 1) -> DataFrame:
    """Strategy 2: decisions voted on the speech's day or up to ``days`` later."""
    d = decided.select(F.col("stem_dag").alias("__day"), "besluit_id", "Agendapunt_Onderwerp", "BesluitTekst")
    band = F.explode(F.array(*[F.date_add(F.col(day), k) for k in range(days + 1)]))
    s = speeches.where(F.col(day).isNotNull()).withColumn("__on", band)
    return s.join(d, F.col("__on") == F.col("__day")).drop("__on", "__day").withColumn("link_quality", F.lit(3))


def speech_topic() -> Column:
    return joined(F.col("activiteit_onderwerp"), F.col("activiteithoofd_onderwerp"))


def decision_topic() -> Column:
    return F.coalesce(F.when(F.col("Agendapunt_Onderwerp") != "", F.col("Agendapunt_Onderwerp")), F.col("BesluitTekst"))


def on_topic(candidates: DataFrame, least: int = 2) -> DataFrame:
    """Candidates whose speech topic shares ``least`` tokens with the agenda item, or with the decision if that has no topic."""
    return candidates.where(overlap(topic_tokens(speech_topic()), topic_tokens(decision_topic()), least))


def by_topic(speeches: DataFrame, decided: DataFrame, day: str, days: int = 1, least: int = 2) -> DataFrame:
    """``on_topic(by_day(...))`` without its pairs: the distinct topics of a day meet by their tokens, and only topics that
    share ``least`` of them bring their speeches and decisions together."""
    band = F.explode(F.array(*[F.date_add(F.col(day), k) for k in range(days + 1)]))
    s = speeches.where(F.col(day).isNotNull()).withColumn("__st", speech_topic()).withColumn("__on", band)
    d = decided.where("stem_dag is not null").select(F.col("stem_dag").alias("__day"), "besluit_id", decision_topic().alias("__dt"))
    said = s.select("__on", "__st").distinct().select("__on", "__st", F.explode(topic_tokens(F.col("__st"))).alias("w"))
    asked = d.select("__day", "__dt").distinct().select("__day", "__dt", F.explode(topic_tokens(F.col("__dt"))).alias("__w"))
    met = said.join(asked, (F.col("__on") == F.col("__day")) & (F.col("w") == F.col("__w"))).groupBy("__on", "__st", "__dt").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    met = met.select(F.col("__on").alias("__mo"), F.col("__st").alias("__ms"), F.col("__dt").alias("__md"))
    out = s.join(met, (F.col("__on") == F.col("__mo")) & (F.col("__st") == F.col("__ms"))).join(d, (F.col("__on") == F.col("__day")) & (F.col("__md") == F.col("__dt")))
    return out.drop("__on", "__st", "__mo", "__ms", "__md", "__day", "__dt").withColumn("link_quality", F.lit(3))


def decided_on(activities: DataFrame, agenda: DataFrame, decisions: DataFrame, votes: DataFrame) -> DataFrame:
    """(Activiteit_Id, besluit_id, topics, stem_dag) of the decisions with votes; the day only of voting activities."""
    a = agenda.select(F.col("Id").alias("__ap"), "Activiteit_Id", F.col("Onderwerp").alias("Agendapunt_Onderwerp"))
    d = voted(decisions, votes).join(a, F.col("Agendapunt_Id") == F.col("__ap"))
    acts = activities.select(F.col("Id").alias("__act"), F.when(mentions(F.col("Soort"), "stemming"), F.to_date("Datum")).alias("stem_dag"))
    d = d.join(acts, F.col("Activiteit_Id") == F.col("__act"), "left")
    return d.select("Activiteit_Id", F.col("Id").alias("besluit_id"), "Agendapunt_Onderwerp", "BesluitTekst", "StemmingsSoort", "BesluitSoort", "stem_dag")


def link(speeches: DataFrame, activities: DataFrame, agenda: DataFrame, decisions: DataFrame, votes: DataFrame, day: str = "dag", order: str = "ord", vote_order: str = "ord", decided: DataFrame | None = None) -> DataFrame:
    """One row for each (persoon_id, besluit_id): the longest speech, with the vote and the quality of the link.

    Speeches need ``order`` (unique) and ``day``; votes ``vote_order``. Speeches of unknown persons
    share one row a decision. The longest speech wins whatever its quality. ``decided`` is what ``decided_on`` gives, if it
    is there already.
    """
    decided = cut(decided_on(activities, agenda, decisions, votes)) if decided is None else decided  # one row a decision, used three times
    slim = speeches.select("persoon_id", "fractie", "activiteit_id", "activiteit_onderwerp", "activiteithoofd_onderwerp", day, order, F.length("speech_text").alias("speech_length"))
    keep = ["persoon_id", "fractie", "activiteit_id", order, "speech_length", "besluit_id", "link_quality"]
    both = by_activity(slim, decided).select(*keep).unionByName(by_topic(unmatched(slim, decided), decided, day).select(*keep))
    # the vote depends on person, party and decision only, so the longest speech of each stands for all
    longest = keep_longest(both, ["persoon_id", "fractie", "besluit_id"], "speech_length", order)
    return keep_longest(resolve(longest, votes, vote_order), ["persoon_id", "besluit_id"], "speech_length", order)


#: Columns of a speech that its pairs carry.
SAID = [
    "vergadering_id", "vergaderjaar", "datum", "activiteit_soort", "activiteit_onderwerp", "activiteithoofd_onderwerp", "achternaam", "voornaam", "spreker_soort", "functie", "speech_text", "speech_position",
]
DECIDED = {"StemmingsSoort": "stemmings_soort", "BesluitSoort": "besluit_soort", "BesluitTekst": "besluit_tekst", "Agendapunt_Onderwerp": "agendapunt_onderwerp"}


def pairs(linked: DataFrame, *more: str) -> DataFrame:
    """The pair columns: who, which decision, the vote and how it was linked; and ``more`` of the link."""
    return linked.select(
        *more, "persoon_id", "besluit_id", "fractie", "activiteit_id", "speech_length", "link_quality", F.col("stem")["Soort"].alias("vote"),
        F.col("stem")["FractieGrootte"].alias("vote_fractie_grootte"), F.col("stem")["Persoon_Id"].isNotNull().alias("vote_is_individual"),
        F.col("stem")["Vergissing"].alias("vote_vergissing"),
    )


def full_pairs(linked: DataFrame, speeches: DataFrame, decided: DataFrame, order: str = "ord") -> DataFrame:
    """All columns of a pair: those of ``pairs``, of its speech (by ``order``) and of its decision; columns that ``speeches`` lacks are null.

    Texts are joined last, to the pairs that are left, and never shuffled with the candidates.
    """
    had = [F.col(c) if c in speeches.columns else F.lit(None).cast("double" if c == "speech_position" else "string").alias(c) for c in SAID]
    s = speeches.select(F.col(order).alias("__o"), *had)
    d = decided.groupBy(F.col("besluit_id").alias("__b")).agg(F.min(F.struct(*[F.col(c).alias(n) for c, n in DECIDED.items()])).alias("__d")).select("__b", "__d.*")
    rows = pairs(linked, order).join(s, F.col(order) == F.col("__o")).join(d, F.col("besluit_id") == F.col("__b"))
    return rows.drop(order, "__o", "__b")


def coverage(children: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """How many rows and keys of a foreign key are found, missing or null."""
    p = parents.select(F.col(parent).alias("__p")).where("__p is not null").distinct()
    j = children.select(F.col(key).alias("__k")).groupBy("__k").agg(F.count("*").alias("n")).join(p, F.col("__k") == F.col("__p"), "left")
    hit = F.col("__p").isNotNull()
    return j.agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("gevonden"),
        F.coalesce(F.sum(F.when(~hit & F.col("__k").isNotNull(), F.col("n"))), F.lit(0)).alias("ontbreekt"),
        F.coalesce(F.sum(F.when(F.col("__k").isNull(), F.col("n"))), F.lit(0)).alias("leeg"),
        F.count_if(hit).cast("long").alias("sleutels"),
    )
