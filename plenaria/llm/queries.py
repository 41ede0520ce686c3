"""Queries of the operators in this folder and, where it can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenaria.llm import linkage, mixing, names, nearest, tokens, truncation, turns
from plenaria.plans.problems import SQL as CORE_SQL
from plenaria.runtime import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return names.found(*(table(spark, root, t) for t in ("stemming", "speeches", "fractie")))


def p1_unmatched(spark: SparkSession, root: str) -> DataFrame:
    return names.unmatched(p1_found(spark, root))


def _transcripts(spark: SparkSession, root: str) -> tuple[DataFrame, tuple]:
    return table(spark, root, "speeches"), turns.people_of(*(table(spark, root, t) for t in ("persoon", "fractiezetelpersoon", "fractie")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return turns.found(*(table(spark, root, t) for t in ("speeches", "persoon", "fractiezetelpersoon", "fractie")))


def p2_segments(spark: SparkSession, root: str) -> DataFrame:
    """The clean text, segment by segment in order, with its speaker as far as the chunk tells."""
    return turns.ordered(*_transcripts(spark, root)).drop("speech_id")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return linkage.found(table(spark, root, "speech_vote_pairs"), table(spark, root, "zaak"))


def p5_links(spark: SparkSession, root: str) -> DataFrame:
    """With the confidence."""
    return linkage.link(table(spark, root, "speech_vote_pairs"), table(spark, root, "zaak"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return nearest.found(table(spark, root, "speeches"), table(spark, root, "activiteit"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode(table(spark, root, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mengdoelen"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(table(spark, root, "documents"), table(spark, root, "mengdoelen"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.found(table(spark, root, "documents"))


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation.rates(table(spark, root, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_unmatched": p1_unmatched,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

SQL = {
    "p6_found": f"""
WITH instant AS ({CORE_SQL["p4_found"]}),
a AS (SELECT DISTINCT t.Id AS id, t.Vergadering_Id AS v, i.utc_us AS u FROM activiteit t JOIN instant i ON i.tabel = 'activiteit' AND i.sleutel = t.Id),
s AS (SELECT DISTINCT speech_id, vergadering_id AS v, epoch_us(verg_date) AS u FROM speeches)
SELECT speech_id, id AS activiteit_id FROM s JOIN a USING (v) WHERE abs(a.u - s.u) <= 2700000000
QUALIFY row_number() OVER (PARTITION BY speech_id ORDER BY abs(a.u - s.u), a.u, id) = 1
""",
}
