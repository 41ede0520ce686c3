"""Whole runs: raw entities to clean tables, transcripts to linked pairs, pairs to features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.text import without_attribution
from plenaria.operators import clean, features, link
from plenaria.runtime import cut
from plenaria.sources import files, transcripts


#: Columns that linking reads of each entity; one that was empty throughout has been dropped by cleaning.
NEEDED = {
    "Activiteit": {"Id": "string", "Soort": "string", "Datum": "timestamp"},
    "Agendapunt": {"Id": "string", "Activiteit_Id": "string", "Onderwerp": "string"},
    "Besluit": {"Id": "string", "Agendapunt_Id": "string", "StemmingsSoort": "string", "BesluitSoort": "string", "BesluitTekst": "string"},
    "Stemming": {"Id": "string", "Besluit_Id": "string", "Soort": "string", "FractieGrootte": "int", "Persoon_Id": "string", "ActorFractie": "string", "Vergissing": "boolean", "GewijzigdOp": "timestamp"},
}


def clean_entities(spark: SparkSession, raw: str, out: str, names: list[str], kind: str = "parquet") -> dict[str, str | Exception]:
    """Raw ``name.json`` of every entity cleaned and written under ``out``; a failure of one does not stop the others.

    A summary of what was written goes to ``_summary`` as CSV.
    """
    done = files.each(names, lambda n: files.save(clean.preprocess(files.read_raw(spark, f"{raw}/{n}.json")), f"{out}/{n}.{kind}", kind))
    good = {n: p for n, p in done.items() if isinstance(p, str)}
    if good:
        read = {n: (spark.read.parquet(p) if kind == "parquet" else files.read_csv(spark, p)) for n, p in good.items()}
        sizes = spark.createDataFrame([(n, files.size_mb(p, spark)) for n, p in good.items()], "tabel string, mb double")
        files.save(clean.summary(read).join(F.broadcast(sizes), "tabel").coalesce(1), f"{out}/_summary", "csv")
    return done


def speech_table(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches of a folder of transcripts with their clean text, day and a unique order: transcript and place in it."""
    s = transcripts.read(spark, folder)
    return s.withColumns({
        "speech_text_clean": without_attribution(F.col("speech_text")),
        "dag": F.to_date(F.col("datum").try_cast("timestamp")),
        "ord": F.struct("verslag_id", "volgnr"),
    })


def linked_pairs(speeches: DataFrame, tables: dict[str, DataFrame], train_to: int = 2021, test_from: int = 2023) -> DataFrame:
    """Substantive speeches linked to votes: all columns of a pair, the place of the speech and the split of its year.

    ``tables`` holds Activiteit, Agendapunt, Besluit and Stemming; later rows of Stemming win.
    """
    said = link.substantive(speeches.withColumn("speech_text", F.col("speech_text_clean")))
    # the place of a speech is that among all of its activity, by transcript and volgnr
    placed = link.positions(said, "activiteit_id", "volgnr", "speech_position", ["verslag_id"]).na.fill({"speech_position": 0.5})
    placed = cut(placed)
    votes = tables["Stemming"].withColumn("ord", F.struct("GewijzigdOp", "Id"))
    decided = cut(link.decided_on(tables["Activiteit"], tables["Agendapunt"], tables["Besluit"], votes))
    linked = link.link(placed, tables["Activiteit"], tables["Agendapunt"], tables["Besluit"], votes, decided=decided)
    return features.split_by_year(link.full_pairs(linked, placed, decided), "datum", train_to, test_from)


def speech_dataset(spark: SparkSession, xml: str, entities: str, out: str) -> str:
    """Transcripts and clean entities to pairs, one folder for each split; stages that are there are not made again.

    Transcripts that cannot be parsed are named in ``_mislukt`` with the reason.
    """
    files.staged(spark, f"{out}/_mislukt", lambda: transcripts.failures(transcripts.documents(spark, xml)))
    speeches = files.staged(spark, f"{out}/speeches", lambda: speech_table(spark, xml))
    tables = {n: clean.with_missing(spark.read.parquet(f"{entities}/{n}.parquet"), columns) for n, columns in NEEDED.items()}
    return files.save(linked_pairs(speeches, tables), f"{out.rstrip('/')}/pairs", by=["split"])


def enhanced(train: DataFrame, df: DataFrame, cases: DataFrame, coalition: DataFrame, topic: str = "agendapunt_onderwerp") -> DataFrame:
    """Pairs with loyalty, position, the case's kind and appreciation, and the coalition flag; all from the training years."""
    kinds = features.enrich_topics(df, topic, cases).select(F.col(topic).alias("__t"), "kabinetsappreciatie", "zaak_soort")
    out = features.speaker_loyalty(train, df)
    out = out.join(kinds, F.coalesce(F.col(topic), F.lit("")) == F.col("__t"), "left").drop("__t")
    return features.in_coalition(out, coalition, "datum").na.fill({"speech_position": 0.5})
