"""Further queries with their SQL: report panels, documented joins, metrics, sources and transcripts read back.

The test data has no tables of promises, gifts, travels, dossiers or careers; each panel runs over columns that stand in
for them, named as the panel's own table names them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions import text as T
from plenaria.operators import clean, features, link, metrics, reports
from plenaria.plans import pipeline
from plenaria.plans.reference import _BASE, _PARLIAMENT, _SPLIT, _TRAIN, _coalition, _scored, _split, majority_sql, parliament, tokens_sql
from plenaria.plans.reference import SQL as BASE_SQL
from plenaria.runtime import checkpoint_dir, cut, table
from plenaria.sources import files, transcripts

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (tables by name -> DataFrame) under its name."""

    def of(f: Callable):
        QUERIES[f.__name__] = lambda spark, root: f(lambda name: table(spark, root, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return of


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- metrics ----------------------------------------------------------------------------------

_REPORT = f"""{_BASE}, lab AS (SELECT unnest(['Voor', 'Tegen']) AS label),
c AS (SELECT label, (SELECT count(*) FROM g WHERE vote = label AND baseline = label) AS h, (SELECT count(*) FROM g WHERE baseline = label) AS gs, (SELECT count(*) FROM g WHERE vote = label) AS sp FROM lab),
r0 AS (SELECT label, CASE WHEN gs > 0 THEN h / gs ELSE 0 END AS p, CASE WHEN sp > 0 THEN h / sp ELSE 0 END AS r, sp FROM c WHERE gs + sp > 0),
r AS (SELECT label, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, sp FROM r0)"""
_ACCURACY = "avg(CASE WHEN vote = baseline THEN 1.0 ELSE 0.0 END)"


@query(f"""{_REPORT} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(sp AS BIGINT) AS support FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, round({_ACCURACY}, 6), count(*) FROM g
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(sp) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(p * sp) / sum(sp), 6), round(sum(r * sp) / sum(sp), 6), round(sum(f * sp) / sum(sp), 6), CAST(sum(sp) AS BIGINT) FROM r""")
def baseline_full_report(t):
    """The report of the party baseline with its averages."""
    return rounded(metrics.full_report(_scored(t), "vote", "baseline"), "precision", "recall", "f1")


@query(f"{_REPORT} SELECT (SELECT round({_ACCURACY}, 6) FROM g) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * sp) / sum(sp), 6) AS weighted_f1 FROM r")
def macro_scores(t):
    return rounded(metrics.scores(_scored(t), "vote", "baseline"), "accuracy", "macro_f1", "weighted_f1")


@query(f"""{_BASE} SELECT CASE WHEN NOT coalesce(vote = baseline, false) THEN 'struggling' WHEN sure > 0.8 THEN 'mastered' ELSE 'learning' END AS stand, count(*) AS n FROM g GROUP BY 1""")
def difficulty_counts(t):
    """Mastered, learning and struggling samples (A30), of a stand-in confidence."""
    return metrics.difficulty(_scored(t), "vote", "baseline", "sure")


@query(f"""{_BASE}, w AS (SELECT pair_id, 0.5 * (1 + (pair_id % 7) / 10.0) + 0.5 * CASE WHEN NOT coalesce(vote = baseline, false) THEN 2.0 WHEN sure < 0.65 THEN 1.5 WHEN sure > 0.85 THEN 0.3 ELSE 1.0 END AS w FROM g)
SELECT pair_id, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w""")
def sample_weights(t):
    """The next weight of every held-out sample (M22), of a stand-in confidence and weight before."""
    d = _scored(t).withColumn("weight", 1 + (F.col("pair_id") % 7) / 10.0)
    return rounded(metrics.reweight(d, "vote", "baseline", "sure", "weight").select("pair_id", "weight"), "weight")


@query(f"WITH {_SPLIT}, {_TRAIN} SELECT pair_id, vote FROM tr ORDER BY pair_id DESC LIMIT 500")
def validation_fallback(t):
    """What validates if there is no year between training and test (K9): the last 500 training rows."""
    train, rest = _split(t)
    return features.validation(train, rest.limit(0), "pair_id").select("pair_id", "vote")


@query("SELECT 'drie' AS soort, count(*) AS n FROM speech_vote_pairs WHERE vote IN ('Voor', 'Tegen', 'Niet deelgenomen') UNION ALL SELECT 'alle', count(*) FROM speech_vote_pairs WHERE vote IS NOT NULL")
def usable_fallback(t):
    """Usable rows by three labels, and all labelled rows where none has the label asked for."""
    p = t("speech_vote_pairs").select("vote")
    parts = {"drie": features.usable_or_all(p), "alle": features.usable_or_all(p, labels=("Onbekend",))}
    one, other = (d.agg(F.count("*").alias("n")).select(F.lit(k).alias("soort"), "n") for k, d in parts.items())
    return one.unionByName(other)


@query(f"""WITH {_SPLIT}, {_TRAIN}, line AS ({majority_sql('(SELECT * FROM tr WHERE fractie IS NOT NULL AND besluit_id IS NOT NULL)', 'besluit_id, fractie', 'vote')}),
l AS (SELECT persoon_id, avg(CASE WHEN vote = majority THEN 1.0 ELSE 0.0 END) AS r FROM tr JOIN line USING (besluit_id, fractie) WHERE persoon_id IS NOT NULL GROUP BY persoon_id),
k AS ({BASE_SQL["inverted_index"]}), co AS (SELECT pair_id AS cp, is_coalition AS ci FROM ({BASE_SQL["coalition_flag"]}))
SELECT ev.pair_id, round(coalesce(l.r, 0.5), 6) AS speaker_loyalty, round(coalesce(ev.speech_position, 0.5), 6) AS speech_position, k.kabinetsappreciatie, k.zaak_soort, co.ci AS is_coalition
FROM ev LEFT JOIN l USING (persoon_id) LEFT JOIN k ON k.agendapunt_onderwerp = coalesce(ev.agendapunt_onderwerp, '') LEFT JOIN co ON co.cp = ev.pair_id""")
def enhanced_features(t):
    """All enhanced features of the held-out pairs."""
    train, rest = _split(t)
    d = rest.select("pair_id", "persoon_id", "fractie", "datum", "speech_position", "agendapunt_onderwerp")
    e = pipeline.enhanced(train, d, t("zaak"), _coalition(t))
    return rounded(e.select("pair_id", "speaker_loyalty", "speech_position", "kabinetsappreciatie", "zaak_soort", "is_coalition"), "speaker_loyalty", "speech_position")


# ---- text -------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\x{200C}\\x{200D}'']*[\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\x{200C}\\x{200D}]')) AS INTEGER) AS woorden FROM documents")
def word_tokens(t):
    return t("documents").select("doc_id", F.size(T.word_tokens(F.col("text"))).alias("woorden"))


# ---- cleaning ---------------------------------------------------------------------------------


@query("SELECT lower(trim(Id)) AS Id, Nummer, Geslacht FROM persoon")
def without_deleted_mark(t):
    """The mark of deletion is dropped by cleaning."""
    p = t("persoon").select("Id", "Nummer", "Geslacht").withColumn("Verwijderd", F.lit(False))
    return clean.preprocess(p)


@query("SELECT doc_id, soort FROM documents WHERE soort IS DISTINCT FROM (SELECT min(soort) FROM documents)")
def without_status(t):
    """Rows whose status is not an unwanted one, null included."""
    d = t("documents").select("doc_id", "soort")
    return clean.without_status(d, "soort", d.agg(F.min("soort")).first()[0])


@query("SELECT DISTINCT pair_id, coalesce(lower(trim(CAST(vote_vergissing AS VARCHAR))) = 'true', false) AS vergissing FROM speech_vote_pairs")
def truth_from_text(t):
    return t("speech_vote_pairs").select("pair_id", T.truth(F.col("vote_vergissing").cast("string")).alias("vergissing")).distinct()


@query("SELECT source, round(sum(n_chars) / 1048576, 2) AS mb FROM documents GROUP BY source")
def text_megabytes(t):
    return t("documents").groupBy("source").agg(T.megabytes(F.sum("n_chars")).alias("mb"))


@query("""SELECT DISTINCT pair_id, coalesce(fractie, 'Onbekend') AS fractie, round(coalesce(speech_position, 0.5), 6) AS speech_position, CAST(coalesce(speech_length, 0) AS DOUBLE) AS speech_length,
coalesce(besluit_tekst, '') AS besluit_tekst FROM speech_vote_pairs""")
def default_fills(t):
    """What stands in for missing model inputs."""
    from plenaria.ml import models

    d = t("speech_vote_pairs").select("pair_id", "fractie", "speech_position", "speech_length", "besluit_tekst")
    return rounded(models.filled(d, ["fractie"], ["speech_position", "speech_length"], ["besluit_tekst"]), "speech_position").distinct()


@query(f"""WITH {_PARLIAMENT} SELECT count(*) AS n, count(DISTINCT ord) AS speeches FROM s JOIN decided d ON d.dag = s.dag OR d.dag = s.dag + 1
WHERE len(list_intersect({tokens_sql('concat_ws(chr(32), s.ao, s.ah)')}, {tokens_sql("coalesce(nullif(d.topic, ''), d.tekst)")})) >= 1""")
def topic_match_one(t):
    """All speeches with the decisions of their day and the next that share a token."""
    p = parliament(t)
    decided = cut(link.decided_on(p["activities"], p["agenda"], p["decisions"], p["votes"]))
    return link.by_topic(p["speeches"], decided, "dag", least=1).agg(F.count("*").alias("n"), F.count_distinct("ord").alias("speeches"))


# ---- report panels ----------------------------------------------------------------------------

# Short forms of destinations and ministries.
PLACES = {", België": " (BE)", ", Duitsland": " (DE)", ", Frankrijk": " (FR)", "Verenigde Staten": "USA", ", Oostenrijk": " (AT)", ", Verenigd Koninkrijk": " (UK)", ", Engeland": " (UK)", ", Italië": " (IT)", ", Spanje": " (ES)"}
MINISTRIES = {
    "Volksgezondheid, Welzijn en Sport": "VWS", "Infrastructuur en Waterstaat": "I&W", "Justitie en Veiligheid": "J&V", "Binnenlandse Zaken en Koninkrijksrelaties": "BZK", "Onderwijs, Cultuur en Wetenschap": "OCW",
    "Sociale Zaken en Werkgelegenheid": "SZW", "Financiën": "Fin", "Buitenlandse Zaken": "BuZa", "Economische Zaken en Klimaat": "EZK", "Landbouw, Natuur en Voedselkwaliteit": "LNV",
}


def promise_status(promises: DataFrame) -> DataFrame:
    """Promises by status with percentages (panel E)."""
    return reports.value_shares(promises, "Status")


def gifts_by_year(gifts: DataFrame) -> DataFrame:
    """Gifts registered in each of the years 2007 to 2025 (panel F)."""
    return reports.years(gifts, F.year(F.col("Datum").try_cast("timestamp")), 2007, 2025)


def destinations(travels: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent destinations under short names (panel G)."""
    return reports.value_counts(travels, "Bestemming", top).withColumn("value", T.replaced(F.col("value"), PLACES))


def promises_by_ministry(promises: DataFrame, top: int = 10) -> DataFrame:
    """The ministries with most promises under short names (panel H)."""
    return reports.value_counts(promises, "Ministerie", top).withColumn("value", T.replaced(F.col("value"), MINISTRIES))


def _ministry(topic: Column) -> Column:
    return F.nullif(F.regexp_extract(topic, r"ministerie van (.+?)(?: voor het jaar \d+| \(\d+\))?$", 1), F.lit(""))


@query("SELECT Status AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM zaak WHERE Status IS NOT NULL GROUP BY 1")
def panel_promise_status(t):
    """Stand-in: cases with their status."""
    return promise_status(t("zaak").select("Status"))


@query("SELECT CAST(year(Van) AS INTEGER) AS jaar, count(*) AS n FROM fractiezetelpersoon WHERE year(Van) BETWEEN 2007 AND 2025 GROUP BY 1")
def panel_gifts_by_year(t):
    """Stand-in: memberships with the day they begin."""
    return gifts_by_year(t("fractiezetelpersoon").select(F.col("Van").cast("string").alias("Datum")))


@query("SELECT p AS value, count(*) AS n FROM (SELECT nullif(regexp_extract(Onderwerp, ' in (\\p{Lu}\\p{L}+)$', 1), '') AS p FROM zaak) WHERE p IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def panel_destinations(t):
    """Stand-in: the places that cases are about."""
    return destinations(t("zaak").select(F.nullif(F.regexp_extract("Onderwerp", r" in (\p{Lu}\p{L}+)$", 1), F.lit("")).alias("Bestemming")))


@query("SELECT m AS value, count(*) AS n FROM (SELECT nullif(regexp_extract(activiteit_onderwerp, 'ministerie van (.+?)(?: voor het jaar \\d+| \\(\\d+\\))?$', 1), '') AS m FROM speech_vote_pairs) WHERE m IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def panel_promises_by_ministry(t):
    """Stand-in: debates with the ministry they name."""
    return promises_by_ministry(t("speech_vote_pairs").select(_ministry(F.col("activiteit_onderwerp")).alias("Ministerie")))


@query("SELECT vergadering_soort AS value, count(*) AS n FROM speeches WHERE vergadering_soort IS NOT NULL GROUP BY 1")
def panel_dossiers_by_chamber(t):
    """Dossiers by chamber (panel J). Stand-in: speeches by kind of meeting."""
    return reports.value_counts(t("speeches"), "vergadering_soort")


@query("SELECT Functie AS value, count(*) AS n FROM persoon WHERE Functie IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def panel_careers(t):
    """Careers (panel K). Stand-in: offices of persons."""
    return reports.value_counts(t("persoon"), "Functie", 12)


@query("SELECT Status AS value, count(*) AS n FROM zaak WHERE Status IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def best_value(t):
    """Max-by over a table of scores (K8)."""
    return reports.best_of(reports.value_counts(t("zaak"), "Status"), "value", "n").select("value", "n")


# ---- documented joins -------------------------------------------------------------------------


def documents_by_party(actors: DataFrame, documents: DataFrame, parties: DataFrame, kinds: list[str]) -> DataFrame:
    """Documents of the kinds by party: actors (Document_Id, Fractie_Id) of documents (Id, Soort), parties (Id, Afkorting)."""
    d = documents.where(F.col("Soort").isin(*kinds)).select(F.col("Id").alias("__d"))
    one = actors.where(F.col("Fractie_Id").isNotNull()).join(d, F.col("Document_Id") == F.col("__d"), "left_semi").select("Document_Id", "Fractie_Id").distinct()
    p = parties.groupBy(F.col("Id").alias("__p")).agg(F.min("Afkorting").alias("Afkorting"))
    return one.groupBy("Fractie_Id").agg(F.count("*").alias("n")).join(p, F.col("Fractie_Id") == F.col("__p")).select("Afkorting", "n")


def participants(activities: DataFrame, actors: DataFrame, year: str) -> DataFrame:
    """Activities of a session year with the number of their participants: activities (Id, Vergaderjaar), actors (Activiteit_Id, Persoon_Id)."""
    a = activities.where(F.col("Vergaderjaar") == year).select(F.col("Id").alias("__a")).distinct()
    return actors.join(a, F.col("Activiteit_Id") == F.col("__a"), "left_semi").groupBy("Activiteit_Id").agg(F.count_distinct("Persoon_Id").alias("deelnemers"))


@query("""SELECT f.Afkorting, count(*) AS n FROM (SELECT DISTINCT s.Besluit_Id, s.Fractie_Id FROM stemming s JOIN (SELECT DISTINCT besluit_id FROM speech_vote_pairs WHERE besluit_soort = (SELECT min(besluit_soort) FROM speech_vote_pairs)) d
ON d.besluit_id = s.Besluit_Id WHERE s.Fractie_Id IS NOT NULL) x JOIN (SELECT Id, min(Afkorting) AS Afkorting FROM fractie GROUP BY Id) f ON f.Id = x.Fractie_Id GROUP BY 1""")
def documents_per_party(t):
    """Stand-in: decisions are the documents, those who voted on them the actors."""
    p = t("speech_vote_pairs")
    kind = p.agg(F.min("besluit_soort")).first()[0]
    actors = t("stemming").select(F.col("Besluit_Id").alias("Document_Id"), "Fractie_Id")
    return documents_by_party(actors, p.select(F.col("besluit_id").alias("Id"), F.col("besluit_soort").alias("Soort")).distinct(), t("fractie"), [kind])


@query("""SELECT activiteit_id AS Activiteit_Id, count(DISTINCT persoon_id) AS deelnemers FROM speeches WHERE activiteit_id IN (SELECT activiteit_id FROM speeches WHERE vergaderjaar = (SELECT max(vergaderjaar) FROM speeches)) GROUP BY 1""")
def activity_participants(t):
    s = t("speeches")
    year = s.agg(F.max("vergaderjaar")).first()[0]
    return participants(s.select(F.col("activiteit_id").alias("Id"), F.col("vergaderjaar").alias("Vergaderjaar")), s.select(F.col("activiteit_id").alias("Activiteit_Id"), F.col("persoon_id").alias("Persoon_Id")), year)


@query("""WITH b AS (SELECT Besluit_Id FROM stemming WHERE Besluit_Id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, Besluit_Id LIMIT 1)
SELECT s.Id, s.Soort, p.Achternaam, f.Afkorting FROM (SELECT DISTINCT Id, Soort, Persoon_Id, Fractie_Id FROM stemming WHERE Besluit_Id = (SELECT Besluit_Id FROM b)) s
LEFT JOIN persoon p ON p.Id = s.Persoon_Id LEFT JOIN (SELECT Id, min(Afkorting) AS Afkorting FROM fractie GROUP BY Id) f ON f.Id = s.Fractie_Id""")
def votes_on_decision(t):
    """All votes on one decision, the one with most, with names of persons and parties."""
    s = t("stemming")
    b = reports.value_counts(s, "Besluit_Id", 1).select(F.col("value").alias("__b"))
    mine = s.join(F.broadcast(b), F.col("Besluit_Id") == F.col("__b"), "left_semi").select("Id", "Soort", "Persoon_Id", "Fractie_Id").distinct()  # one row
    p = t("persoon").select(F.col("Id").alias("__p"), "Achternaam")
    f = t("fractie").groupBy(F.col("Id").alias("__f")).agg(F.min("Afkorting").alias("Afkorting"))
    return mine.join(p, F.col("Persoon_Id") == F.col("__p"), "left").join(f, F.col("Fractie_Id") == F.col("__f"), "left").select("Id", "Soort", "Achternaam", "Afkorting")


@query("SELECT DISTINCT s.speech_id FROM speeches s WHERE CAST(verg_date AS DATE) IN (SELECT TRY_CAST(datum AS DATE) FROM speech_vote_pairs WHERE TRY_CAST(datum AS DATE) IS NOT NULL)")
def speeches_on_voting_days(t):
    """Membership of a day in a set of days, as a semi join."""
    days = t("speech_vote_pairs").select(F.col("datum").try_cast("date").alias("__d")).where("__d is not null").distinct()
    return t("speeches").join(days, F.to_date("verg_date") == F.col("__d"), "left_semi").select("speech_id").distinct()


# ---- sources ----------------------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/bron-{uuid.uuid4().hex}"


@query("SELECT Id, Nummer, Achternaam, Geslacht, Functie FROM persoon")
def source_json(t):
    """Records written as raw JSON and read again."""
    d = t("persoon").select("Id", "Nummer", "Achternaam", "Geslacht", "Functie")
    path = _folder(d.sparkSession)
    files.write_raw(d, path)
    return files.read_raw(d.sparkSession, path, d.schema, lines=True)


@query("SELECT Id, Nummer, Achternaam, Functie FROM persoon")
def source_csv(t):
    """A table written as CSV and read again with its types found anew."""
    d = t("persoon").select("Id", "Nummer", "Achternaam", "Functie")
    return files.read_csv(d.sparkSession, files.export_tables({"Persoon": d, "_weg": d}, _folder(d.sparkSession), ["Persoon"], None)["Persoon"])


@query(f"WITH {_SPLIT} SELECT DISTINCT pair_id, split, vote FROM sp")
def source_splits(t):
    """Pairs written by split and read again, made once and then resumed."""
    p = features.split_by_year(t("speech_vote_pairs").select("pair_id", "datum", "vote").distinct(), "datum", 2016, 2020).select("pair_id", "split", "vote").distinct()
    spark, folder = p.sparkSession, _folder(p.sparkSession)
    files.staged(spark, f"{folder}/paren", lambda: p)
    files.save(files.staged(spark, f"{folder}/paren", lambda: p.limit(0)), f"{folder}/delen", by=["split"])
    return files.read_table(spark, f"{folder}/delen").select("pair_id", F.col("split").cast("string").alias("split"), "vote")


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rijen FROM (SELECT count(*) AS n FROM persoon UNION ALL SELECT 0)")
def source_missing(t):
    """A missing table is empty."""
    d = t("persoon").select("Id")
    return d.unionByName(files.read_table(d.sparkSession, f"{_folder(d.sparkSession)}/weg", d.schema)).agg(F.count("*").alias("rijen"))


def _xml(c: str) -> Column:
    """A value as XML text: no control characters, which XML cannot hold, and markup escaped."""
    x = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\x{9}\x{A}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def documents_of(speeches: DataFrame) -> DataFrame:
    """(path, content): a transcript document for each verslag, one of its own activities and turns for each speech."""
    said = F.concat(
        F.lit('<activiteit soort="Debat" objectid="'), _xml("activiteit_id"), F.lit('"><onderwerp>'), _xml("activiteit_onderwerp"), F.lit('</onderwerp><activiteithoofd objectid="h"><activiteitdeel soort="Spreekbeurt"><activiteititem><woordvoerder><spreker objectid="'),
        _xml("persoon_id"), F.lit('"><fractie>'), _xml("fractie"), F.lit("</fractie></spreker><isvoorzitter>"), F.coalesce(F.col("is_voorzitter"), F.lit(False)).cast("string"), F.lit("</isvoorzitter><tekst><alinea>"), _xml("speech_text"),
        F.lit("</alinea></tekst></woordvoerder></activiteititem></activiteitdeel></activiteithoofd></activiteit>"),
    )
    # a document holds a whole transcript: that is what a file of them is
    one = speeches.where("verslag_id is not null").select("verslag_id", F.struct("volgnr", "speech_id", said.alias("x")).alias("s")).groupBy("verslag_id").agg(F.array_sort(F.collect_list("s"))["x"].alias("xs"))
    body = F.concat(F.lit('<verslag><vergadering soort="Plenair" objectid="m">'), F.array_join("xs", ""), F.lit("</vergadering></verslag>"))
    return one.select(F.concat(F.lit("/x/"), "verslag_id", F.lit(".xml")).alias("path"), F.encode(body, "UTF-8").alias("content"))


_CLEAN_XML = "trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[^\\x{{9}}\\x{{A}}\\x{{20}}-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT verslag_id, volgnr, speech_id, persoon_id, nullif(trim(fractie), '') AS fractie, coalesce(is_voorzitter, false) AS is_voorzitter, {_CLEAN_XML.format(c="speech_text")} AS x FROM (SELECT DISTINCT * FROM speeches) WHERE verslag_id IS NOT NULL)
SELECT verslag_id, CAST(row_number() OVER (PARTITION BY verslag_id ORDER BY volgnr, speech_id) AS INTEGER) AS volgnr, coalesce(persoon_id, '') AS persoon_id, is_voorzitter, md5(x) AS tekst FROM s WHERE length(x) >= {transcripts.LEAST}""")
def transcript_rows(t):
    """Every speech put into a transcript document of its verslag and parsed from it again."""
    rows = transcripts.parse(documents_of(t("speeches").distinct()))
    return rows.select("verslag_id", "volgnr", F.coalesce("persoon_id", F.lit("")).alias("persoon_id"), "is_voorzitter", F.md5("speech_text").alias("tekst"))
