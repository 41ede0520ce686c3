"""Queries of the engine's own operators over the test tables, each with its SQL where SQL can express it.

The test data has no agenda, decision or meeting tables; ``parliament`` derives them from the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenaria.functions import text as T
from plenaria.operators import clean, dedup, features, link, metrics, reports
from plenaria.runtime import cut, table
from plenaria.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (tables by name -> DataFrame) under its name."""

    def of(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, root: f(lambda name: table(spark, root, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return of


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def tokens_sql(c: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+')), "
        f"lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN ({STOP}))"
    )


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WHITE}+', ' ', 'g'))"


def cleaned_sql(c: str) -> str:
    return f"CASE WHEN {collapse_sql(c)} NOT IN ('', 'None', 'nan') THEN {collapse_sql(c)} END"


def majority_sql(source: str, keys: str, value: str) -> str:
    return (
        f"SELECT {keys}, {value} AS majority FROM (SELECT {keys}, {value}, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}, {value}) "
        f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {value}) = 1"
    )


# ---- the derived parliament -------------------------------------------------------------------


def parliament(t: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    p = t("speech_vote_pairs").dropDuplicates(["pair_id"])
    decisions = p.groupBy(F.col("besluit_id").alias("Id")).agg(
        F.min("besluit_id").alias("Agendapunt_Id"), F.min("stemmings_soort").alias("StemmingsSoort"), F.min("besluit_soort").alias("BesluitSoort"), F.min("besluit_tekst").alias("BesluitTekst")
    )
    agenda = p.groupBy(F.col("besluit_id").alias("Id")).agg(F.min("activiteit_id").alias("Activiteit_Id"), F.min("agendapunt_onderwerp").alias("Onderwerp"))
    activities = p.where("activiteit_id is not null").groupBy(F.col("activiteit_id").alias("Id")).agg(F.min("activiteit_soort").alias("Soort"), F.min("datum").alias("Datum"))
    speeches = p.select(
        F.col("pair_id").alias("ord"), "persoon_id", "fractie", F.when(F.col("link_quality") == 1, F.col("activiteit_id")).alias("activiteit_id"),
        F.col("datum").try_cast("date").alias("dag"), *[c for c in link.SAID if c != "speech_position"],
    )
    votes = t("stemming").withColumn("ord", F.struct("ApiGewijzigdOp", "Id"))
    return {"speeches": speeches, "activities": activities, "agenda": agenda, "decisions": decisions, "votes": votes}


_PARLIAMENT = """
p AS (SELECT DISTINCT * FROM speech_vote_pairs),
dec AS (SELECT besluit_id, min(activiteit_id) AS act, min(agendapunt_onderwerp) AS topic, min(besluit_tekst) AS tekst, min(stemmings_soort) AS ss, min(besluit_soort) AS bs FROM p GROUP BY besluit_id),
act AS (SELECT activiteit_id AS act, CASE WHEN min(activiteit_soort) ILIKE '%stemming%' THEN TRY_CAST(min(datum) AS DATE) END AS dag FROM p WHERE activiteit_id IS NOT NULL GROUP BY activiteit_id),
decided AS (SELECT d.*, a.dag FROM dec d LEFT JOIN act a ON a.act = d.act WHERE d.besluit_id IN (SELECT Besluit_Id FROM stemming)),
s AS (SELECT pair_id AS ord, persoon_id, fractie, CASE WHEN link_quality = 1 THEN activiteit_id END AS act, activiteit_onderwerp AS ao, activiteithoofd_onderwerp AS ah, TRY_CAST(datum AS DATE) AS dag, length(speech_text) AS len FROM p)"""


def _lookup_sql(name: str, key: str) -> str:
    return (
        f"{name} AS (SELECT Besluit_Id, {key} AS k, Soort, FractieGrootte, Persoon_Id, Vergissing FROM stemming WHERE {key} IS NOT NULL AND Besluit_Id IS NOT NULL "
        f"QUALIFY row_number() OVER (PARTITION BY Besluit_Id, {key} ORDER BY ApiGewijzigdOp DESC, Id DESC) = 1)"
    )


_LOOKUPS = ", ".join([_lookup_sql("v0", "Persoon_Id"), _lookup_sql("v1", "ActorFractie"), _lookup_sql("v2", "lower(ActorFractie)")])
_FIRST = "SELECT s.*, d.besluit_id, 1 AS q FROM s JOIN decided d ON d.act = s.act"
_SECOND = (
    "SELECT s.*, d.besluit_id, 3 AS q FROM s JOIN decided d ON d.dag = s.dag OR d.dag = s.dag + 1 WHERE NOT EXISTS (SELECT 1 FROM decided x WHERE x.act = s.act) "
    f"AND len(list_intersect({tokens_sql('concat_ws(chr(32), s.ao, s.ah)')}, {tokens_sql('coalesce(nullif(d.topic, chr(0)), d.tekst)')})) >= 2"
).replace("nullif(d.topic, chr(0))", "nullif(d.topic, '')")


_LINKED = f"""WITH {_PARLIAMENT}, {_LOOKUPS}, c AS ({_FIRST} UNION ALL {_SECOND}), r AS (
  SELECT c.*, CASE WHEN v0.k IS NOT NULL THEN 0 WHEN v1.k IS NOT NULL THEN 1 WHEN v2.k IS NOT NULL THEN 2 END AS hit,
    v0.Soort AS s0, v1.Soort AS s1, v2.Soort AS s2, v0.FractieGrootte AS g0, v1.FractieGrootte AS g1, v2.FractieGrootte AS g2,
    v0.Persoon_Id AS p0, v1.Persoon_Id AS p1, v2.Persoon_Id AS p2, v0.Vergissing AS f0, v1.Vergissing AS f1, v2.Vergissing AS f2
  FROM c LEFT JOIN v0 ON v0.Besluit_Id = c.besluit_id AND v0.k = nullif(c.persoon_id, '')
  LEFT JOIN v1 ON v1.Besluit_Id = c.besluit_id AND v1.k = nullif(c.fractie, '') LEFT JOIN v2 ON v2.Besluit_Id = c.besluit_id AND v2.k = nullif(lower(c.fractie), ''))
SELECT ord, persoon_id, besluit_id, fractie, act AS activiteit_id, CAST(len AS INTEGER) AS speech_length, q AS link_quality,
  CASE hit WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS vote, CASE hit WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE g2 END AS vote_fractie_grootte,
  (CASE hit WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) IS NOT NULL AS vote_is_individual, CASE hit WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END AS vote_vergissing
FROM r WHERE hit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY persoon_id, besluit_id ORDER BY coalesce(len, -1) DESC, ord) = 1"""


@query(f"SELECT * EXCLUDE (ord) FROM ({_LINKED})")
def link_flagship(t):
    return link.pairs(link.link(**parliament(t)))


@query(f"""WITH l AS ({_LINKED}), pp AS (SELECT DISTINCT * FROM speech_vote_pairs),
dd AS (SELECT besluit_id, min(stemmings_soort) AS stemmings_soort, min(besluit_soort) AS besluit_soort, min(besluit_tekst) AS besluit_tekst, min(agendapunt_onderwerp) AS agendapunt_onderwerp FROM pp GROUP BY besluit_id),
pos AS (SELECT pair_id, CASE WHEN link_quality = 1 AND activiteit_id IS NOT NULL THEN round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY CASE WHEN link_quality = 1 THEN activiteit_id END), 6) END AS speech_position
  FROM pp WINDOW w AS (PARTITION BY CASE WHEN link_quality = 1 THEN activiteit_id END ORDER BY pair_id))
SELECT l.* EXCLUDE (ord), {", ".join(f"pp.{c}" for c in link.SAID if c != "speech_position")}, pos.speech_position, dd.stemmings_soort, dd.besluit_soort, dd.besluit_tekst, dd.agendapunt_onderwerp
FROM l JOIN pp ON pp.pair_id = l.ord JOIN pos ON pos.pair_id = l.ord JOIN dd ON dd.besluit_id = l.besluit_id""")
def pairs_full(t):
    """All 26 columns of a pair."""
    p = parliament(t)
    said = cut(link.positions(p["speeches"], "activiteit_id", "ord").withColumn("speech_position", F.round("speech_position", 6)))
    decided = cut(link.decided_on(p["activities"], p["agenda"], p["decisions"], p["votes"]))
    return link.full_pairs(link.link(**{**p, "speeches": said}, decided=decided), said, decided)


@query(f"WITH {_PARLIAMENT} SELECT q AS link_quality, count(*) AS n, count(DISTINCT ord) AS speeches FROM ({_FIRST} UNION ALL {_SECOND}) GROUP BY q")
def link_strategies(t):
    p = parliament(t)
    decided = link.decided_on(p["activities"], p["agenda"], p["decisions"], p["votes"])
    both = link.by_activity(p["speeches"], decided).select("ord", "link_quality").unionByName(
        link.by_topic(link.unmatched(p["speeches"], decided), decided, "dag").select("ord", "link_quality")
    )
    return both.groupBy("link_quality").agg(F.count("*").alias("n"), F.count_distinct("ord").alias("speeches"))


@query(f"WITH {_PARLIAMENT} SELECT count(*) AS n, count(DISTINCT d.besluit_id) AS besluiten FROM s JOIN decided d ON d.dag = s.dag OR d.dag = s.dag + 1")
def date_band(t):
    p = parliament(t)
    decided = link.decided_on(p["activities"], p["agenda"], p["decisions"], p["votes"])
    return link.by_day(p["speeches"], decided, "dag").agg(F.count("*").alias("n"), F.count_distinct("besluit_id").alias("besluiten"))


@query(f"WITH {_PARLIAMENT} SELECT (SELECT count(*) FROM decided) AS gestemd, (SELECT count(*) FROM dec) - (SELECT count(*) FROM decided) AS niet_gestemd, (SELECT count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM decided x WHERE x.act = s.act)) AS los")
def voted_and_unmatched(t):
    p = parliament(t)
    decided = link.decided_on(p["activities"], p["agenda"], p["decisions"], p["votes"])
    n = p["decisions"].agg(F.count("*").alias("__all"))
    v = link.voted(p["decisions"], p["votes"]).agg(F.count("*").alias("gestemd"))
    u = link.unmatched(p["speeches"], decided).agg(F.count("*").alias("los"))
    one = v.crossJoin(n).crossJoin(u)  # one row each
    return one.select("gestemd", (F.col("__all") - F.col("gestemd")).alias("niet_gestemd"), "los")


@query(f"WITH {_PARLIAMENT} SELECT d.topic AS Agendapunt_Onderwerp, x.Soort, count(*) AS n FROM stemming x JOIN dec d ON d.besluit_id = x.Besluit_Id GROUP BY ALL")
def vote_context(t):
    p = parliament(t)
    return link.vote_context(p["votes"], p["decisions"], p["agenda"]).groupBy("Agendapunt_Onderwerp", "Soort").agg(F.count("*").alias("n"))


@query(f"WITH {_PARLIAMENT} SELECT strftime(dag, '%Y-%m-%d') AS dag, count(*) AS stemmen, count(DISTINCT x.Besluit_Id) AS besluiten FROM stemming x JOIN dec d ON d.besluit_id = x.Besluit_Id LEFT JOIN act a ON a.act = d.act GROUP BY ALL")
def votes_by_date_chain(t):
    p = parliament(t)
    v = link.vote_context(p["votes"], p["decisions"], p["agenda"]).select(F.col("Besluit_Id").alias("b"))
    d = link.decided_on(p["activities"], p["agenda"], p["decisions"], p["votes"]).select("besluit_id", F.date_format("stem_dag", "yyyy-MM-dd").alias("dag"))
    return v.join(d, v["b"] == d["besluit_id"]).groupBy("dag").agg(F.count("*").alias("stemmen"), F.count_distinct("b").alias("besluiten"))


@query(f"WITH {_PARLIAMENT}, {_LOOKUPS} SELECT 'persoon' AS soort, count(*) AS n FROM v0 UNION ALL SELECT 'fractie', count(*) FROM v1 UNION ALL SELECT 'fractie_klein', count(*) FROM v2")
def vote_lookups(t):
    v = parliament(t)["votes"].where("Besluit_Id is not null")
    parts = [("persoon", F.col("Persoon_Id")), ("fractie", F.col("ActorFractie")), ("fractie_klein", F.lower("ActorFractie"))]
    out = [link.lookup(v, k, "ord").agg(F.count("*").alias("n")).select(F.lit(s).alias("soort"), "n") for s, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---- joins and sets ---------------------------------------------------------------------------


@query("""SELECT n.n_name, count(*) FILTER (l_returnflag = 'R') AS tegen, count(*) FILTER (l_returnflag = 'A') AS voor, count(*) AS n
FROM nation n JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n.n_name""")
def chain_counts(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    per = t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count("*").alias("k"))
    j = per.join(o, per["l_orderkey"] == o["o_orderkey"]).groupBy("o_custkey").agg(F.sum("r").alias("r"), F.sum("a").alias("a"), F.sum("k").alias("k"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return j.join(c, j["o_custkey"] == c["c_custkey"]).groupBy("n_name").agg(F.sum("r").alias("tegen"), F.sum("a").alias("voor"), F.sum("k").alias("n"))


@query("SELECT count(*) FILTER (fk IN (SELECT besluit_id FROM speech_vote_pairs)) AS gevonden, count(*) FILTER (fk IS NOT NULL AND fk NOT IN (SELECT besluit_id FROM speech_vote_pairs WHERE besluit_id IS NOT NULL)) AS ontbreekt, count(*) FILTER (fk IS NULL) AS leeg, count(DISTINCT fk) FILTER (fk IN (SELECT besluit_id FROM speech_vote_pairs)) AS sleutels FROM (SELECT Besluit_Id AS fk FROM stemming)")
def key_coverage(t):
    return link.coverage(t("stemming"), "Besluit_Id", t("speech_vote_pairs"), "besluit_id")


@query("""SELECT 'beide' AS deel, count(*) AS n FROM (SELECT DISTINCT Besluit_Id AS b FROM stemming INTERSECT SELECT besluit_id FROM speech_vote_pairs)
UNION ALL SELECT 'alleen_stemming', count(*) FROM (SELECT Besluit_Id FROM stemming EXCEPT SELECT besluit_id FROM speech_vote_pairs)
UNION ALL SELECT 'samen', count(*) FROM (SELECT Besluit_Id FROM stemming UNION SELECT besluit_id FROM speech_vote_pairs)""")
def key_sets(t):
    a, b = t("stemming").select(F.col("Besluit_Id").alias("b")), t("speech_vote_pairs").select(F.col("besluit_id").alias("b"))
    parts = {"beide": a.intersect(b), "alleen_stemming": a.subtract(b), "samen": a.unionByName(b).distinct()}
    out = None
    for k, d in parts.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(k).alias("deel"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p.Id AS wie, p.Achternaam, f.Afkorting, epoch_us(min(m.Van)) AS sinds FROM fractiezetelpersoon m JOIN persoon p ON p.Id = m.Persoon_Id
JOIN (SELECT Id, min(Afkorting) AS Afkorting FROM fractie GROUP BY Id) f ON f.Id = m.Fractie_Id WHERE m.TotEnMet IS NULL GROUP BY ALL""")
def members_with_party(t):
    m = t("fractiezetelpersoon").where("TotEnMet is null").select("Persoon_Id", "Fractie_Id", "Van")
    p = t("persoon").select(F.col("Id").alias("wie"), "Achternaam")
    f = t("fractie").groupBy(F.col("Id").alias("__f")).agg(F.min("Afkorting").alias("Afkorting"))
    j = m.join(p, F.col("Persoon_Id") == F.col("wie")).join(f, F.col("Fractie_Id") == F.col("__f"))
    return j.groupBy("wie", "Achternaam", "Afkorting").agg(F.unix_micros(F.min("Van")).alias("sinds"))


# ---- cleaning and profiles --------------------------------------------------------------------


@query(f"SELECT {cleaned_sql('ActorFractie')} AS ActorFractie, count(*) AS n FROM stemming GROUP BY 1")
def clean_strings(t):
    return clean.clean_strings(t("stemming").select("ActorFractie")).groupBy("ActorFractie").agg(F.count("*").alias("n"))


@query(f"""SELECT lower(trim(Id)) AS Id, {", ".join(f"{cleaned_sql(c)} AS {c}" for c in ("Soort", "Nummer", "Onderwerp", "DatumSoort", "Datum", "Eindtijd", "Vergadering_Id", "Kamerstukdossier_Id"))},
epoch_us(GewijzigdOp) AS GewijzigdOp, epoch_us(ApiGewijzigdOp) AS ApiGewijzigdOp FROM activiteit""")
def clean_entity(t):
    d = clean.preprocess(t("activiteit"))
    return d.withColumns({c: F.unix_micros(c) for c in ("GewijzigdOp", "ApiGewijzigdOp")})


_PROFILED = ["Id", "Soort", "Onderwerp", "Aanvangstijd", "Eindtijd", "Vergadering_Id", "Kamerstukdossier_Id"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS kolom, count(*) AS rijen, count({c}) AS gevuld, round(100.0 * (count(*) - count({c})) / count(*), 1) AS leeg_pct, round(100.0 * (count(*) - count({c})) / count(*), 1) > 50 AS vooral_leeg FROM activiteit" for c in _PROFILED))
def null_profile(t):
    return clean.profile(t("activiteit").select(*_PROFILED))


@query("SELECT strftime(min(Geboortedatum), '%Y-%m-%d') AS van, strftime(max(Geboortedatum), '%Y-%m-%d') AS tot FROM persoon")
def birth_range(t):
    return clean.date_range(t("persoon"), "Geboortedatum")


_SUMMARISED = {"stemming": 12, "fractie": 11, "zaak": 9, "speeches": 28, "persoon": 12}


@query(" UNION ALL ".join(f"SELECT '{k}' AS tabel, count(*) AS rijen, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {k})) AS kolommen FROM {k}" for k in _SUMMARISED))
def table_summary(t):
    return clean.summary({k: t(k) for k in _SUMMARISED})


@query("SELECT snapshot_id, Afkorting, AantalZetels FROM fractie WHERE DatumInactief IS NULL AND AantalZetels > 0")
def active_parties(t):
    return clean.active(t("fractie"), "DatumInactief", "AantalZetels").select("snapshot_id", "Afkorting", "AantalZetels")


@query("SELECT DISTINCT pair_id, fractie, vote, datum FROM speech_vote_pairs WHERE fractie = 'JongNu' AND vote = 'Voor' AND regexp_matches(speech_text, '(?i)minister|budget|regering')")
def explorer(t):
    return clean.explore(t("speech_vote_pairs"), "JongNu", "Voor", None, "minister|budget|regering").select("pair_id", "fractie", "vote", "datum").distinct()


@query("SELECT activiteit_soort, count(*) AS n FROM speech_vote_pairs WHERE coalesce(lower(activiteit_soort) LIKE '%stemming%', false) GROUP BY 1")
def voting_activities(t):
    return t("speech_vote_pairs").where(clean.mentions(F.col("activiteit_soort"), "Stemming")).groupBy("activiteit_soort").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT speech_id, CAST(length(speech_text) AS INTEGER) AS lengte FROM speeches WHERE NOT coalesce(is_voorzitter, false) AND NOT coalesce(is_interruptie, false) AND fractie IS NOT NULL AND length(speech_text) > 50")
def substantive(t):
    return link.substantive(t("speeches")).select("speech_id", F.length("speech_text").alias("lengte")).distinct()


# ---- one row for each key ---------------------------------------------------------------------


@query("SELECT persoon_id, besluit_id, pair_id, speech_length FROM (SELECT DISTINCT persoon_id, besluit_id, pair_id, speech_length FROM speech_vote_pairs) QUALIFY row_number() OVER (PARTITION BY persoon_id, besluit_id ORDER BY coalesce(speech_length, -1) DESC, pair_id) = 1")
def keep_longest(t):
    return dedup.keep_longest(t("speech_vote_pairs").select("persoon_id", "besluit_id", "pair_id", "speech_length"), ["persoon_id", "besluit_id"], "speech_length", "pair_id")


# From the best version of a transcript to the worst; in the test data orders stand for versions.
VERSIONS = {"Gecorrigeerd": 1, "Ongecorrigeerd": 2, "Voorpublicatie": 3, "Tussenpublicatie": 4, "Casco": 5}
_RANKS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 99 END, o_orderkey) = 1")
def best_version(t):
    return dedup.best_version(t("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderpriority", _RANKS, "o_orderkey")


@query("SELECT Id, ApiGewijzigdOp AS laatst FROM (SELECT Id, max(epoch_us(ApiGewijzigdOp)) AS ApiGewijzigdOp FROM zaak GROUP BY Id)")
def last_delivery(t):
    return dedup.keep_by(t("zaak").select("Id", F.unix_micros("ApiGewijzigdOp").alias("laatst")), ["Id"], [F.col("laatst")])


@query("SELECT pair_id, activiteit_id, CASE WHEN activiteit_id IS NOT NULL THEN round((row_number() OVER (PARTITION BY activiteit_id ORDER BY pair_id) - 1) / count(*) OVER (PARTITION BY activiteit_id), 6) END AS speech_position FROM (SELECT DISTINCT pair_id, activiteit_id FROM speech_vote_pairs)")
def speech_positions(t):
    p = t("speech_vote_pairs").select("pair_id", "activiteit_id").distinct()
    return link.positions(p, "activiteit_id", "pair_id").withColumn("speech_position", F.round("speech_position", 6))


# ---- majorities, rates, loyalty ---------------------------------------------------------------


@query(majority_sql("stemming", "ActorFractie", "Soort"))
def majority_by_party(t):
    return features.majority(t("stemming"), ["ActorFractie"], "Soort")


@query(f"WITH m AS ({majority_sql('stemming', 'Besluit_Id, ActorFractie', 'Soort')}) SELECT round(avg(CASE WHEN s.Soort = m.majority THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM stemming s LEFT JOIN m ON m.Besluit_Id = s.Besluit_Id AND m.ActorFractie = s.ActorFractie")
def majority_per_decision(t):
    own = features.own_group_majority(t("stemming").select("Besluit_Id", "ActorFractie", "Soort"), ["Besluit_Id", "ActorFractie"], "Soort")
    return metrics.agreement(own, "Soort", "majority").withColumn("accuracy", F.round("accuracy", 6))


@query(majority_sql("(SELECT besluit_id, fractie, left(activiteit_onderwerp, 50) AS onderwerp, vote FROM speech_vote_pairs)", "besluit_id, fractie, onderwerp", "vote"))
def majority_by_topic(t):
    p = t("speech_vote_pairs").select("besluit_id", "fractie", F.substring("activiteit_onderwerp", 1, 50).alias("onderwerp"), "vote")
    return features.majority(p, ["besluit_id", "fractie", "onderwerp"], "vote").where("majority is not null")


@query("SELECT Soort AS value, count(*) AS n FROM stemming WHERE Soort IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def majority_class(t):
    return reports.value_counts(t("stemming"), "Soort", 1)


_SPLIT = "sp AS (SELECT *, CASE WHEN year(TRY_CAST(datum AS DATE)) <= 2016 THEN 'train' WHEN year(TRY_CAST(datum AS DATE)) >= 2020 THEN 'test' ELSE 'val' END AS split FROM (SELECT DISTINCT * FROM speech_vote_pairs) WHERE TRY_CAST(datum AS DATE) IS NOT NULL)"
_TRAIN = "tr AS (SELECT * FROM sp WHERE split = 'train' AND vote IN ('Voor', 'Tegen')), ev AS (SELECT * FROM sp WHERE split <> 'train' AND vote IN ('Voor', 'Tegen'))"


def _split(t) -> tuple[DataFrame, DataFrame]:
    p = features.split_by_year(t("speech_vote_pairs").dropDuplicates(["pair_id"]), "datum", 2016, 2020)
    p = features.usable(p)
    return p.where("split = 'train'"), p.where("split <> 'train'")


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n FROM sp GROUP BY split")
def temporal_split(t):
    return features.split_by_year(t("speech_vote_pairs").dropDuplicates(["pair_id"]), "datum", 2016, 2020).groupBy("split").agg(F.count("*").alias("n"))


@query(f"""WITH {_SPLIT}, {_TRAIN}, line AS (SELECT besluit_id, fractie, majority FROM ({majority_sql('(SELECT * FROM tr WHERE fractie IS NOT NULL AND besluit_id IS NOT NULL)', 'besluit_id, fractie', 'vote')})),
l AS (SELECT persoon_id, avg(CASE WHEN vote = majority THEN 1.0 ELSE 0.0 END) AS r FROM tr JOIN line USING (besluit_id, fractie) WHERE persoon_id IS NOT NULL GROUP BY persoon_id)
SELECT pair_id, round(coalesce(r, 0.5), 6) AS speaker_loyalty FROM ev LEFT JOIN l USING (persoon_id)""")
def speaker_loyalty(t):
    train, rest = _split(t)
    return features.speaker_loyalty(train, rest.select("pair_id", "persoon_id")).select("pair_id", F.round("speaker_loyalty", 6).alias("speaker_loyalty"))


@query(f"""WITH {_SPLIT}, {_TRAIN},
d AS (SELECT fractie, stemmings_soort AS k, avg(CASE WHEN vote = 'Voor' THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM tr GROUP BY ALL),
f AS (SELECT fractie, avg(CASE WHEN vote = 'Voor' THEN 1.0 ELSE 0.0 END) AS r FROM tr GROUP BY ALL),
line AS ({majority_sql('(SELECT * FROM tr WHERE fractie IS NOT NULL AND stemmings_soort IS NOT NULL)', 'fractie, stemmings_soort', 'vote')}),
sl AS (SELECT persoon_id, tr.stemmings_soort, avg(CASE WHEN vote = majority THEN 1.0 ELSE 0.0 END) AS r FROM tr LEFT JOIN line l ON l.fractie = tr.fractie AND l.stemmings_soort = tr.stemmings_soort WHERE persoon_id IS NOT NULL GROUP BY ALL)
SELECT pair_id, round(coalesce(d.r, 0.5), 6) AS party_domain_voor_rate, coalesce(d.n, 0) AS party_domain_vote_count, round(coalesce(f.r, 0.5), 6) AS party_recent_voor_rate, round(coalesce(sl.r, 0.5), 6) AS speaker_topic_loyalty
FROM ev LEFT JOIN d ON d.fractie = ev.fractie AND d.k = ev.stemmings_soort LEFT JOIN f ON f.fractie = ev.fractie LEFT JOIN sl ON sl.persoon_id = ev.persoon_id AND sl.stemmings_soort = ev.stemmings_soort""")
def historical_features(t):
    train, rest = _split(t)
    h = features.history(train, rest.select("pair_id", "persoon_id", "fractie", "stemmings_soort"), "stemmings_soort")
    r = lambda c: F.round(c, 6).alias(c)
    return h.select("pair_id", r("party_domain_voor_rate"), "party_domain_vote_count", r("party_recent_voor_rate"), r("speaker_topic_loyalty"))


@query("""WITH z AS (SELECT coalesce(left(Kabinetsappreciatie, 80), 'Onbekend') AS ka, Soort AS soort, unnest(TOKZ) AS w FROM zaak WHERE Soort IN ('Motie', 'Amendement')),
idx AS (SELECT w, ka, soort, count(*) AS n FROM z GROUP BY ALL), tp AS (SELECT DISTINCT coalesce(agendapunt_onderwerp, '') AS t FROM speech_vote_pairs),
tk AS (SELECT t, unnest(TOKT) AS w FROM tp WHERE length(t) >= 5), sc AS (SELECT t, ka, soort, sum(n) AS score FROM tk JOIN idx USING (w) GROUP BY ALL),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, ka, soort) = 1)
SELECT tp.t AS agendapunt_onderwerp, CASE WHEN b.score >= 2 THEN b.ka ELSE 'Onbekend' END AS kabinetsappreciatie,
CASE WHEN b.score >= 2 THEN b.soort WHEN tp.t NOT IN (SELECT t FROM tk) THEN 'Onbekend' WHEN lower(tp.t) LIKE '%motie%' THEN 'Motie' WHEN lower(tp.t) LIKE '%amendement%' THEN 'Amendement' ELSE 'Onbekend' END AS zaak_soort,
CAST(coalesce(b.score, 0) AS BIGINT) AS score FROM tp LEFT JOIN b ON b.t = tp.t""".replace("TOKZ", tokens_sql("coalesce(Titel, '') || ' ' || coalesce(Onderwerp, '')")).replace("TOKT", tokens_sql("t")))
def inverted_index(t):
    return features.enrich_topics(t("speech_vote_pairs"), "agendapunt_onderwerp", t("zaak"))


def _coalition(t) -> DataFrame:
    names = t("fractie").select("Id", F.col("Afkorting").alias("fractie")).distinct()
    return t("coalitie").where("is_coalition = 1").join(names, F.col("fractie_id") == F.col("Id")).select(F.year("van").alias("jaar"), "fractie")


@query("""WITH c AS (SELECT DISTINCT CAST(year(van) AS INTEGER) AS jaar, f.Afkorting AS fractie FROM coalitie JOIN (SELECT DISTINCT Id, Afkorting FROM fractie) f ON f.Id = fractie_id WHERE is_coalition = 1)
SELECT p.pair_id, CAST(CASE WHEN c.jaar IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_coalition FROM (SELECT DISTINCT pair_id, fractie, coalesce(year(TRY_CAST(datum AS DATE)), 2020) AS y FROM speech_vote_pairs) p LEFT JOIN c ON c.jaar = p.y AND c.fractie = p.fractie""")
def coalition_flag(t):
    p = t("speech_vote_pairs").select("pair_id", "fractie", "datum").distinct()
    return features.in_coalition(p, _coalition(t), "datum").select("pair_id", "is_coalition")


@query("SELECT Id FROM (SELECT DISTINCT Id FROM stemming) ORDER BY md5('42-' || Id), Id LIMIT 500")
def seeded_sample(t):
    return features.sample_exact(t("stemming").select("Id").distinct(), "Id", 500)


# ---- predictions and scores -------------------------------------------------------------------


_BASE = f"""WITH {_SPLIT}, {_TRAIN}, line AS ({majority_sql('(SELECT * FROM tr WHERE fractie IS NOT NULL)', 'fractie', 'vote')}),
g AS (SELECT ev.*, coalesce(line.majority, 'Voor') AS baseline, abs(hash_less) AS sure FROM (SELECT *, (pair_id % 101) / 100.0 AS hash_less FROM ev) ev LEFT JOIN line ON line.fractie = ev.fractie)"""


def _scored(t) -> DataFrame:
    """Held-out rows with the baseline and ``sure``, a stand-in made of the pair's id: SQL has no model to compare a real one with."""
    train, rest = _split(t)
    g = features.party_baseline(train, rest.select("pair_id", "fractie", "vote", "speech_length"))
    return g.withColumn("sure", (F.col("pair_id") % 101) / 100.0)


@query(f"""{_BASE}, e AS (SELECT vote, CASE WHEN sure >= 0.7 THEN CASE WHEN speech_length % 2 = 0 THEN 'Voor' ELSE 'Tegen' END ELSE baseline END AS e FROM g) SELECT vote, e AS ensemble, count(*) AS n FROM e GROUP BY ALL""")
def two_stage(t):
    """The override rule on all held-out rows; confidence and speech prediction are stand-ins (see ``_scored``), no text model is run."""
    speech = F.when(F.col("speech_length") % 2 == 0, "Voor").otherwise("Tegen")
    e = features.confident(_scored(t), F.col("sure"), speech, F.col("baseline"), 0.7)
    return e.groupBy("vote", "ensemble").agg(F.count("*").alias("n"))


@query(f"""{_BASE}, lab AS (SELECT unnest(['Voor', 'Tegen']) AS label), c AS (SELECT label, (SELECT count(*) FROM g WHERE vote = label AND baseline = label) AS h, (SELECT count(*) FROM g WHERE baseline = label) AS gs, (SELECT count(*) FROM g WHERE vote = label) AS sp FROM lab),
r AS (SELECT label, CASE WHEN gs > 0 THEN h / gs ELSE 0 END AS p, CASE WHEN sp > 0 THEN h / sp ELSE 0 END AS r, sp FROM c WHERE gs + sp > 0)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, sp AS support FROM r""")
def baseline_report(t):
    r = metrics.report(_scored(t), "vote", "baseline")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"{_BASE} SELECT vote AS label, count(*) FILTER (baseline = 'Voor') AS Voor, count(*) FILTER (baseline = 'Tegen') AS Tegen FROM g GROUP BY vote")
def baseline_confusion(t):
    return metrics.confusion(_scored(t), "vote", "baseline", ["Voor", "Tegen"])


@query(f"{_BASE} SELECT fractie, count(*) AS total, count(*) FILTER (vote = baseline) AS correct, round(count(*) FILTER (vote = baseline) / count(*), 6) AS accuracy FROM g GROUP BY fractie HAVING count(*) >= 5")
def accuracy_by_party(t):
    return metrics.by_group(_scored(t), ["fractie"], "vote", "baseline", 5).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""{_BASE}, b AS (SELECT CASE WHEN sure > 0.8 THEN 'hoog' WHEN sure < 0.6 THEN 'laag' ELSE 'midden' END AS band, CASE WHEN vote = baseline THEN 1.0 ELSE 0.0 END AS h FROM g)
SELECT band, count(*) AS n, round(avg(h), 6) AS accuracy, round(count(*) / sum(count(*)) OVER (), 6) AS aandeel FROM b GROUP BY band""")
def confidence_bands(t):
    """The bands on all held-out rows, of a stand-in confidence (see ``_scored``)."""
    b = metrics.confidence_bands(_scored(t), "sure", "vote", "baseline")
    return b.withColumns({c: F.round(c, 6) for c in ("accuracy", "aandeel")})


@query("SELECT Soort, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM stemming WHERE Soort IS NOT NULL GROUP BY Soort")
def class_weights(t):
    return metrics.class_weights(t("stemming"), "Soort").withColumn("weight", F.round("weight", 6))


# ---- text -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string(list_sort({tokens_sql('text')}), ' ') AS tokens FROM documents")
def topic_tokens(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(T.topic_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"SELECT DISTINCT pair_id, len(list_intersect({tokens_sql('activiteit_onderwerp')}, {tokens_sql('agendapunt_onderwerp')})) >= 2 AS raakt FROM speech_vote_pairs")
def topic_overlap(t):
    p = t("speech_vote_pairs").select("pair_id", T.overlap(T.topic_tokens(F.col("activiteit_onderwerp")), T.topic_tokens(F.col("agendapunt_onderwerp")), 2).alias("raakt"))
    return p.distinct()


def _stance_sql(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INTEGER)" for w in words)


@query(f"SELECT doc_id, {_stance_sql(T.STANCE_FOR)} AS n_voor, {_stance_sql(T.STANCE_AGAINST)} AS n_tegen, length(coalesce(text, '')) AS speech_length FROM documents")
def stance_counts(t):
    return features.basic(t("documents"), "text").select("doc_id", "n_voor", "n_tegen", F.col("speech_length").cast("long").alias("speech_length"))


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WHITE}+'), lambda x: x <> '')) AS woorden FROM documents")
def word_counts(t):
    return t("documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("woorden"))


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?]){_WHITE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '{_WHITE}+', '', 'g') <> '')) AS zinnen FROM documents")
def sentence_counts(t):
    return t("documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("zinnen"))


_AFTER = "CASE WHEN contains(x, chr(10)) THEN substr(x, strpos(x, chr(10)) + 1) ELSE '' END"
_LINE = "CASE WHEN contains(x, chr(10)) THEN left(x, strpos(x, chr(10)) - 1) ELSE x END"
_STRIP = f"regexp_replace(%s, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


@query(f"""WITH q AS (SELECT speech_id, x, {_LINE} AS f, {_AFTER} AS r FROM (SELECT DISTINCT speech_id, speech_text AS x FROM speeches))
SELECT speech_id, md5(CASE WHEN regexp_matches(f, '(?i)^(?:De heer|Mevrouw|De voorzitter|Minister|Staatssecretaris)(?:$|[^\\p{{L}}\\p{{N}}_]).*:\\s*$') OR regexp_matches(f, '(?i)^[A-Z][a-z]+ .+?\\([A-Za-z/-]+\\)\\s*:\\s*$')
  OR ({_STRIP % 'f'} LIKE '%:' AND length(f) < 120) THEN {_STRIP % 'r'} ELSE x END) AS schoon FROM q""")
def attribution_removed(t):
    return t("speeches").select("speech_id", "speech_text").distinct().select("speech_id", F.md5(T.without_attribution(F.col("speech_text"))).alias("schoon"))


@query(f"""WITH q0 AS (SELECT DISTINCT speech_id, {_STRIP % "coalesce(speech_text, '')"} AS x FROM speeches), q AS (SELECT speech_id, x, {_LINE} AS f, {_AFTER} AS r FROM q0)
SELECT speech_id, md5({collapse_sql("CASE WHEN regexp_matches(f, '(?i)^(?:De heer|Mevrouw|De voorzitter|Minister|Staatssecretaris)(?:$|[^\\p{L}\\p{N}_])') OR (" + _STRIP % 'f' + " LIKE '%:' AND length(f) < 120) THEN r ELSE x END")}) AS schoon FROM q""")
def text_pipeline(t):
    return t("speeches").select("speech_id", "speech_text").distinct().select("speech_id", F.md5(T.flattened(F.col("speech_text"))).alias("schoon"))


@query("SELECT DISTINCT pair_id, md5(left(coalesce(agendapunt_onderwerp, ''), 300) || ' </s> ' || left(coalesce(besluit_tekst, ''), 200) || ' </s> ' || left(coalesce(speech_text, ''), 1500)) AS invoer FROM speech_vote_pairs")
def model_inputs(t):
    p = t("speech_vote_pairs").select("pair_id", F.md5(T.model_input(F.col("agendapunt_onderwerp"), F.col("besluit_tekst"), F.col("speech_text"))).alias("invoer"))
    return p.distinct()


@query("SELECT DISTINCT speech_id, trim(u) AS zaak_id FROM speeches, unnest(string_split(coalesce(zaak_ids, ''), ';')) AS x(u) WHERE trim(u) <> ''")
def case_ids(t):
    return t("speeches").select("speech_id", F.explode(T.id_list(F.col("zaak_ids"))).alias("zaak_id")).distinct()


@query("SELECT replace(replace(Functie, 'Tweede Kamerlid', 'TK'), 'Minister van ', 'M ') AS functie, count(*) AS n FROM persoon GROUP BY 1")
def short_labels(t):
    return t("persoon").groupBy(T.replaced(F.col("Functie"), {"Tweede Kamerlid": "TK", "Minister van ": "M "}).alias("functie")).agg(F.count("*").alias("n"))


# ---- report panels ----------------------------------------------------------------------------


@query("SELECT DISTINCT count(*) OVER () AS paren, s AS sprekers, f AS fracties, b AS besluiten, van, tot FROM speech_vote_pairs, (SELECT count(DISTINCT persoon_id) AS s, count(DISTINCT fractie) AS f, count(DISTINCT besluit_id) AS b, strftime(min(TRY_CAST(datum AS DATE)), '%Y-%m-%d') AS van, strftime(max(TRY_CAST(datum AS DATE)), '%Y-%m-%d') AS tot FROM speech_vote_pairs)")
def key_figures(t):
    return reports.totals(t("speech_vote_pairs"))


@query("SELECT ActorFractie AS value, count(*) AS n FROM stemming WHERE ActorFractie IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def top_parties(t):
    return reports.value_counts(t("stemming"), "ActorFractie", 12)


@query("SELECT Geslacht AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM persoon WHERE Geslacht IS NOT NULL GROUP BY 1")
def gender_shares(t):
    return reports.value_shares(t("persoon"), "Geslacht")


@query("SELECT fractie AS row, count(*) FILTER (vote = 'Voor') AS Voor, count(*) FILTER (vote = 'Tegen') AS Tegen, round(100.0 * count(*) FILTER (vote = 'Voor') / nullif(count(*) FILTER (vote IN ('Voor', 'Tegen')), 0), 1) AS voor_pct FROM speech_vote_pairs WHERE fractie IS NOT NULL GROUP BY 1")
def party_approval(t):
    return reports.approval(t("speech_vote_pairs"), "fractie")


@query("SELECT TRY_CAST(left(vergaderjaar, 4) AS INTEGER) AS row, count(*) FILTER (vergadering_soort = 'Plenair') AS Plenair, count(*) FILTER (vergadering_soort = 'Commissie') AS Commissie FROM speeches WHERE TRY_CAST(left(vergaderjaar, 4) AS INTEGER) IS NOT NULL GROUP BY 1")
def meetings_by_year(t):
    return reports.crosstab(t("speeches"), T.session_year(F.col("vergaderjaar")), "vergadering_soort", ["Plenair", "Commissie"])


@query("SELECT CAST(floor(year(Geboortedatum) / 10) * 10 AS BIGINT) AS decennium, count(*) AS n FROM persoon WHERE year(Geboortedatum) >= 1850 GROUP BY 1")
def birth_decades(t):
    return reports.decades(t("persoon"), "Geboortedatum")


@query("SELECT CAST(year(GewijzigdOp) AS INTEGER) AS jaar, count(*) AS n FROM zaak WHERE year(GewijzigdOp) BETWEEN 2007 AND 2025 GROUP BY 1")
def cases_by_year(t):
    return reports.years(t("zaak"), F.year("GewijzigdOp"), 2007, 2025)


@query("WITH d AS (SELECT CAST(GewijzigdOp AS DATE) AS dag, count(DISTINCT Besluit_Id) AS n FROM stemming WHERE GewijzigdOp IS NOT NULL GROUP BY 1) SELECT count(*) AS dagen, round(avg(n), 6) AS gemiddeld, max(n) AS meeste FROM d")
def decisions_per_day(t):
    return reports.per_day(t("stemming"), F.to_date("GewijzigdOp"), "Besluit_Id")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT persoon_id, datum FROM speech_vote_pairs)")
def speaker_days(t):
    return t("speech_vote_pairs").select("persoon_id", "datum").distinct().agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT fractie FROM speech_vote_pairs WHERE fractie IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, fractie LIMIT 15)
SELECT fractie AS row, count(*) FILTER (vote = 'Voor') AS Voor, count(*) FILTER (vote = 'Tegen') AS Tegen FROM speech_vote_pairs WHERE fractie IN (SELECT fractie FROM k) GROUP BY 1""")
def largest_parties_votes(t):
    return reports.crosstab(reports.largest_groups(t("speech_vote_pairs"), "fractie", 15), F.col("fractie"), "vote", ["Voor", "Tegen"])


@query("SELECT vote, round(avg(speech_length), 6) AS gemiddeld, CAST(sum(speech_length) AS BIGINT) AS som, count(*) AS n FROM speech_vote_pairs GROUP BY vote")
def lengths_by_vote(t):
    return t("speech_vote_pairs").groupBy("vote").agg(F.round(F.avg("speech_length"), 6).alias("gemiddeld"), F.sum("speech_length").alias("som"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT * FROM fractie WHERE Id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY Id ORDER BY ApiGewijzigdOp DESC, snapshot_id DESC) = 1)
SELECT Afkorting, AantalZetels FROM l WHERE DatumInactief IS NULL AND AantalZetels > 0 ORDER BY AantalZetels DESC, Afkorting LIMIT 15""")
def seats_top(t):
    f = t("fractie").where("Id is not null").select("Id", "snapshot_id", "ApiGewijzigdOp", "Afkorting", "AantalZetels", "DatumInactief")
    last = dedup.keep_by(f, ["Id"], [F.col("ApiGewijzigdOp"), F.col("snapshot_id")])
    return clean.active(last, "DatumInactief", "AantalZetels").orderBy(F.desc("AantalZetels"), "Afkorting").limit(15).select("Afkorting", "AantalZetels")


# ---- streams, as batch ------------------------------------------------------------------------


@query("SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(t):
    w = streams.windowed_counts(t("events"))
    return w.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 600000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    s = streams.sessions(t("events"))
    return s.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


# ---- models (no SQL) --------------------------------------------------------------------------


def _features(t) -> tuple[DataFrame, DataFrame]:
    from plenaria.ml import models

    train, rest = _split(t)
    cols = ["pair_id", "persoon_id", "fractie", "stemmings_soort", "vote", "speech_position", "speech_text", "besluit_tekst"]
    out = []
    for d in (train, rest):
        h = features.basic(features.history(train, features.speaker_loyalty(train, d.select(*cols)), "stemmings_soort"))
        out.append(models.filled(h, ["fractie", "stemmings_soort"], NUMERIC, ["speech_text", "besluit_tekst"]))
    return models.labelled(out[0]), out[1]


NUMERIC = ["speaker_loyalty", "speech_position", "party_domain_voor_rate", "party_recent_voor_rate", "speaker_topic_loyalty", "speech_length", "n_voor", "n_tegen"]


@query()
def model_logistic(t):
    """Held-out scores of the text and structure model; words of the speech, words and pairs of words of the decision."""
    from plenaria.ml import models

    train, rest = _features(t)
    texts = {"tekst": models.tf_idf("speech_text", "tekst"), "besluit": models.tf_idf("besluit_tekst", "besluit", 500, least=1.0, pairs=True)}
    m = models.logistic(["fractie"], NUMERIC, texts).fit(cut(train))
    return metrics.scores(models.predicted(m, rest), "vote", "prediction_vote")


#: What the structural model (M9) sees; the topic is of M13.
KINDS = ["fractie", "topic_cluster", "zaak_soort", "kabinetsappreciatie"]
STRUCTURE = ["is_coalition", "speaker_loyalty", "speech_position", "party_domain_voor_rate", "party_domain_vote_count", "party_recent_voor_rate", "speaker_topic_loyalty"]


def _stack_features(t) -> dict[str, DataFrame]:
    """The usable pairs of each split with the features of both base models; topics and rates are learnt on the training years."""
    from plenaria.ml import models

    cols = ["pair_id", "persoon_id", "besluit_id", "fractie", "vote", "datum", "speech_position", "speech_text", "agendapunt_onderwerp", "split"]
    topic = models.topic_text(F.col("besluit_tekst"), F.col("agendapunt_onderwerp"))
    train, rest = _split(t)
    both = cut(train.unionByName(rest).select(*cols, topic.alias("onderwerp")))
    topics = models.topics(both.where("split = 'train'"), "onderwerp")
    both = cut(topics.transform(both).select(*cols, "topic_cluster"))
    train = both.where("split = 'train'")
    cases = features.enrich_topics(both, "agendapunt_onderwerp", t("zaak"))
    h = features.history(train, features.speaker_loyalty(train, both), "topic_cluster")
    h = features.attach(h, cases, ["agendapunt_onderwerp"], {"kabinetsappreciatie": features.UNKNOWN, "zaak_soort": features.UNKNOWN})
    h = features.basic(features.in_coalition(h, _coalition(t), "datum"))
    h = cut(models.filled(h, ["fractie"], [*STRUCTURE, "speech_length", "n_voor", "n_tegen"], ["speech_text"]))
    return {k: h.where(F.col("split") == k) for k in ("train", "val", "test")}


@query()
def model_stacked(t):
    """Scores on every usable pair of the test years: a logistic model over a text and a structural one, fitted on the years between.

    The bases have the reference's sizes; words and party take the place of its transformer.
    """
    from plenaria.ml import models

    d = _stack_features(t)
    train = models.labelled(d["train"])
    text = models.logistic(["fractie"], ["speech_length", "n_voor", "n_tegen"], {"tekst": models.tf_idf("speech_text", "tekst")}).fit(train)
    structure = models.boosted(KINDS, STRUCTURE, 500, 6).fit(train)

    def based(x: DataFrame) -> DataFrame:
        return models.predicted(text, models.predicted(structure, x, "g1", "p1"), "g2", "p2").withColumns(models.stacking_inputs("p1", "p2"))

    top = models.logistic([], ["p1", "p2", "agree", "apart", "is_coalition", "party_domain_voor_rate", "topic_cluster"], None, 500).fit(models.labelled(cut(based(d["val"]))))
    return metrics.scores(cut(models.predicted(top, based(d["test"])).select("pair_id", "vote", "prediction_vote")), "vote", "prediction_vote")


@query()
def topic_clusters(t):
    """Size of every topic cluster, over the decisions' texts and subjects."""
    from plenaria.ml import models

    topic = models.topic_text(F.col("besluit_tekst"), F.col("agendapunt_onderwerp"))
    d = cut(t("speech_vote_pairs").select("besluit_id", "besluit_tekst", "agendapunt_onderwerp").distinct().withColumn("onderwerp", topic))
    return models.topics(d, "onderwerp").transform(d).groupBy("topic_cluster").agg(F.count("*").alias("n"))


@query()
def embedding_clusters(t):
    """k-means over the given embeddings: size and purity of each cluster against the given labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = t("embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    c = KMeans(k=10, seed=42).fit(d).transform(d).groupBy("prediction", "label").agg(F.count("*").alias("n"))
    per = Window.partitionBy("prediction")  # at most labels x clusters rows
    return c.withColumn("most", F.max("n").over(per)).groupBy("prediction").agg(F.sum("n").alias("n"), F.max("most").alias("zuiver"))
