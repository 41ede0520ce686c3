"""Queries of the general data problems (3, 4 and 7) and their SQL on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenaria.operators import asof, history, instants
from plenaria.runtime import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return asof.found(*(table(spark, root, t) for t in ("speech_vote_pairs", "fractiezetelpersoon", "coalitie", "fractie")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return instants.found(table(spark, root, "activiteit"), table(spark, root, "fractie"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return history.found(table(spark, root, "fractie"))


def p7_versions(spark: SparkSession, root: str) -> DataFrame:
    """The whole history with its values, as text."""
    v = history.party_versions(table(spark, root, "fractie"))
    return v.withColumnRenamed("entity", "fractie_id")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p7_found": p7_found, "p7_versions": p7_versions}

_P3 = """
WITH e AS (
  SELECT DISTINCT pair_id, persoon_id, fractie, is_coalition, TRY_CAST(datum AS DATE) AS d
  FROM speech_vote_pairs WHERE persoon_id IS NOT NULL AND TRY_CAST(datum AS DATE) IS NOT NULL
), ev AS (SELECT DISTINCT persoon_id, d FROM e),
known AS (
  SELECT a.persoon_id, a.d, m.* FROM ev a JOIN fractiezetelpersoon m
  ON m.Persoon_Id = a.persoon_id AND epoch_us(m.GewijzigdOp) < epoch_us(CAST(a.d AS TIMESTAMP))
  QUALIFY row_number() OVER (PARTITION BY a.persoon_id, a.d, m.Id ORDER BY m.GewijzigdOp DESC, m.ApiGewijzigdOp DESC, m.Fractie_Id DESC, m.TotEnMet DESC) = 1
), member AS (
  SELECT persoon_id, d, Fractie_Id AS f FROM known
  WHERE epoch_us(Van) <= epoch_us(CAST(d AS TIMESTAMP)) AND (TotEnMet IS NULL OR epoch_us(TotEnMet) >= epoch_us(CAST(d AS TIMESTAMP)))
  QUALIFY row_number() OVER (PARTITION BY persoon_id, d ORDER BY GewijzigdOp DESC, ApiGewijzigdOp DESC, Fractie_Id DESC) = 1
), fd AS (SELECT DISTINCT f, d FROM member),
part AS (
  SELECT fd.f, fd.d, c.is_coalition AS c FROM fd JOIN coalitie c ON c.fractie_id = fd.f
  AND epoch_us(c.bekend_op) < epoch_us(CAST(fd.d AS TIMESTAMP)) AND epoch_us(c.van) <= epoch_us(CAST(fd.d AS TIMESTAMP))
  AND (c.tot_en_met IS NULL OR epoch_us(c.tot_en_met) >= epoch_us(CAST(fd.d AS TIMESTAMP)))
  QUALIFY row_number() OVER (PARTITION BY fd.f, fd.d ORDER BY c.bekend_op DESC, c.coalitie_id DESC) = 1
), afk AS (SELECT Id, min(Afkorting) AS a FROM fractie GROUP BY Id)
SELECT DISTINCT e.pair_id, coalesce(m.f, '') AS fractie_id, CAST(coalesce(p.c, 0) AS INTEGER) AS is_coalition
FROM e LEFT JOIN member m ON m.persoon_id = e.persoon_id AND m.d = e.d
LEFT JOIN part p ON p.f = m.f AND p.d = e.d LEFT JOIN afk ON afk.Id = m.f
WHERE e.fractie IS DISTINCT FROM afk.a OR e.is_coalition IS DISTINCT FROM coalesce(p.c, 0)
"""

_P4 = r"""
WITH t AS (
  SELECT 'activiteit' AS tabel, Id AS sleutel, Datum AS x FROM activiteit
  UNION SELECT 'fractie', CAST(snapshot_id AS VARCHAR), GewijzigdOp FROM fractie
), c AS (SELECT tabel, sleutel, trim(regexp_replace(replace(lower(x), chr(160), ' '), '\s+', ' ', 'g')) AS x FROM t WHERE x IS NOT NULL),
epoch AS (
  SELECT tabel, sleutel, CASE
    WHEN regexp_full_match(x, '-?\d{9,10}') THEN TRY_CAST(x AS BIGINT) * 1000000
    WHEN regexp_full_match(x, '\d{12,13}') THEN TRY_CAST(x AS BIGINT) * 1000
    ELSE TRY_CAST(regexp_extract(x, '^/date\((-?\d+)([+-]\d{4})?\)/$', 1) AS BIGINT) * 1000 END AS utc_us FROM c
), g AS (
  SELECT *, CASE
    WHEN regexp_full_match(x, '\d{4}[-/]\d{2}[-/]\d{2}.*') THEN regexp_extract(x, '^(\d{4})[-/](\d{2})[-/](\d{2})[t ]?(?:(\d{1,2}):(\d{2}))?(?::(\d{2}))?(?:\.(\d+))?( ?(?:z|utc|gmt|cest|cet|[+-]\d{2}:?\d{0,2}))?(?:\[europe/amsterdam\])?()()$', ['y','m','d','h','i','s','f','z','p','n'])
    WHEN regexp_full_match(x, '\d{8}(t\d{4})?') THEN regexp_extract(x, '^(\d{4})(\d{2})(\d{2})t?(\d{2})?(\d{2})?()()()()()$', ['y','m','d','h','i','s','f','z','p','n'])
    WHEN regexp_full_match(x, '.* [ap]m') THEN regexp_extract(x, '^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})()()() ([ap])m()$', ['m','d','y','h','i','s','f','z','p','n'])
    WHEN regexp_full_match(x, '\d{1,2}[-./]\d{1,2}[-./]\d{4}.*') THEN regexp_extract(x, '^(\d{1,2})[-./](\d{1,2})[-./](\d{4}) ?(?:(\d{1,2})[:.](\d{2}))?(?::(\d{2}))?()(?: uur)?( (?:cest|cet|utc))?()()$', ['d','m','y','h','i','s','f','z','p','n'])
    ELSE regexp_extract(x, '^(?:[a-z]+,? )?(\d{1,2}) ([a-z]+)\.? (\d{4}),? ?(?:om )?(?:(\d{1,2})[:.](\d{2}))?(?::(\d{2}))?(?: uur)?( gmt)?()()()$', ['d','n','y','h','i','s','z','f','p','m'])
    END AS q FROM c
), r AS (
  SELECT tabel, sleutel, q.z AS z, q.f AS f, TRY_CAST(q.y AS INT) AS y, TRY_CAST(q.d AS INT) AS d,
    coalesce(TRY_CAST(q.m AS INT), CASE left(q.n, 3) WHEN 'jan' THEN 1 WHEN 'feb' THEN 2 WHEN 'maa' THEN 3 WHEN 'mrt' THEN 3 WHEN 'mar' THEN 3 WHEN 'apr' THEN 4
      WHEN 'mei' THEN 5 WHEN 'may' THEN 5 WHEN 'jun' THEN 6 WHEN 'jul' THEN 7 WHEN 'aug' THEN 8 WHEN 'sep' THEN 9 WHEN 'okt' THEN 10 WHEN 'oct' THEN 10 WHEN 'nov' THEN 11 WHEN 'dec' THEN 12 END) AS m,
    CASE WHEN q.p = '' THEN coalesce(TRY_CAST(q.h AS INT), 0) ELSE TRY_CAST(q.h AS INT) % 12 + CASE q.p WHEN 'p' THEN 12 ELSE 0 END END AS h,
    coalesce(TRY_CAST(q.i AS INT), 0) AS i, coalesce(TRY_CAST(q.s AS INT), 0) AS s FROM g
), l AS (
  SELECT *, try_strptime(printf('%04d-%02d-%02d', y, m, d), '%Y-%m-%d') AS day, coalesce(TRY_CAST(rpad(left(f, 6), 6, '0') AS BIGINT), 0) AS us
  FROM r WHERE y > 1 AND y < 9999 AND h <= 23 AND i <= 59 AND s <= 59
), o AS (
  SELECT *, day + to_hours(h) + to_minutes(i) + to_seconds(s) AS t,
    make_date(y, 3, 31) - CAST(dayofweek(make_date(y, 3, 31)) AS INT) + to_hours(3) AS spring,
    make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INT) + to_hours(3) AS autumn,
    regexp_replace(z, '[^0-9]', '', 'g') AS digits FROM l WHERE day IS NOT NULL
), w AS (
  SELECT tabel, sleutel, epoch_us(t) + us - CAST(60000000 AS BIGINT) * CASE trim(z)
    WHEN '' THEN CASE WHEN t >= spring AND t < autumn THEN 120 ELSE 60 END
    WHEN 'z' THEN 0 WHEN 'utc' THEN 0 WHEN 'gmt' THEN 0 WHEN 'cet' THEN 60 WHEN 'cest' THEN 120
    ELSE (TRY_CAST(left(digits, 2) AS INT) * 60 + coalesce(TRY_CAST(substr(digits, 3, 2) AS INT), 0)) * CASE left(trim(z), 1) WHEN '-' THEN -1 ELSE 1 END END AS utc_us FROM o
)
SELECT DISTINCT tabel, sleutel, CAST(utc_us AS BIGINT) AS utc_us FROM (
  SELECT * FROM epoch WHERE utc_us IS NOT NULL UNION ALL
  SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM epoch e WHERE e.tabel = w.tabel AND e.sleutel = w.sleutel AND e.utc_us IS NOT NULL))
"""

_P7 = """
WITH one AS (
  SELECT * FROM fractie WHERE Id IS NOT NULL AND ApiGewijzigdOp IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY Id, ApiGewijzigdOp ORDER BY snapshot_id DESC) = 1
), f AS (
  SELECT *, row_number() OVER w AS n, lag(DatumActief) OVER w AS a, lag(DatumInactief) OVER w AS i, lag(AantalZetels) OVER w AS z
  FROM one WINDOW w AS (PARTITION BY Id ORDER BY ApiGewijzigdOp)
), v AS (
  SELECT * FROM f WHERE n = 1 OR a IS DISTINCT FROM DatumActief OR i IS DISTINCT FROM DatumInactief OR z IS DISTINCT FROM AantalZetels
)
SELECT Id AS fractie_id, epoch_us(ApiGewijzigdOp) AS van_us, {tot} AS tot_us{rest} FROM v WINDOW w AS (PARTITION BY Id ORDER BY ApiGewijzigdOp)
"""
_NEXT = "epoch_us(lead(ApiGewijzigdOp) OVER w)"

SQL = {
    "p3_found": _P3,
    "p4_found": _P4,
    "p7_found": _P7.format(tot=f"coalesce({_NEXT}, -1)", rest=""),
    "p7_versions": _P7.format(
        tot=_NEXT,
        rest=", CAST(epoch_us(DatumActief) AS VARCHAR) AS DatumActief, CAST(epoch_us(DatumInactief) AS VARCHAR) AS DatumInactief, CAST(AantalZetels AS VARCHAR) AS AantalZetels",
    ),
}
