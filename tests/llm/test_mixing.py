import os
from collections import Counter

import pytest

from plenaria.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabularies")
DOC, TARGET = "doc_id long, source string, text string, n_tokens int", "source string, doel_aandeel double, max_herhaling int"


def docs(spark, n=400):
    rows = [(i, ["groot", "klein", "dubbel"][0 if i % 10 else 1 + (i // 10) % 2], f"tekst nummer {i} " + "woord " * (i % 17), -1) for i in range(n)]
    rows += [(n + 1, "groot", "dezelfde tekst", -1), (n + 2, "klein", "dezelfde tekst", -1), (n + 3, "klein", None, -1), (n + 4, "klein", "", -1), (n + 5, None, "zonder bron", -1), (n + 6, "ander", "geen doel", -1)]
    return spark.createDataFrame(rows, DOC)


def targets(spark):
    return spark.createDataFrame([("groot", 0.5, 1), ("klein", 0.2, 4), ("dubbel", 0.2, 3), ("weg", 0.1, 2), (None, 0.3, 1), ("nul", 0.0, 5), ("null", None, None)], TARGET)


def test_shares_caps_and_order(spark):
    d = docs(spark)
    mixture, plans = mixing.mix(d, targets(spark))
    rows = mixture.collect()
    assert [r.positie for r in rows] == sorted(r.positie for r in rows) and 0 <= rows[0].positie and rows[-1].positie <= 1
    size = Counter()
    for r in rows:
        size[r.source] += r.n_tokens
    total = sum(size.values())
    for s, share in {"groot": 5 / 9, "klein": 2 / 9, "dubbel": 2 / 9}.items():
        assert abs(size[s] / total - share) < 0.01
    text = {r.doc_id: r.text for r in d.collect()}
    cap = {"groot": 1, "klein": 4, "dubbel": 3}
    for (t, s), k in Counter((text[r.doc_id], r.source) for r in rows).items():
        assert t and k <= cap[s]
    assert len({r.source for r in rows if text[r.doc_id] == "dezelfde tekst"}) == 1
    assert len({(r.doc_id, r.herhaling) for r in rows}) == len(rows)
    used = [p for p in plans if p.demand]
    assert any(p.demand == pytest.approx(p.available * p.repeats) for p in used)  # no larger mixture would do


def test_schedule_integrates_to_the_shares():
    plans = [mixing.Plan("a", 0.5, 0.5, 0.9, 900, 1, 50.0), mixing.Plan("b", 0.5, 0.5, 0.1, 100, 1, 50.0)]
    lean = mixing.tilt(plans)
    for p in plans:
        k = lean * (p.natural - p.share)
        w = [p.share + k * (1 - 2 * (i + 0.5) / 1000) for i in range(1000)]
        assert min(w) >= 0 and abs(sum(w) / 1000 - p.share) < 1e-9
    assert mixing.tilt([]) == 1.0


def test_inverse(spark):
    from pyspark.sql import functions as F

    for share, k in ((0.3, 0.2), (0.3, -0.2), (0.3, 0.0), (0.1, 0.0999)):
        df = spark.range(0, 101).select((F.col("id") / 100).alias("t")).withColumn("o", 1000 * (share * F.col("t") + k * (F.col("t") - F.col("t") ** 2)))
        worst = df.select(F.max(F.abs(mixing.moment(F.col("o"), F.lit(share), F.lit(k), 1000.0) - F.col("t")))).first()[0]
        assert worst < 1e-6


def test_prefix_sums(spark):
    t = spark.createDataFrame([(f"d{i}", "s" if i % 3 else None, i, i % 7 + 1) for i in range(200)], "digest string, source string, doc_id long, n_tokens int")
    rows = mixing.with_offsets(t, 8).collect()
    assert len(rows) == 200
    for s in ("s", None):
        own = sorted((r.before, r.n_tokens) for r in rows if r.source == s)
        at = 0
        for b, n in own:
            assert b == at
            at += n


def test_report_and_nothing(spark):
    got = {r.source: r for r in mixing.shares(docs(spark), targets(spark)).collect()}
    assert set(got) == {"groot", "klein", "dubbel", "weg", "nul", "null"}
    assert got["weg"].aandeel == 0 and got["weg"].tokens == 0 and abs(sum(r.aandeel for r in got.values()) - 1) < 1e-5
    none = docs(spark).limit(0)
    assert mixing.mix(none, targets(spark))[0].count() == 0 and mixing.mix(docs(spark), targets(spark).limit(0))[0].count() == 0
