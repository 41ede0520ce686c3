"""The stacked model fits and scores the rows of the reference, at its sizes."""

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from plenaria.ml import models
from plenaria.operators import features
from plenaria.plans import reference


def test_stacked_fits_on_val_and_scores_all_of_test(spark, data, monkeypatch):
    sizes, fitted, scored = [], [], []
    boosted, logistic, labelled, scores = models.boosted, models.logistic, models.labelled, reference.metrics.scores
    ids = lambda d: sorted(r.pair_id for r in d.select("pair_id").collect())

    def small_boosted(kinds, numeric, trees=100, depth=4):
        sizes.append(("boosted", trees, depth))
        return boosted(kinds, numeric, 2, 2)

    def small_logistic(kinds, numeric, texts=None, rounds=100):
        words = [s.getVocabSize() for ss in (texts or {}).values() for s in ss if isinstance(s, CountVectorizer)]
        sizes.append(("logistic", tuple(numeric[-3:]), tuple(words), rounds))
        return logistic(kinds, numeric, texts, 3)

    monkeypatch.setattr(models, "boosted", small_boosted)
    monkeypatch.setattr(models, "logistic", small_logistic)
    monkeypatch.setattr(models, "labelled", lambda d: fitted.append(ids(d)) or labelled(d))
    monkeypatch.setattr(reference.metrics, "scores", lambda d, *a: scored.append(ids(d)) or scores(d, *a))
    assert reference.QUERIES["model_stacked"](spark, data).count() == 1

    pairs = spark.read.parquet(f"{data}/speech_vote_pairs.parquet").dropDuplicates(["pair_id"])
    by = features.usable(features.split_by_year(pairs, "datum", 2016, 2020))
    want = {k: ids(by.where(F.col("split") == k)) for k in ("train", "val", "test")}
    assert fitted == [want["train"], want["val"]] and scored == [want["test"]]
    assert sorted(sizes) == [
        ("boosted", 500, 6),
        ("logistic", ("is_coalition", "party_domain_voor_rate", "topic_cluster"), (), 500),
        ("logistic", ("speech_length", "n_voor", "n_tegen"), (5000,), 100),
    ]


def test_structural_features_are_whole(spark, data):
    d = reference._stack_features(lambda name: spark.read.parquet(f"{data}/{name}.parquet"))
    for x in d.values():
        assert x.count() == x.select("pair_id").distinct().count() > 0
        for c in (*reference.KINDS, *reference.STRUCTURE):
            assert x.where(F.col(c).isNull()).count() == 0
    assert d["train"].select("topic_cluster").distinct().count() > 10
    assert d["train"].agg(F.sum("party_domain_vote_count")).first()[0] >= d["train"].where("fractie <> 'Onbekend'").count()
