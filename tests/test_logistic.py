"""The logistic query has the operators' default sizes and reads the decisions."""

from pyspark.ml.feature import CountVectorizer, NGram

from plenaria.ml import models
from plenaria.plans import reference


def test_logistic_has_its_default_sizes_and_pairs_of_words(spark, data, monkeypatch):
    logistic, seen = models.logistic, []

    def small(kinds, numeric, texts=None, rounds=100):
        seen.append((texts, rounds))
        return logistic(kinds, numeric, texts, 3)

    monkeypatch.setattr(models, "logistic", small)
    assert reference.QUERIES["model_logistic"](spark, data).count() == 1
    (texts, rounds), stages = seen[0], [s for ss in seen[0][0].values() for s in ss]
    assert rounds == 100 and len(seen) == 1 and len(texts) == 2
    assert [s.getVocabSize() for s in stages if isinstance(s, CountVectorizer)] == [5000, 500, 500]
    assert [s.getInputCol() for s in stages if isinstance(s, NGram)] == ["besluit_w"] and texts["besluit"][0].getInputCol() == "besluit_tekst"
