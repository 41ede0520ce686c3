"""Vectors of a text model, and sample weights with a mean of one."""

from pyspark.sql import functions as F

from plenaria.ml import models
from plenaria.operators import metrics


def test_scorer_gives_a_vector_of_768_for_each_text(spark):
    d = spark.createDataFrame([(n, "x" * n if n % 3 else None) for n in range(20)], "n int, tekst string")
    got = models.with_scorer(d, F.col("tekst"), lambda: lambda ts: [[float(len(t))] * 768 for t in ts], "v", "array<double>")
    assert dict(got.dtypes)["v"] == "array<double>"
    rows = got.collect()
    assert len(rows) == 20 and all(r.v == [float(r.n if r.n % 3 else 0)] * 768 for r in rows)


def test_weights_are_normalised_by_their_mean(spark):
    d = spark.createDataFrame([(True, 0.9, 1.0), (True, 0.6, 1.0), (False, 0.1, 3.0)], "ok boolean, p double, before double")
    w = metrics.normalised(d.withColumn("w", metrics.reweighted(F.col("ok"), F.col("p"), F.col("before"))), "w").collect()
    plain = [0.65, 1.25, 2.5]
    assert sorted(round(r.w, 9) for r in w) == [round(x * 3 / sum(plain), 9) for x in plain]
    assert d.columns == [c for c in w[0].asDict() if c != "w"]
