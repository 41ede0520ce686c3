import numpy as np
import pytest
from pyspark.sql import functions as F

from plenaria.ml import models
from plenaria.streaming import events


@pytest.fixture(scope="module")
def votes(spark):
    rows = [("A" if n % 3 else "B", "Voor" if (n % 3 and n % 7) else "Tegen", float(n % 5), "wij steunen dit voorstel" if n % 2 else "wij zijn tegen dit plan") for n in range(200)]
    return spark.createDataFrame(rows, "fractie string, vote string, speech_length double, tekst string")


@pytest.mark.parametrize("kind", ["logistic", "boosted", "forest"])
def test_models_learn_and_know_no_unseen_party(spark, votes, kind, tmp_path):
    make = {
        "logistic": lambda: models.logistic(["fractie"], ["speech_length"], {"t": models.tf_idf("tekst", "t", 50, 0.95, 1.0, pairs=True)}, 20),
        "boosted": lambda: models.boosted(["fractie"], ["speech_length"], 5, 3),
        "forest": lambda: models.forest(["fractie"], ["speech_length"], 10, 4),
    }[kind]()
    m = make.fit(models.labelled(votes))
    unseen = votes.limit(1).withColumn("fractie", F.lit("nieuw"))
    got = models.predicted(m, votes.unionByName(unseen))
    assert got.count() == 201 and set(got.columns) == {*votes.columns, "prediction_vote", "p_voor"}
    assert got.where("prediction_vote = vote").count() > 160
    if kind == "logistic":
        models.save(m, str(tmp_path / "m"))
        again = models.predicted(models.load(str(tmp_path / "m")), votes)
        assert again.exceptAll(models.predicted(m, votes)).count() == 0
        assert len(models.coefficients(m, models.labelled(votes), 3)) == 3
        t = m.transform(models.labelled(votes))
        n = len(m.stages[-1].coefficients)
        c = models.contributions(m, t, [0.0] * n).select("contributions", "features").first()
        assert np.allclose(c.contributions, m.stages[-1].coefficients.toArray() * c.features.toArray())


def test_filling_topics_scorer_stacking(spark, votes):
    df = spark.createDataFrame([(None, None, None, None)], "fractie string, speaker_loyalty double, n int, t string")
    assert tuple(models.filled(df, ["fractie"], ["speaker_loyalty", "n"], ["t"]).first()) == ("Onbekend", 0.5, 0.0, "")
    texts = spark.createDataFrame([("water natuur",), ("water bos",), ("geld bank",), (None,), ("geld beurs",)], "o string").withColumn("x", models.topic_text(F.col("o")))
    assert [r.x for r in texts.where("o is null").collect()] == ["onbekend"]
    assert models.topics(texts, "x", 2, 20).transform(texts).select("topic_cluster").distinct().count() == 2
    scored = models.with_scorer(votes, F.col("tekst"), lambda: lambda ts: [float(len(t)) for t in ts])
    assert scored.where(F.col("p_text") != F.length("tekst")).count() == 0
    s = spark.createDataFrame([(0.4, 0.7)], "a double, b double").select(*models.stacking_inputs("a", "b").values()).first()
    assert s[0] == 0.0 and round(s[1], 6) == 0.3


def test_stream_equals_batch_and_reads_each_file_once(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    e.where("event_id % 2 = 0").write.parquet(src)
    stream = events.new_files(spark, src, e.schema).select("event_id", "event_type")

    def run():
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    half = e.where("event_id % 2 = 0").count()
    assert run() == half and run() == half
    e.where("event_id % 2 = 1").write.mode("append").parquet(src)
    assert run() == e.count()


def test_late_events_are_dropped_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    src = tmp_path / "in"
    for n, rows in enumerate([[("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 14:00:00", "a", 1.0)], [("2024-01-01 18:00:00", "b", 1.0)], [("2024-01-01 10:30:00", "a", 1.0)], [("2024-01-01 23:00:00", "c", 1.0)]]):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").coalesce(1).write.parquet(str(src / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = events.windowed_counts(stream).writeStream.format("memory").queryName("geteld").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.event_type, r.n) for r in spark.sql("select * from geteld").collect())
    assert got == [("a", 1), ("a", 1), ("b", 1)]
