"""The topic query reads both texts and makes the reference's number of clusters."""

from plenaria.ml import models
from plenaria.plans import reference


def test_topics_of_both_texts_at_the_defaults(spark, data, monkeypatch):
    topics, seen = models.topics, []

    def watched(d, text, *sizes, **named):
        seen.append((d, text, sizes, named))
        return topics(d, text, *sizes, **named)

    monkeypatch.setattr(models, "topics", watched)
    got = reference.QUERIES["topic_clusters"](spark, data).collect()
    d, text, sizes, named = seen[0]
    assert not sizes and not named
    pairs = spark.read.parquet(f"{data}/speech_vote_pairs.parquet").select("besluit_id", "besluit_tekst", "agendapunt_onderwerp").distinct().collect()
    want = sorted(f"{r.besluit_tekst or ''} {r.agendapunt_onderwerp or ''}".strip() or "onbekend" for r in pairs)
    assert sorted(r[text] for r in d.select(text).collect()) == want
    assert sum(r.n for r in got) == len(pairs) and 10 < len(got) <= 20
