"""Models of the vote, as pyspark.ml pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.operators.metrics import class_weights

CATEGORICAL = ["fractie"]


def labelled(df: DataFrame, vote: str = "vote") -> DataFrame:
    """Votes for and against with label 1 and 0, and balanced weights."""
    d = df.where(F.col(vote).isin("Voor", "Tegen")).withColumn("label", (F.col(vote) == "Voor").cast("double"))
    w = class_weights(d, "label").select(F.col("label").alias("__l"), "weight")
    return d.join(F.broadcast(w), F.col("label") == F.col("__l")).drop("__l")  # one row a class


def one_hot(columns: list[str]) -> list:
    """Categories as vectors; one unseen in training is all zeros."""
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_i" for c in columns], handleInvalid="keep", stringOrderType="frequencyDesc")
    return [index, OneHotEncoder(inputCols=[f"{c}_i" for c in columns], outputCols=[f"{c}_v" for c in columns], dropLast=True)]


def tf_idf(text: str, out: str, features: int = 5000, most: float = 0.95, least: float = 2.0, pairs: bool = False) -> list:
    """Words of two letters or more (and their pairs), weighted and of unit length."""
    stages = [RegexTokenizer(inputCol=text, outputCol=f"{out}_w", pattern=r"(?U)\b\w\w+\b", gaps=False)]
    source = f"{out}_w"
    if pairs:
        stages.append(NGram(n=2, inputCol=source, outputCol=f"{out}_2"))
        stages.append(CountVectorizer(inputCol=f"{out}_2", outputCol=f"{out}_2c", vocabSize=features, minDF=least, maxDF=most))
    stages += [
        CountVectorizer(inputCol=source, outputCol=f"{out}_c", vocabSize=features, minDF=least, maxDF=most),
        IDF(inputCol=f"{out}_c", outputCol=f"{out}_i"),
    ]
    if not pairs:
        return [*stages, Normalizer(inputCol=f"{out}_i", outputCol=out)]
    return [*stages, IDF(inputCol=f"{out}_2c", outputCol=f"{out}_2i"), VectorAssembler(inputCols=[f"{out}_i", f"{out}_2i"], outputCol=f"{out}_a"), Normalizer(inputCol=f"{out}_a", outputCol=out)]


def filled(df: DataFrame, categorical: list[str], numeric: list[str], texts: list[str] = ()) -> DataFrame:
    """Missing categories 'Onbekend', shares and places 0.5, other numbers 0, texts ''."""
    half = {c for c in numeric if any(k in c for k in ("rate", "loyalty", "position"))}
    out = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    out = out.na.fill({c: "Onbekend" for c in categorical} | {c: 0.5 if c in half else 0.0 for c in numeric})
    return out.withColumns({t: F.coalesce(t, F.lit("")) for t in texts})


def _pipeline(categorical: list[str], numeric: list[str], texts: dict[str, list], model) -> Pipeline:
    stages = (one_hot(categorical) if categorical else []) + [s for ss in texts.values() for s in ss]
    inputs = [f"{c}_v" for c in categorical] + numeric + list(texts)
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), model])


def logistic(categorical: list[str], numeric: list[str], texts: dict[str, list] | None = None, rounds: int = 100, **kw) -> Pipeline:
    return _pipeline(categorical, numeric, texts or {}, LogisticRegression(weightCol="weight", maxIter=rounds, **kw))


def boosted(categorical: list[str], numeric: list[str], trees: int = 100, depth: int = 4, seed: int = 42) -> Pipeline:
    return _pipeline(categorical, numeric, {}, GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed))


def forest(categorical: list[str], numeric: list[str], trees: int = 100, depth: int = 10, seed: int = 42) -> Pipeline:
    return _pipeline(categorical, numeric, {}, RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed))


def probability(vector: str = "probability", of: int = 1) -> Column:
    return vector_to_array(vector)[of]


def predicted(model: PipelineModel, df: DataFrame, out: str = "prediction_vote", p: str = "p_voor") -> DataFrame:
    """Predicted vote and the probability of a vote for; the pipeline's own columns are dropped."""
    scored = model.transform(df)
    return scored.select(*df.columns, F.when(F.col("prediction") == 1, "Voor").otherwise("Tegen").alias(out), probability().alias(p))


def topics(df: DataFrame, text: str, k: int = 20, features: int = 2000, seed: int = 42) -> PipelineModel:
    """Clusters of topics by their words; empty texts are 'onbekend' (see ``topic_text``)."""
    return Pipeline(stages=[*tf_idf(text, "topic_features", features), KMeans(k=k, seed=seed, featuresCol="topic_features", predictionCol="topic_cluster")]).fit(df)


def topic_text(*parts: Column) -> Column:
    joined = F.trim(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.when(joined == "", "onbekend").otherwise(joined)


def stacking_inputs(p1: str, p2: str) -> dict[str, Column]:
    """What the stacked model sees of two models: both, whether they agree and how far they differ."""
    a, b = F.col(p1), F.col(p2)
    return {"agree": ((a >= 0.5) == (b >= 0.5)).cast("double"), "apart": F.abs(a - b)}


def coefficients(model: PipelineModel, df: DataFrame, top: int = 15) -> list[tuple[str, float]]:
    """The features with the largest coefficients by size, named by the assembled columns."""
    lr = model.stages[-1]
    meta = model.transform(df.limit(1)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for kind in meta.values() for a in kind}
    ranked = sorted(enumerate(lr.coefficients.toArray()), key=lambda x: -abs(x[1]))[:top]
    return [(names.get(i, str(i)), float(v)) for i, v in ranked]


def contributions(model: PipelineModel, scored: DataFrame, means: list[float], vector: str = "features", out: str = "contributions") -> DataFrame:
    """Linear contributions of a logistic model: coefficient times distance from the mean."""
    coef = [float(x) for x in model.stages[-1].coefficients.toArray()]
    c, m = F.array(*[F.lit(x) for x in coef]), F.array(*[F.lit(float(x)) for x in means])
    centred = F.zip_with(vector_to_array(vector), m, lambda x, y: x - y)
    return scored.withColumn(out, F.zip_with(centred, c, lambda x, y: x * y))


def with_scorer(df: DataFrame, text: Column, load: Callable[[], Callable[[list[str]], list]], out: str = "p_text", kind: str = "double") -> DataFrame:
    """Scores of any text model: ``load`` is called once in a task and gives a function over a batch of texts.

    With ``kind`` 'array<double>' it gives a vector for each text (sentence embeddings), of any length.
    """

    @F.pandas_udf(kind)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load()
        for s in parts:
            got = f(s.fillna("").tolist())
            yield pd.Series(got, index=s.index, dtype="float64") if kind == "double" else pd.Series([[float(x) for x in v] for v in got], index=s.index, dtype="object")

    return df.withColumn(out, score(text))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
