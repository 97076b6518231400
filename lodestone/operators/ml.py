"""Clustering, regression and classification through pyspark.ml, and k-means as a loop of aggregations."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import squared_distance


def nearest_centre(features, centres: list[list[float]]):
    """Index of the nearest centre; ties by the first."""
    distances = F.array(*(F.struct(squared_distance(features, F.array(*map(F.lit, map(float, c)))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)))
    return F.array_min(distances)["i"]


def kmeans_step(df: DataFrame, features: str, centres: list[list[float]]) -> DataFrame:
    """(cluster, n, centre): one round, partial sums combined before the shuffle."""
    dims = range(len(centres[0]))
    near = df.select(nearest_centre(features, centres).alias("cluster"), F.col(features).alias("f"))
    return near.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("f")[i]) for i in dims)).alias("centre"))


def kmeans(df: DataFrame, key: str, features: str, k: int, epsilon: float = 1e-6, rounds: int | None = None, centres: list[list[float]] | None = None) -> list[list[float]]:
    """Centres, at first those given or the first k rows by key, moved until the mean squared shift is at most epsilon.

    A centre without a row stays. ``rounds`` limits the loop only where it is given.
    """
    points = df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("f")).where(F.col("f").isNotNull())
    centres = centres or [list(r[0]) for r in points.orderBy("key").select("f").limit(k).collect()]
    done = 0
    while centres and (rounds is None or done < rounds):
        moved = {r["cluster"]: list(r["centre"]) for r in kmeans_step(points, "f", centres).collect()}
        new = [moved.get(i, c) for i, c in enumerate(centres)]
        shift = sum((a - b) ** 2 for c, d in zip(centres, new, strict=True) for a, b in zip(c, d, strict=True)) / len(centres)
        centres, done = new, done + 1
        if shift <= epsilon:
            break
    return centres


def as_vector(df: DataFrame, features: str | list[str]) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def fit_kmeans(df: DataFrame, features, k: int, seed: int = 42):
    """(model, within-cluster cost)."""
    model = KMeans(k=k, seed=seed, initMode="k-means||").fit(as_vector(df, features))
    return model, model.summary.trainingCost


def fit_linear(df: DataFrame, features: list[str], label: str, intercept: bool = True):
    """Ordinary least squares by the normal equations."""
    return LinearRegression(labelCol=label, solver="normal", regParam=0.0, fitIntercept=intercept).fit(as_vector(df, features))


def fit_logistic(df: DataFrame, features, label: str, family: str = "auto", rounds: int = 50):
    return LogisticRegression(labelCol=label, family=family, maxIter=rounds).fit(as_vector(df, features))


def fit_text_logistic(df: DataFrame, text: str, label: str, buckets: int = 100) -> PipelineModel:
    """Words hashed into ``buckets`` counts, then logistic regression."""
    steps = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=" ", toLowercase=False), HashingTF(inputCol="_words", outputCol="features", numFeatures=buckets), LogisticRegression(labelCol=label, maxIter=50)]
    return Pipeline(stages=steps).fit(df.where(F.col(text).isNotNull() & F.col(label).isNotNull()))


def fit_naive_bayes(df: DataFrame, features, label: str, smoothing: float = 1.0):
    return NaiveBayes(labelCol=label, smoothing=smoothing, modelType="multinomial").fit(as_vector(df, features))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A saved model, whatever its kind, as a pipeline of one step or more; apply it with transform()."""
    from pyspark.ml.util import DefaultParamsReader

    found = DefaultParamsReader.loadParamsInstance(path, SparkSession.active())
    return found if isinstance(found, PipelineModel) else PipelineModel([found])
