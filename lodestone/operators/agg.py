"""Aggregations by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def sum_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total"))


def mean_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """True mean; partial sums and counts are combined before the shuffle."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def min_max(df: DataFrame, value: str) -> DataFrame:
    """One row: min, max, sum, mean, median; nulls for an empty table."""
    v = F.col(value)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"))


def combine_by_key(df: DataFrame, keys: list[str], **parts: Column) -> DataFrame:
    """User-named aggregates by key; each is combined map-side where its function allows."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in parts.items()))


def log_statistics(df: DataFrame, keys: list[str], size: str, surrogate: str = "-") -> DataFrame:
    """Requests and bytes by keys; key values that equal the surrogate are dropped rows, missing sizes count as 0."""
    sound = None
    for k in keys:
        ok = F.col(k).isNotNull() & (F.col(k).cast("string") != surrogate)
        sound = ok if sound is None else sound & ok
    return df.where(sound).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(size), F.lit(0))).alias("bytes"))


#: Points of each grade.
GRADE_POINTS = {"EX": 10, "A": 9, "B": 8, "C": 7, "D": 6, "E": 5, "P": 5, "F": 0, "AB": 0, "I": 0}


def weighted_mean_running(df: DataFrame, student: str, term: str, points: Column, credits: Column) -> DataFrame:
    """(student, term, term_mean, running_mean): credit-weighted mean of each term and of all terms so far."""
    good = df.withColumn("_p", points).withColumn("_c", credits).where("_c > 0 AND _p IS NOT NULL")
    terms = good.groupBy(student, term).agg(F.sum(F.col("_p") * F.col("_c")).alias("_s"), F.sum("_c").alias("_w"))
    so_far = Window.partitionBy(student).orderBy(term).rowsBetween(Window.unboundedPreceding, 0)
    return terms.select(student, term, (F.col("_s") / F.col("_w")).alias("term_mean"), (F.sum("_s").over(so_far) / F.sum("_w").over(so_far)).alias("running_mean"))


def passes(value: Column, mode: str, threshold: float) -> Column:
    """Threshold test: ``up`` value >= t, ``down`` value <= t, ``abs`` \\|value\\| >= t."""
    if mode == "up":
        return value >= threshold
    if mode == "down":
        return value <= threshold
    if mode == "abs":
        return F.abs(value) >= threshold
    raise ValueError("mode must be up, down or abs")


def genes_by_individual(df: DataFrame, reference: str, mode: str, threshold: float) -> DataFrame:
    """(gene, n): rows of the reference type that pass."""
    return df.where((F.col("ref") == reference) & passes(F.col("value"), mode, threshold)).groupBy("gene").agg(F.count("*").alias("n"))


def genes_by_average(df: DataFrame, reference: str, mode: str, threshold: float) -> DataFrame:
    """(gene, n): patients whose mean passes; genes with none keep 0."""
    means = df.where(F.col("ref") == reference).groupBy("gene", "patient").agg(F.avg("value").alias("mean"))
    return means.groupBy("gene").agg(F.sum(passes(F.col("mean"), mode, threshold).cast("long")).alias("n"))


def hour_features(df: DataFrame, key: str, ts: str, views: str) -> DataFrame:
    """(key, features): 24 mean views by hour, scaled to sum 1; keys with an hour at zero or missing are dropped."""
    means = df.groupBy(key, F.hour(ts).alias("h")).agg(F.avg(views).alias("v"))
    wide = means.groupBy(key).agg(*(F.max(F.when(F.col("h") == i, F.col("v"))).alias(f"h{i}") for i in range(24)))
    wide = wide.select(key, F.array(*(F.coalesce(F.col(f"h{i}"), F.lit(0.0)) for i in range(24))).alias("f")).where(F.forall("f", lambda x: x > 0))
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    return wide.select(key, F.transform("f", lambda x: x / total).alias("features"))


def accuracy(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def mean_squared_error(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(predicted) - F.col(label), 2)).alias("mse"))
