"""Sorts, top-N, moving averages, state sequences and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import materialize


def secondary_sort(df: DataFrame, key: str, by: str, value: str, ascending: bool = True) -> DataFrame:
    """(key, series): array of (by, value) in order; equal ``by`` keep all rows, ties by value.

    A key's series is one row; where it may outgrow a row, stream through sort_in_partitions() instead.
    """
    series = F.sort_array(F.collect_list(F.struct(by, value)), asc=ascending)
    return df.groupBy(key).agg(series.alias("series"))


def sort_in_partitions(df: DataFrame, key: str, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """Rows of a key in one partition, in order, for consumers that stream through groups of any size."""
    dealt = df.repartition(partitions, key) if partitions else df.repartition(key)
    return dealt.sortWithinPartitions(key, *order)


def top_n(df: DataFrame, n: int, weight: str, key: str, ascending: bool = False) -> DataFrame:
    """The n rows of largest (or smallest) weight; ties by key."""
    return df.orderBy(F.col(weight).asc() if ascending else F.col(weight).desc(), key).limit(n)


def top_n_distinct(df: DataFrame, n: int, weight: str, key: str) -> DataFrame:
    """As top_n, but a weight occurs once, with its smallest key."""
    return top_n(df.groupBy(weight).agg(F.min(key).alias(key)), n, weight, key)


def top_n_by_key(df: DataFrame, n: int, weight: str, key: str) -> DataFrame:
    """Weights of repeated keys are summed first."""
    return top_n(df.groupBy(key).agg(F.sum(weight).alias(weight)), n, weight, key)


def top_n_per_group(df: DataFrame, n: int, group: str, *order: Column | str) -> DataFrame:
    """The first n rows of each group, with their rank; limits are applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def sample_fixed(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for a seed whatever the partitions: the first by md5 of key and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def moving_average(df: DataFrame, key: str, by: list[str], value: str, window: int, min_periods: int = 1) -> DataFrame:
    """Mean of the last ``window`` rows; rows with fewer than ``min_periods`` so far are dropped."""
    order = Window.partitionBy(key).orderBy(*by)
    out = df.withColumn("moving_avg", F.avg(value).over(order.rowsBetween(1 - window, 0)))
    return out if min_periods <= 1 else out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") >= min_periods).drop("_r")


def sums_before(df: DataFrame, group: str, order: Column | str, value: Column | str) -> DataFrame:
    """Adds ``_before``, the sum of ``value`` over the rows of the group that come earlier, for groups of any size.

    Rows are dealt by ranges of the order, written, and summed within each range; sums of the ranges before give the
    rest. So a group is as many tasks as it has ranges. A null group is a group.
    """
    value = F.col(value) if isinstance(value, str) else value
    order = [order] if isinstance(order, str | Column) else order
    dealt = materialize(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(F.col(group).alias("_h"), F.col("_part").alias("_q")).agg(F.sum(value).alias("_s"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_h", "_q", F.coalesce(F.sum("_s").over(earlier("_h", ["_q"])), F.lit(0)).alias("_t"))
    inside = F.coalesce(F.sum(value).over(earlier(group, "_part", order)), F.lit(0))
    out = dealt.withColumn("_n", inside).join(sums, F.col(group).eqNullSafe(F.col("_h")) & (F.col("_part") == F.col("_q")))
    return out.select(*df.columns, (F.col("_n") + F.col("_t")).alias("_before"))


def positional_rank(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """Adds ``rank``, the row's place (from 1) within its group."""
    return sums_before(df, group, list(order), F.lit(1)).withColumn("rank", F.col("_before") + 1).drop("_before")


def purchase_states(df: DataFrame, customer: str, date: str, amount: str, tie: str) -> DataFrame:
    """Adds ``state`` from the previous purchase: S/M/L by days (under 30, under 60), L/E/G by amounts (0.9, 1.1)."""
    w = Window.partitionBy(customer).orderBy(date, tie)
    days, before = F.datediff(date, F.lag(date).over(w)), F.lag(amount).over(w)
    gap = F.when(days < 30, "S").when(days < 60, "M").otherwise("L")
    size = F.when(before < F.col(amount) * 0.9, "L").when(before < F.col(amount) * 1.1, "E").otherwise("G")
    return df.withColumn("state", F.when(before.isNotNull(), F.concat(gap, size)))


def state_transitions(df: DataFrame, customer: str, date: str, tie: str) -> DataFrame:
    """(from, to, n) of neighbouring states."""
    states = df.where("state IS NOT NULL")
    after = F.lead("state").over(Window.partitionBy(customer).orderBy(date, tie))
    return states.select(F.col("state").alias("from"), after.alias("to")).where("to IS NOT NULL").groupBy("from", "to").agg(F.count("*").alias("n"))


STATES = [g + s for g in "SML" for s in "LEG"]


def transition_matrix(transitions: DataFrame, states: list[str] | None = None) -> DataFrame:
    """(from, to, p) for all pairs; a row with a zero gets one added everywhere, then rows are scaled to sum 1."""
    spark = transitions.sparkSession
    names = states or STATES
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("from")).select("from", F.explode(F.array(*map(F.lit, names))).alias("to"))
    n = F.coalesce("n", F.lit(0))
    row = Window.partitionBy("from")
    full = grid.join(transitions, ["from", "to"], "left").withColumn("n", n)
    full = full.withColumn("n", F.col("n") + F.when(F.min("n").over(row) == 0, 1).otherwise(0))
    return full.select("from", "to", (F.col("n") / F.sum("n").over(row)).alias("p"))
