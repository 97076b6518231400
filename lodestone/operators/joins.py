"""Joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only when the optimiser's size of it is at most this.
BROADCAST_BYTES = 64 << 20


def equi_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """All matching pairs; the optimiser picks the strategy and splits skewed partitions."""
    return left.join(right, on, how)


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_side(dim: DataFrame) -> DataFrame:
    """A side to be broadcast where the optimiser's size of it is at most BROADCAST_BYTES; a larger one as it is."""
    return F.broadcast(dim) if plan_bytes(dim) <= BROADCAST_BYTES else dim


def lookup_join(fact: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Map-side join with a small side; a side over BROADCAST_BYTES is joined by a shuffle instead."""
    return fact.join(lookup_side(dim), on, how)


def chain_join(r: DataFrame, s: DataFrame, t: DataFrame, b: str = "b", c: str = "c", strategy: str = "chain", grid: int = 4) -> DataFrame:
    """R(a,b) with S(b,c) with T(c,d) on true keys. ``shares``: one shuffle over a grid by (hash b, hash c), R and T replicated."""
    if strategy == "chain":
        return r.join(s, b).join(t, c)
    cell = lambda k: F.pmod(F.xxhash64(k), F.lit(grid))
    every = F.explode(F.array(*(F.lit(i).cast("long") for i in range(grid))))
    r, t = r.withColumn("_hb", cell(b)).withColumn("_hc", every), t.withColumn("_hc", cell(c)).withColumn("_hb", every)
    s = s.withColumn("_hb", cell(b)).withColumn("_hc", cell(c))
    return s.join(r, ["_hb", "_hc", b]).join(t, ["_hb", "_hc", c]).drop("_hb", "_hc")


def left_join_distinct(detail: DataFrame, dim: DataFrame, on: str, group: str, value: str, unknown: str | None = None) -> DataFrame:
    """(group, n): distinct values of the dimension per group; a missing one counts only when ``unknown`` names it."""
    joined = detail.join(dim, on, "left")
    seen = F.coalesce(F.col(value), F.lit(unknown)) if unknown is not None else F.col(value)
    return joined.groupBy(group).agg(F.countDistinct(seen).alias("n"))


def share_of_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's part of its group's sum; null where the sum is zero.

    Sums are combined before the shuffle and joined back, so that a hot group's rows can be split over tasks.
    """
    sums = df.groupBy(F.col(group).alias("_g")).agg(F.sum(value).alias("_sum"))
    return df.join(sums, F.col(group).eqNullSafe(F.col("_g"))).withColumn("share", F.try_divide(F.col(value), F.col("_sum"))).drop("_g", "_sum")


def pairs_in_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """(item1, item2, n): unordered pairs of different items that share a group, counted over groups."""
    one = df.select(F.col(group).alias("_g"), F.col(item).alias("item1")).distinct()
    two = one.withColumnRenamed("item1", "item2")
    return one.join(two, "_g").where("item1 < item2").groupBy("item1", "item2").agg(F.count("*").alias("n"))


def cartesian(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs; meant for small sides."""
    return left.crossJoin(right)


def membership_split(facts: DataFrame, dim: DataFrame, on: str, group: str, value: Column) -> DataFrame:
    """Per group the count, mean and variance of ``value`` over dimension rows in the group's set and of those outside.

    A group without a member in the dimension stays, with count 0 and null statistics inside. Values are taken from
    their global mean and squares from the group's own mean, so large values lose no digits. The outside follows from
    the totals by the rule for splitting sums of squares, so groups are not multiplied with the dimension.
    """
    v = value.cast("double")
    total = dim.agg(F.count(v).alias("tn"), F.avg(v).alias("tm"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("tq"))
    members = facts.select(group, on).distinct().join(dim.select(on, v.alias("_v")), on, "left")
    d = F.col("_v") - F.col("tm")
    inside = members.join(F.broadcast(total)).groupBy(group).agg(
        F.count("_v").alias("n1"), F.avg(d).alias("d1"), F.coalesce(F.var_pop(d) * F.count(d), F.lit(0.0)).alias("q1"), *(F.first(c).alias(c) for c in ("tn", "tm", "tq"))
    )
    c = F.col
    both = inside.withColumn("n2", c("tn") - c("n1")).withColumn("d2", F.try_divide(-c("n1") * F.coalesce("d1", F.lit(0.0)), c("n2")))
    apart = F.coalesce((c("d1") - c("d2")) * (c("d1") - c("d2")) * F.try_divide(c("n1") * c("n2"), c("tn")), F.lit(0.0))
    both = both.withColumn("q2", F.greatest(c("tq") - c("q1") - apart, F.lit(0.0)))
    stats = [group]
    for i in "12":
        n = c(f"n{i}")
        stats += [n, (c("tm") + c(f"d{i}")).alias(f"mean{i}"), F.try_divide(c(f"q{i}"), F.when(n > 1, n - 1)).alias(f"var{i}")]
    return both.select(*stats)
