"""t-tests and all-pairs correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import pearson, t_p_value, within_one
from lodestone.operators.joins import membership_split
from lodestone.operators.order import sums_before


def welch(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    """(t, df): two samples of unequal variance; a single value against a sample is a one-sample test; else null."""
    c = F.col
    a, b = c(v1) / c(n1), c(v2) / c(n2)
    two = (c(n1) > 1) & (c(n2) > 1)
    one1, one2 = (c(n1) == 1) & (c(n2) > 1), (c(n2) == 1) & (c(n1) > 1)
    t = F.when(two, F.try_divide(c(m1) - c(m2), F.sqrt(a + b))).when(one1, F.try_divide(c(m1) - c(m2), F.sqrt(b))).when(one2, F.try_divide(c(m1) - c(m2), F.sqrt(a)))
    df = F.when(two, F.try_divide((a + b) * (a + b), a * a / (c(n1) - 1) + b * b / (c(n2) - 1))).when(one1, c(n2) - 1.0).when(one2, c(n1) - 1.0)
    return t, df


def membership_t_test(facts: DataFrame, dim: DataFrame, on: str, group: str, value: Column) -> DataFrame:
    """(group, n1, n2, t, df, p): values of dimension rows in the group's set against those outside it."""
    stats = membership_split(facts, dim, on, group, value)
    t, df = welch("n1", "mean1", "var1", "n2", "mean2", "var2")
    out = stats.withColumns({"t": t, "df": df})
    return out.select(group, "n1", "n2", "t", "df", t_p_value("t", "df").alias("p"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; 0 where \\|r\\| is 1, null where r is null or n under 3."""
    t = F.try_divide(r * F.sqrt(n - 2.0), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    return F.when(r.isNotNull() & (n > 2), F.coalesce(t_p_value(t, (n - 2).cast("double")), F.lit(0.0)))


def all_pairs_correlation(df: DataFrame, item: str, subject: str, value: str, least: int = 3) -> DataFrame:
    """(item1, item2, n, r, p) over common subjects, means first; r and p are null under ``least`` common subjects."""
    means = df.groupBy(item, subject).agg(F.avg(value).alias("v"))
    a, b = means.toDF("item1", "_s", "x"), means.toDF("item2", "_s", "y")
    pairs = a.join(b, "_s").where("item1 < item2").groupBy("item1", "item2").agg(F.count("*").alias("n"), pearson("x", "y").alias("_r"))
    out = pairs.select("item1", "item2", "n", F.when(F.col("n") >= least, F.col("_r")).alias("r"))
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, rho, p): Pearson's r of average ranks within the group.

    Ranks are those of the group's distinct values, so equal values are counted before anything is ranked; a group with
    many distinct values is ranked in ranges.
    """
    sound = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = sound.groupBy("_g", "_x", "_y").agg(F.count("*").alias("_w"))

    def ranked(c: str, name: str) -> DataFrame:
        counts = pairs.groupBy("_g", c).agg(F.sum("_w").alias("_c"))
        return sums_before(counts, "_g", c, "_c").select(F.col("_g").alias(f"_g{c}"), F.col(c).alias(f"_v{c}"), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(name))

    a, b = ranked("_x", "a"), ranked("_y", "b")
    both = pairs.join(a, F.col("_g").eqNullSafe(F.col("_g_x")) & (F.col("_x") == F.col("_v_x"))).join(b, F.col("_g").eqNullSafe(F.col("_g_y")) & (F.col("_y") == F.col("_v_y")))
    # weighted moments about the mean rank, which is (n + 1) / 2 on both sides
    sizes = pairs.groupBy(F.col("_g").alias("_gn")).agg(F.sum("_w").alias("n"))
    both = both.join(sizes, F.col("_g").eqNullSafe(F.col("_gn")))
    u, v, w = F.col("a") - (F.col("n") + 1) / 2.0, F.col("b") - (F.col("n") + 1) / 2.0, F.col("_w")
    s = both.groupBy("_g", "n").agg(F.sum(u * v * w).alias("uv"), F.sum(u * u * w).alias("uu"), F.sum(v * v * w).alias("vv"))
    spread = F.sqrt("uu") * F.sqrt("vv")
    rho = F.try_divide(F.col("uv"), F.when(spread > 0, spread))
    out = s.select(F.col("_g").alias(group), "n", within_one(rho).alias("rho"))
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n")))
