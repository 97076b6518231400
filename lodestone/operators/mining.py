"""Baskets, rules, item similarity, outliers, rank products, nearest neighbours and categorical naive Bayes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import euclidean, pearson, subsets
from lodestone.operators.joins import BROADCAST_BYTES, lookup_side, pairs_in_group, plan_bytes
from lodestone.operators.order import positional_rank

#: Items of a basket whose subsets are listed in one array.
ITEMS_AT_ONCE = 12


def basket_combinations(df: DataFrame, basket: str, item: str, k: int = 2) -> DataFrame:
    """(item1 .. itemk, n): sorted combinations of k different items, counted over baskets."""
    if k == 2:
        return pairs_in_group(df, basket, item)
    base = df.select(F.col(basket).alias("_g"), F.col(item).alias("item1")).distinct()
    out = base
    for i in range(2, k + 1):
        out = out.join(base.withColumnRenamed("item1", f"item{i}"), "_g").where(F.col(f"item{i - 1}") < F.col(f"item{i}"))
    return out.groupBy(*(f"item{i}" for i in range(1, k + 1))).agg(F.count("*").alias("n"))


def _subsets(baskets: DataFrame) -> DataFrame:
    """(m, s): all non-empty subsets of ``items``. Long baskets are taken a dozen items at a time, each step a row for each
    subset so far, so that no array holds more than the subsets of a dozen."""
    longest = baskets.agg(F.max(F.size("items"))).first()[0] or 0
    out = baskets.withColumn("s", F.slice("items", 1, 0))
    for at in range(0, longest, ITEMS_AT_ONCE):
        part = F.slice("items", at + 1, ITEMS_AT_ONCE)
        more = F.concat(F.array(F.slice("items", 1, 0)), subsets(part))
        out = out.withColumn("_more", F.explode(more)).withColumn("s", F.concat("s", "_more")).drop("_more")
    return out.where(F.size("s") > 0).select("m", "s")


def association_rules(df: DataFrame, basket: str, item: str) -> DataFrame:
    """(antecedent, consequent, support, confidence) with one consequent; sets are joined by commas.

    Equal baskets are counted once with their number before subsets are listed. The number of subsets doubles with each
    item of a basket, whatever its length.
    """
    baskets = df.groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("items")).groupBy("items").agg(F.count("*").alias("m"))
    support = _subsets(baskets).groupBy("s").agg(F.sum("m").alias("support"))
    parts = support.where(F.size("s") > 1).select("s", "support", F.explode("s").alias("consequent"))
    rules = parts.withColumn("left", F.filter("s", lambda x: x != F.col("consequent")))
    whole = support.select(F.col("s").alias("left"), F.col("support").alias("below"))
    return rules.join(whole, "left").select(F.array_join("left", ",").alias("antecedent"), "consequent", "support", (F.col("support") / F.col("below")).alias("confidence"))


def item_similarity(ratings: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """(item1, item2, n, pearson, cosine, jaccard) of items rated by the same users; null where undefined."""
    base = ratings.select(F.col(user).alias("u"), F.col(item).alias("i"), F.col(rating).cast("double").alias("r"))
    base = base.join(base.groupBy("i").agg(F.count("*").alias("raters")), "i").select("u", "i", "r", "raters")
    a, b = base.toDF("u", "item1", "x", "n1"), base.toDF("u", "item2", "y", "n2")
    c = F.col
    pairs = a.join(b, "u").where("item1 < item2").groupBy("item1", "item2").agg(
        F.count("*").alias("n"), pearson("x", "y").alias("pearson"), F.sum(c("x") * c("y")).alias("sxy"),
        F.sum(c("x") * c("x")).alias("sxx"), F.sum(c("y") * c("y")).alias("syy"), F.max("n1").alias("n1"), F.max("n2").alias("n2"),
    )
    norms = F.sqrt(c("sxx")) * F.sqrt(c("syy"))
    return pairs.select("item1", "item2", "n", "pearson", F.try_divide(c("sxy"), F.when(norms > 0, norms)).alias("cosine"), (c("n") / (c("n1") + c("n2") - c("n"))).alias("jaccard"))


def avf_scores(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(key, score): mean over attributes of how often the value occurs anywhere, columns pooled; low scores are outliers."""
    values = df.select(key, F.explode(F.array(*(F.col(a).cast("string") for a in attributes))).alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    return values.join(counts, "value").groupBy(key).agg(F.avg("n").alias("score"))


def rank_product(studies: DataFrame, study: str, gene: str, value: str) -> DataFrame:
    """(gene, rank_product, n): geometric mean of the ranks by falling \\|mean\\| within each study; ties by gene.

    Ranks come from ranges of the sorted means (see sums_before), so a study of any size is spread over tasks.
    """
    means = studies.groupBy(study, gene).agg(F.abs(F.avg(value)).alias("m"))
    ranks = positional_rank(means, study, F.desc("m"), gene)
    return ranks.groupBy(gene).agg(F.exp(F.avg(F.ln("rank"))).alias("rank_product"), F.count("*").alias("n"))


def knn_classify(queries: DataFrame, known: DataFrame, key: str, features: str, label: str, k: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, label): majority of the k nearest by Euclidean distance, ties by id; vote ties by the smallest label.

    The query set is compared with all rows. It is broadcast in as many blocks as keep each under ``most_bytes``; each
    task keeps the k nearest of its rows before the shuffle.
    """
    q = queries.select(F.col(key).alias("q"), F.col(features).cast("array<double>").alias("x"))
    s = known.select(F.col(key).alias("s"), F.col(label).alias("label"), F.col(features).cast("array<double>").alias("y"))
    near = F.row_number().over(Window.partitionBy("q").orderBy("d", "s"))
    size = plan_bytes(q)
    if size > most_bytes:  # too large by the optimiser's estimate, which is a bound only
        size = q.agg(F.sum(F.size("x") * 8 + 32)).first()[0] or 0
    blocks = size // most_bytes + 1
    block = lambda i: q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else q
    tops = [s.join(F.broadcast(block(i))).select("q", "s", "label", euclidean("x", "y").alias("d")).withColumn("r", near).where(F.col("r") <= k) for i in range(blocks)]
    votes = reduce(DataFrame.unionByName, tops).groupBy("q", "label").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n"), "label"))
    return votes.withColumn("b", best).where("b = 1").select(F.col("q").alias(key), "label")


def naive_bayes_table(df: DataFrame, attributes: list[str], label: str, pool_columns: bool = False) -> DataFrame:
    """(attr, value, label, p): share of the label's rows with the value; the prior has attr 'CLASS' and value null."""
    total = df.groupBy(label).agg(F.count("*").alias("m"))
    prior = total.select(F.lit("CLASS").alias("attr"), F.lit(None).cast("string").alias("value"), F.col(label).alias("label"), (F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1)))).alias("p"))
    cells = F.explode(F.array(*(F.struct(F.lit("*" if pool_columns else a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attributes)))
    counts = df.select(label, cells.alias("c")).groupBy(label, "c.attr", "c.value").agg(F.count("*").alias("n"))
    return counts.join(lookup_side(total), label).select("attr", "value", F.col(label).alias("label"), (F.col("n") / F.col("m")).alias("p")).unionByName(prior)


def naive_bayes_classify(df: DataFrame, key: str, attributes: list[str], table: DataFrame) -> DataFrame:
    """(key, label): the label of largest product, a zero where the table lacks a value; ties by the smallest label.

    Products are sums of logarithms, so many attributes don't underflow; sums that agree to 12 digits are ties. Tables
    made with ``pool_columns`` hold for all attributes. Equal attribute tuples are classified once.
    """
    distinct = df.select(*attributes).distinct()
    labels = lookup_side(table.where("attr = 'CLASS'").select("label", F.ln("p").alias("prior")))
    # each cell under its column's name and under the one for all columns
    cells = F.array(*(F.struct(F.lit(n).alias("_a"), F.col(a).cast("string").alias("_v")) for a in attributes for n in (a, "*")))
    likely = lookup_side(table.where("attr <> 'CLASS'").select(F.col("attr").alias("_a"), F.col("value").alias("_v"), "label", F.ln("p").alias("_p")))
    met = distinct.select(*attributes, F.explode(cells).alias("_c")).select(*attributes, "_c.*").join(likely, ["_a", "_v"])
    scores = met.groupBy(*attributes, "label").agg(F.sum("_p").alias("_p"), F.count("*").alias("_n")).where(F.col("_n") == len(attributes))
    scores = scores.join(labels, "label")
    best = scores.groupBy(*attributes).agg(F.min(F.struct((-F.round(F.col("_p") + F.col("prior"), 12)).alias("s"), "label")).alias("_b"))
    first = labels.agg(F.min("label").alias("_first"))  # where every label has a zero
    same = lambda x, y: reduce(lambda p, q: p & q, [F.col(f"{x}.{a}").eqNullSafe(F.col(f"{y}.{a}")) for a in attributes])
    chosen = df.alias("d").join(best.alias("c"), same("d", "c"), "left").select(F.col(f"d.{key}").alias(key), F.col("c._b.label").alias("_label"))
    return chosen.join(F.broadcast(first)).select(key, F.coalesce("_label", "_first").alias("label"))
