"""Motifs, friends and greedy view selection."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import discard, materialize


def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct edges with src < dst; loops and nulls go."""
    return edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src < dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _oriented(edges: DataFrame) -> DataFrame:
    """(u, v) from the node of lower degree to the other, which bounds the wedges at hubs."""
    degree = both_ways(edges).groupBy("src").agg(F.count("*").alias("deg"))
    e = edges.join(degree.toDF("src", "ds"), "src").join(degree.toDF("dst", "dd"), "dst")
    ahead = F.struct("ds", "src") < F.struct("dd", "dst")
    return e.select(F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("v"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, each once. Input: undirected()."""
    o = _oriented(edges)
    wedge = o.alias("p").join(o.alias("q"), (F.col("p.u") == F.col("q.u")) & (F.col("p.v") < F.col("q.v"))).select(F.col("p.u").alias("u"), F.col("p.v").alias("src"), F.col("q.v").alias("dst"))
    found = wedge.join(edges, ["src", "dst"]).select(F.array_sort(F.array("u", "src", "dst")).alias("t"))
    return found.select(*(F.col("t")[i].alias(n) for i, n in enumerate("abc")))


def edge_triangles(edges: DataFrame) -> DataFrame:
    """(src, dst, other): each edge with each common neighbour."""
    t = triangles(edges)
    sides = [("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a")]
    parts = F.explode(F.array(*(F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.col(z).alias("other")) for x, y, z in sides)))
    return t.select(parts.alias("e")).select("e.*")


def diamonds(edges: DataFrame) -> DataFrame:
    """(u, v, b, d): edge u < v with two common neighbours b < d."""
    e = materialize(edge_triangles(edges), "triangles")  # read twice
    on = (F.col("p.src") == F.col("q.src")) & (F.col("p.dst") == F.col("q.dst")) & (F.col("p.other") < F.col("q.other"))
    return e.alias("p").join(e.alias("q"), on).select(F.col("p.src").alias("u"), F.col("p.dst").alias("v"), F.col("p.other").alias("b"), F.col("q.other").alias("d"))


def diamond_total(edges: DataFrame) -> DataFrame:
    """One row, total: by the count c of common neighbours of each edge, the sum of c * (c - 1) / 2."""
    c = edge_triangles(edges).groupBy("src", "dst").agg(F.count("*").alias("c"))
    return c.agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0)).cast("long").alias("total"))


def diamond_total_partitioned(edges: DataFrame, rho: int = 4) -> DataFrame:
    """The same total by node classes: every 4-subset of ``rho`` classes counts its diamonds, each weighted by 1 over the
    number of subsets that see it."""
    if rho < 4:
        raise ValueError("rho must be at least 4")
    spark = edges.sparkSession
    cls = lambda c: F.pmod(F.xxhash64(c), F.lit(rho))
    subsets = spark.createDataFrame([(i, list(s)) for i, s in enumerate(combinations(range(rho), 4))], "part int, classes array<long>")
    pairs = subsets.select("part", F.explode("classes").alias("cs"), "classes").select("part", "cs", F.explode("classes").alias("cd"))
    local = edges.withColumn("cs", cls("src")).withColumn("cd", cls("dst")).join(F.broadcast(pairs), ["cs", "cd"]).select("part", "src", "dst")
    w = local.alias("p").join(local.alias("q"), (F.col("p.part") == F.col("q.part")) & (F.col("p.dst") == F.col("q.src"))).select(F.col("p.part").alias("part"), F.col("p.src").alias("x"), F.col("p.dst").alias("y"), F.col("q.dst").alias("z"))
    t = w.join(local.toDF("part", "x", "z"), ["part", "x", "z"])
    sides = F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("o")), F.struct(F.col("x").alias("u"), F.col("z").alias("v"), F.col("y").alias("o")), F.struct(F.col("y").alias("u"), F.col("z").alias("v"), F.col("x").alias("o"))))
    e = t.select("part", sides.alias("e")).select("part", "e.*")
    on = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in ("part", "u", "v")]
    d = e.alias("p").join(e.alias("q"), [*on, F.col("p.o") < F.col("q.o")]).select(*(F.col(c) for c in ("p.u", "p.v")), F.col("p.o").alias("b"), F.col("q.o").alias("d"))
    used = F.size(F.array_distinct(F.array(*(cls(c) for c in ("u", "v", "b", "d")))))
    weight = F.element_at(F.array(*(F.lit(1.0 / comb(rho - k, 4 - k)) for k in range(1, 5))), used)
    return d.agg(F.coalesce(F.round(F.sum(weight)), F.lit(0)).cast("long").alias("total"))


def common_friends(edges: DataFrame) -> DataFrame:
    """(src, dst, common): sorted common neighbours of each edge; empty arrays stay."""
    found = edge_triangles(edges).groupBy("src", "dst").agg(F.array_sort(F.collect_set("other")).alias("common"))
    empty = F.array().cast(f"array<{dict(edges.dtypes)['src']}>")
    return edges.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("common", empty).alias("common"))


def _strangers(edges: DataFrame, *parts: Column) -> DataFrame:
    """(src, dst, parts): pairs at distance two who are no friends. Wedges are combined before friends are taken out."""
    two = both_ways(edges)
    wedge = two.alias("p").join(two.alias("q"), F.col("p.src") == F.col("q.src")).where(F.col("p.dst") < F.col("q.dst"))
    wedge = wedge.select(F.col("p.dst").alias("src"), F.col("q.dst").alias("dst"), F.col("p.src").alias("m"))
    return wedge.groupBy("src", "dst").agg(*parts).join(edges, ["src", "dst"], "left_anti")


def recommend_friends(edges: DataFrame) -> DataFrame:
    """(person, candidate, n, mutual): persons at distance two who are no friends, with their mutual friends."""
    return both_ways_with(_strangers(edges, F.count("*").alias("n"), F.array_sort(F.collect_list("m")).alias("mutual")))


def both_ways_with(found: DataFrame) -> DataFrame:
    rest = [c for c in found.columns if c not in ("src", "dst")]
    one = found.select(F.col("src").alias("person"), F.col("dst").alias("candidate"), *rest)
    return one.unionByName(found.select(F.col("dst").alias("person"), F.col("src").alias("candidate"), *rest))


def recommend_friends_topn(edges: DataFrame, n: int) -> DataFrame:
    """(person, candidate, n, rank): the n candidates with most mutual friends for each person, then by id."""
    rank = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("n"), "candidate"))
    return both_ways_with(_strangers(edges, F.count("*").alias("n"))).withColumn("rank", rank).where(F.col("rank") <= n)


def reachable(dag: DataFrame) -> DataFrame:
    """(parent, child): all descendants in a DAG, the node itself included.

    Paths double in length each round, repeated pairs go at once, and each round is a written table.
    """
    nodes = dag.select(F.explode(F.array("parent", "child")).alias("parent")).where("parent IS NOT NULL").distinct()
    paths = materialize(dag.select("parent", "child").where("parent <> child").distinct(), "paths")
    n = paths.count()
    while True:
        on = paths.select(F.col("parent").alias("child"), F.col("child").alias("end"))
        longer = materialize(paths.unionByName(paths.join(on, "child").select("parent", F.col("end").alias("child"))).distinct(), "paths")
        discard(paths)
        before, paths, n = n, longer, longer.count()
        if n == before:
            return paths.unionByName(nodes.select("parent", F.col("parent").alias("child")))


def greedy_views(costs: list[tuple[str, int]], edges: list[tuple[str, str]], k: int) -> list[tuple[str, int]]:
    """k (view, benefit) chosen one after the other by largest saving over their descendants; the first view is given."""
    below = {v: {v} for v, _ in costs}
    for _ in costs:
        for parent, child in edges:
            below[parent] |= below[child]
    cost = dict(costs)
    now = dict.fromkeys(cost, costs[0][1])
    chosen, picked = [], {costs[0][0]}
    for _ in range(k):
        gains = [(sum(max(0, now[d] - c) for d in below[v]), v) for v, c in costs if v not in picked]
        best = max((g for g, _ in gains), default=0)
        view = next((v for g, v in gains if g == best), None)
        if view is None:
            break
        for d in below[view]:
            now[d] = min(now[d], cost[view])
        picked.add(view)
        chosen.append((view, best))
    return chosen
