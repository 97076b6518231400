"""Golden results on tiny frames, agreement of strategies, and plan shapes."""

import math
import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestone.functions as fn
from lodestone import sources, streaming, tables
from lodestone.operators import agg, graph, joins, mining, ml, order, spatial, stats, text


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Series of the secondary sort.
SERIES = [("p", 4, 40), ("p", 6, 20), ("x", 2, 9), ("y", 2, 5), ("x", 1, 3), ("y", 1, 7), ("y", 3, 1), ("x", 3, 6), ("z", 1, 4), ("z", 2, 8), ("z", 3, 7), ("z", 4, 0), ("p", 1, 10), ("p", 3, 60)]


def test_secondary_sort(spark):
    df = spark.createDataFrame(SERIES, "key string, time int, value int")
    got = {r.key: [tuple(x) for x in r.series] for r in order.secondary_sort(df, "key", "time", "value").collect()}
    assert got == {"z": [(1, 4), (2, 8), (3, 7), (4, 0)], "p": [(1, 10), (3, 60), (4, 40), (6, 20)], "x": [(1, 3), (2, 9), (3, 6)], "y": [(1, 7), (2, 5), (3, 1)]}
    down = order.secondary_sort(df, "key", "time", "value", ascending=False).where("key = 'y'").first().series
    assert [tuple(x) for x in down] == [(3, 1), (2, 5), (1, 7)]
    parts = order.sort_in_partitions(df, "key", F.desc("time"), partitions=3).select("key", "time", F.spark_partition_id().alias("p")).collect()
    assert all(len({x.p for x in parts if x.key == k}) == 1 for k in "pxyz")
    assert [x.time for x in parts if x.key == "p"] == [6, 4, 3, 1]


def test_moving_average(spark):
    # fixed values: prices and their moving averages
    prices = {
        "GOOG": [("2004-11-04", 184.70), ("2004-11-03", 191.67), ("2004-11-02", 194.87), ("2013-07-19", 896.60), ("2013-07-18", 910.68), ("2013-07-17", 918.55)],
        "AAPL": [("2013-10-09", 486.59), ("2013-10-08", 480.94), ("2013-10-07", 487.75), ("2013-10-04", 483.03), ("2013-10-03", 483.41)],
        "IBM": [("2013-09-30", 185.18), ("2013-09-27", 186.92), ("2013-09-26", 190.22), ("2013-09-25", 189.47)],
    }
    df = spark.createDataFrame([(k, d, p) for k, v in prices.items() for d, p in v], "symbol string, date string, price double")
    full = order.moving_average(df, "symbol", ["date"], "price", 2, 2).orderBy("symbol", "date").collect()
    want = [483.22, 485.39, 484.345, 483.765, 193.27, 188.185, 551.625, 914.615, 903.64, 189.845, 188.57, 186.05]
    assert [r.moving_avg for r in full] == pytest.approx(want)
    one = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([10, 18, 20, 30, 24, 33, 27])], "k string, t int, v double")
    got = [r.moving_avg for r in order.moving_average(one, "k", ["t"], "v", 3).orderBy("t").collect()]
    assert got == pytest.approx([10, 14, 16, 68 / 3, 74 / 3, 29, 28])


def test_top_n(spark):
    df = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5), ("d", 1), ("a", 4)], "k string, w int")
    assert [tuple(r) for r in order.top_n(df, 2, "w", "k").collect()] == [("b", 5), ("c", 5)]
    assert [(r.k, r.w) for r in order.top_n_by_key(df, 2, "w", "k").collect()] == [("a", 7), ("b", 5)]
    assert [(r.w, r.k) for r in order.top_n_distinct(df, 2, "w", "k").select("w", "k").collect()] == [(5, "b"), (4, "a")]
    assert [r.w for r in order.top_n(df, 2, "w", "k", ascending=True).collect()] == [1, 3]
    assert "TakeOrderedAndProject" in plan(order.top_n(df, 2, "w", "k"))
    assert "WindowGroupLimit" in plan(order.top_n_per_group(df, 1, "k", F.desc("w")))
    assert rows(order.sample_fixed(df, 3, "w"), "w") == rows(order.sample_fixed(df.repartition(3), 3, "w"), "w")


R = [("1", "100"), ("2", "200"), ("3", "300")]
S = [("200", "20"), ("300", "30"), ("400", "40")]


def test_joins(spark):
    r, s = spark.createDataFrame(R, "a string, b string"), spark.createDataFrame(S, "b string, c string")
    assert rows(joins.equi_join(r, s, "b"), "a", "b", "c") == [("2", "200", "20"), ("3", "300", "30")]
    r = spark.createDataFrame([("1", "10"), ("2", "20"), ("3", "10")], "a string, b string")
    s = spark.createDataFrame([("10", "100"), ("20", "200"), ("30", "300")], "b string, c string")
    t = spark.createDataFrame([("100", "1000"), ("200", "2000"), ("400", "4000")], "c string, d string")
    want = [("1", "10", "100", "1000"), ("2", "20", "200", "2000"), ("3", "10", "100", "1000")]
    for strategy in ("chain", "shares"):
        assert rows(joins.chain_join(r, s, t, strategy=strategy), "a", "b", "c", "d") == want
    few = spark.range(5).selectExpr("cast(id * 10 AS string) AS b", "id")
    assert "BroadcastHashJoin" in plan(joins.lookup_join(r, few, "b")) and rows(joins.lookup_join(r, few, "b"), "a") == [("1",), ("2",), ("3",)]


def test_left_join_distinct_locations(spark):
    users = spark.createDataFrame([("u1", "UT"), ("u2", "GA"), ("u3", "CA"), ("u4", "CA"), ("u5", "GA")], "u string, location string")
    bought = [("p3", "u1"), ("p1", "u2"), ("p1", "u1"), ("p2", "u2"), ("p4", "u4"), ("p1", "u1"), ("p4", "u1"), ("p4", "u5")]
    tx = spark.createDataFrame(bought, "p string, u string")
    assert rows(joins.left_join_distinct(tx, users, "u", "p", "location"), "p", "n") == [("p1", 2), ("p2", 1), ("p3", 1), ("p4", 3)]
    lost = tx.union(spark.createDataFrame([("p2", "u9"), ("p5", "u9")], tx.schema))
    assert rows(joins.left_join_distinct(lost, users, "u", "p", "location"), "p", "n")[-1] == ("p5", 0)
    assert rows(joins.left_join_distinct(lost, users, "u", "p", "location", "unknown"), "p", "n")[1:2] == [("p2", 2)]


def test_spatial_chain_equals_brute_force(spark):
    r = random.Random(0)
    make = lambda p: [(f"{p}{i}", x, y, x + r.randrange(0, 30), y + r.randrange(0, 30)) for i in range(25) for x, y in [(r.randrange(-50, 50), r.randrange(-50, 50))]]
    data = {p: [(a, *map(float, b)) for a, *b in make(p)] for p in "pqrs"}
    frames = [spark.createDataFrame(v, "id string, xmin double, ymin double, xmax double, ymax double") for v in data.values()]
    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    want = sorted((p[0], q[0], x[0], s[0]) for p in data["p"] for q in data["q"] if meet(p, q) for x in data["r"] if meet(q, x) for s in data["s"] if meet(x, s))
    assert want
    for cell in (7.0, 1000.0):
        assert rows(spatial.overlap_chain(frames, list("pqrs"), cell), *"pqrs") == want


def test_spatial_golden(spark):
    box = lambda p, lo: spark.createDataFrame([(f"{p}{i + 1}", float(x), float(x), float(x + 10), float(x + 10)) for i, x in enumerate(lo)], "id string, xmin double, ymin double, xmax double, ymax double")
    relations = [box("p", (10, 15, 5)), box("q", (12, 18, 8)), box("r", (14, 20, 6)), box("s", (16, 22, 10))]
    assert spatial.overlap_chain(relations, list("pqrs"), 25.0).count() == 51


def test_spatial_chain_shuffles_rectangles_alone(spark, monkeypatch):
    r = random.Random(1)
    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    schema = "id string, xmin double, ymin double, xmax double, ymax double"

    def want(data):
        out = [(x,) for x in data[0]]
        for relation in data[1:]:
            out = [(*t, x) for t in out for x in relation if meet(t[-1], x)]
        return sorted(tuple(x[0] for x in t) for t in out)

    # a crowd on one spot, corners on the grid, points, boxes below zero; full tiles and long lists are split
    monkeypatch.setattr(spatial, "_PART", 3)
    monkeypatch.setattr(spatial, "_LISTED", 4)
    at = lambda: r.choice([0.0, 0.1, -8.0, 8.0, r.uniform(-60, 60), float(r.randrange(-60, 60))])
    box = lambda i, x, y: (i, x, y, x + r.choice([0.0, 8.0, 7.9]), y + r.choice([0.0, 8.0, 3.0]))
    data = [[box(f"{n}{i}", at(), at()) for i in range(20)] for n in "pqrst"]
    bad = [("n", None, 0.0, 1.0, 1.0), ("m", 5.0, 0.0, -5.0, 1.0)]
    frames = [spark.createDataFrame(x + bad, schema) for x in data]
    for k in (3, 4, 5):
        assert len(want(data[:k])) > 20
        got = spatial.overlap_chain(frames[:k], list("pqrst"[:k]), 2.0)
        assert rows(got, *"pqrst"[:k]) == want(data[:k])
        lines = plan(got).split("\n")
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        merged = [i for i, x in enumerate(lines) if "SortMergeJoin" in x]
        assert merged
        for i in merged:  # no exchange lies above a join
            level = depth(lines[i])
            for x in reversed(lines[:i]):
                if depth(x) < level:
                    assert "Exchange" not in x
                    level = depth(x)
    # the same id twice; one box far larger than the others and none at all go the other way
    twice = [data[0], data[1][:8] + [data[1][0]], data[2], data[3]]
    assert rows(spatial.overlap_chain([spark.createDataFrame(x, schema) for x in twice], list("pqrs"), 2.0), *"pqrs") == want(twice)
    for odd in ([("huge", -1e6, -1e6, 1e6, 1e6)], []):
        mixed = [data[0], data[1], data[2][:6] * bool(odd) + odd, data[3]]
        assert rows(spatial.overlap_chain([spark.createDataFrame(x, schema) for x in mixed], list("pqrs"), 2.0), *"pqrs") == want(mixed)


#: The edge list whose numbers of triangles and diamonds are known.
GRAPH = [
    (1, 2), (2, 3), (3, 4), (4, 1), (1, 3), (2, 5), (5, 6), (6, 3), (2, 6), (7, 8),
    (8, 9), (9, 10), (10, 7), (7, 9), (8, 11), (11, 12), (12, 9), (11, 12), (13, 14), (14, 15),
    (15, 16), (16, 13), (13, 15), (17, 18), (18, 19), (19, 20), (20, 17), (17, 19), (21, 22), (22, 23),
    (23, 24), (24, 21), (21, 23), (25, 26), (26, 27), (27, 28), (28, 25), (25, 27), (3, 5), (6, 1),
    (9, 12),
]


def test_graph_goldens(spark):
    small = graph.undirected(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 5), (3, 4), (3, 5), (5, 6), (5, 7), (5, 8), (7, 8), (8, 9), (6, 9)], "src long, dst long"))
    assert rows(graph.triangles(small), "a", "b", "c") == [(1, 2, 3), (2, 3, 5), (5, 7, 8)]
    e = graph.undirected(spark.createDataFrame(GRAPH, "src long, dst long"))
    assert (e.count(), graph.triangles(e).count(), graph.diamonds(e).count()) == (39, 18, 22)
    assert graph.diamonds(e).select(F.array_sort(F.array("u", "v", "b", "d"))).distinct().count() == 12
    assert [graph.diamond_total(e).first()[0], *(graph.diamond_total_partitioned(e, k).first()[0] for k in (4, 5, 8))] == [22] * 4
    with pytest.raises(ValueError):
        graph.diamond_total_partitioned(e, 3)


def test_friends(spark):
    # fixed values: friends and their recommendations
    lines = ["1:2,3,4,5,6,7", "2:1,3,4,5,6", "3:1,2", "4:1,2", "5:1,2", "6:1,2", "7:1"]
    e = graph.undirected(sources.adjacency(spark.createDataFrame([(x,) for x in lines], "value string")))
    top = graph.recommend_friends_topn(e, 3).groupBy("person").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("c"))
    got = {r.person: [x.candidate for x in r.c] for r in top.collect()}
    assert got == {2: [7], 3: [4, 5, 6], 4: [3, 5, 6], 5: [3, 4, 6], 6: [3, 4, 5], 7: [2, 3, 4]}
    common = {(r.src, r.dst): list(r.common) for r in graph.common_friends(e).collect()}
    assert common[1, 2] == [3, 4, 5, 6] and common[1, 7] == [] and common[2, 3] == [1]


#: The lattice of views (cost of each, edges from a view to those computed from it).
VIEW_COSTS = [("a", 100), ("b", 50), ("c", 75), ("d", 20), ("e", 30), ("f", 40), ("g", 1), ("h", 10)]
VIEW_EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("c", "e"), ("c", "f"), ("d", "g"), ("e", "g"), ("e", "h"), ("f", "h")]


def test_views(spark):
    assert graph.greedy_views(VIEW_COSTS, VIEW_EDGES, 3) == [("b", 250), ("f", 70), ("d", 60)]
    reach = graph.reachable(spark.createDataFrame(VIEW_EDGES, "parent string, child string"))
    assert reach.where("parent = 'a'").count() == 8


def test_reachable_on_long_and_dense_graphs(spark):
    chain = spark.range(500).coalesce(1).selectExpr("id AS parent", "id + 1 AS child")
    assert graph.reachable(chain).count() == 501 * 502 // 2
    assert graph.reachable(chain.where("false")).count() == 0
    ladder = [e for i in range(30) for e in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))]
    out = graph.reachable(spark.createDataFrame(ladder, "parent long, child long"))
    assert out.count() == out.distinct().count() and out.where("parent = 0").count() == 91


def test_words(spark):
    # fixed values: lines and their words
    lines = ["Hello world hello hadoop", "Hadoop is a powerful framework", "MapReduce is part of hadoop", "Hello world programming", "Java programming with hadoop"]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    got = dict(rows(text.word_count(df, min_length=3), "word", "n"))
    assert got == {"hadoop": 3, "Hello": 2, "world": 2, "programming": 2, "hello": 1, "Hadoop": 1, "powerful": 1, "framework": 1, "MapReduce": 1, "part": 1, "Java": 1, "with": 1}
    assert text.sorted_word_count(df, min_length=3).first().word == "hadoop"
    anagrams = ["Mary and Elvis lives in Detroit army Easter Listen ", "a silent eaters Death Hated elvis Mary easter Silent", "Mary and Elvis are in a army Listen Silent detroit"]
    out = text.anagrams(spark.createDataFrame([(x,) for x in anagrams], "text string")).collect()
    assert {r.letters: dict(zip(r.words, r.counts, strict=True)) for r in out} == {"adeht": {"death": 1, "hated": 1}, "eilnst": {"silent": 3, "listen": 2}, "eilsv": {"lives": 1, "elvis": 3}, "aeerst": {"eaters": 1, "easter": 2}, "amry": {"army": 2, "mary": 3}}


def test_relative_frequency(spark):
    df = spark.createDataFrame([("w1 w2 w3 w4 w5 w6",), ("lonely",)], "t string")
    got = text.relative_frequency(df, F.split("t", " "), 2).collect()
    assert {r.word: r.total for r in got} == {"w1": 2, "w2": 3, "w3": 4, "w4": 4, "w5": 3, "w6": 2} and all(r.n == 1 for r in got)


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 x\nACGT\nAC\n>s2\nggN\n")
    (tmp_path / "b.fq").write_text("@r1\nACGT\n+\n;;;;\n@r2\nTT\n+\n@A\n")
    got = rows(sources.fasta(spark, str(tmp_path / "a.fasta")), "header", "seq")
    assert got == [("s1 x", "ACGTAC"), ("s2", "ggN")]
    assert dict(rows(text.base_count(spark.read.text(str(tmp_path / "a.fasta"))), "base", "n")) == {"A": 2, "C": 2, "G": 3, "T": 1, "other": 1}
    reads = sources.fastq(spark, str(tmp_path / "b.fq"))
    assert rows(reads, "name", "seq", "qual") == [("@r1", "ACGT", ";;;;"), ("@r2", "TT", "@A")]
    assert rows(text.kmers(reads, "seq", 3), "kmer", "n") == [("ACG", 1), ("CGT", 1)]
    assert dict(rows(text.char_count(reads, "seq"), "ch", "n"))["t"] == 3
    posts = text.word_postings(spark.createDataFrame([("d1", "aa bb aa"), ("d2", "aa")], "d string, t string"), "d", "t").where("word = 'aa'").first()
    assert [tuple(p) for p in posts.postings] == [(1, "d2"), (2, "d1")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_over_splits(spark, tmp_path, end):
    r = random.Random(3)
    reads = []
    for i in range(3000):
        n = r.randrange(1, 40)
        reads.append((f"@r{i}", "".join(r.choices("ACGT", k=n)), "+", "".join(r.choices("@I;", k=n))))
    (tmp_path / "a.fq").write_bytes(end.join([*map(end.join, reads[:2000]), ""]).encode())
    (tmp_path / "b.fq").write_bytes(end.join(map(end.join, reads[2000:])).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = sources.fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")])
        assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > 4
        assert rows(got, "name", "seq", "plus", "qual") == sorted(reads)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_codes_and_hashes(spark):
    def expected(word):
        h = 1125899906842597
        for c in word:
            h = (31 * h + ord(c)) % 2**64
        return h - 2**64 if h >= 2**63 else h

    words = ["", "a", "spark", "\u00e4rger", "x" * 300, None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", fn.polynomial_hash("w").alias("h"), fn.category_code("w", ["spark", "a"]).alias("c")).collect()
    assert {r.w: r.h for r in got} == {w: None if w is None else expected(w) for w in words}
    assert {r.w: r.c for r in got} == {w: {"spark": 0, "a": 1}.get(w) for w in words}
    assert spark.range(1).select(fn.bucket(F.lit(-13), 10)).first()[0] == 3


def test_spread_leaves_large_tables(spark, tmp_path):
    spark.range(8).repartition(8).write.parquet(str(tmp_path / "many"))
    spark.range(8).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)
    try:
        assert "Exchange" not in plan(sources.spread(spark.read.parquet(str(tmp_path / "many"))))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sources.spread(spark.read.parquet(str(tmp_path / "one"))).count() == 8


def test_share_of_group_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    assert {(r.g, r.v): r.share for r in joins.share_of_group(df, "g", "v").collect()} == {("a", 1.0): 0.25, ("a", 3.0): 0.75, (None, 5.0): 1.0}
    zero = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("b", -1.0)], "g string, v double")
    assert [r.share for r in joins.share_of_group(zero, "g", "v").collect()] == [None] * 3


def test_sql_views(spark):
    spark.range(3).createOrReplaceTempView("a")
    out = sources.sql("SELECT a.k, b.v FROM {a} a LEFT JOIN {b} b USING (k)", a=spark.createDataFrame([(1,), (2,)], "k int"), b=spark.createDataFrame([(1, "x")], "k int, v string"))
    assert sorted(map(tuple, out.collect())) == [(1, "x"), (2, None)]
    assert spark.table("a").count() == 3


def test_aggregates(spark):
    df = spark.createDataFrame([("zebra", 1.0), ("zebra", 2.0), ("zebra", 9.0), ("pandas", 3.0), ("pandas", 17.0), ("duck", 2.0), ("duck", 8.0), ("duck", 4.0), ("duck", 6.0)], "k string, v double")
    assert rows(agg.mean_by_key(df, "k", "v"), "k", "mean") == [("duck", 5.0), ("pandas", 10.0), ("zebra", 4.0)]
    assert tuple(agg.min_max(spark.createDataFrame([(x,) for x in (6, 9, 7, 2, 3)], "n int"), "n").first()) == (2, 9, 27, 5.4, 6.0)
    logs = [("10.20.30.40", "u200", "500", "query1"), ("10.20.30.41", "u300", "600", "query1"), ("10.20.30.42", "u400", "700", "query2"), ("10.20.30.40", "u200", "-", "query1"), ("10.20.30.41", "u300", "600", "query1"), ("10.20.30.47", "-", "600", "query1"), ("10.20.30.42", "u400", "700", "query2")]
    frame = spark.createDataFrame(logs, "ip string, user string, size string, query string").withColumn("size", F.col("size").try_cast("int"))
    assert rows(agg.log_statistics(frame, ["ip", "user", "query"], "size"), "ip", "n", "bytes") == [("10.20.30.40", 2, 500), ("10.20.30.41", 2, 1200), ("10.20.30.42", 2, 1400)]
    genes = spark.createDataFrame([("g1", "r1", "p1", 1.0), ("g1", "r1", "p1", 3.0), ("g1", "r1", "p2", -5.0), ("g2", "r1", "p1", 0.1), ("g2", "r2", "p1", 9.0)], "gene string, ref string, patient string, value double")
    assert rows(agg.genes_by_individual(genes, "r1", "abs", 3), "gene", "n") == [("g1", 2)]
    assert rows(agg.genes_by_average(genes, "r1", "up", 2), "gene", "n") == [("g1", 1), ("g2", 0)]
    with pytest.raises(ValueError):
        agg.passes(F.col("v"), "sideways", 1)
    marks = spark.createDataFrame([("s", 1, 10, 4.0), ("s", 1, 5, 2.0), ("s", 2, 8, 3.0), ("s", 2, 9, 0.0)], "st string, term int, p int, c double")
    got = rows(agg.weighted_mean_running(marks, "st", "term", F.col("p"), F.col("c")), "term", "term_mean", "running_mean")
    assert got == [(1, pytest.approx(50 / 6), pytest.approx(50 / 6)), (2, 8.0, pytest.approx(74 / 9))]


def test_markov(spark):
    df = spark.createDataFrame([("c", "2020-01-01", 100, 1), ("c", "2020-01-11", 100, 2), ("c", "2020-03-01", 50, 3), ("c", "2020-06-01", 100, 4), ("d", "2020-01-01", 5, 5)], "c string, d string, a int, k int").withColumn("d", F.to_date("d"))
    states = order.purchase_states(df, "c", "d", "a", "k")
    assert [r.state for r in states.where("c = 'c'").orderBy("k").collect()] == [None, "SE", "MG", "LL"]
    matrix = order.transition_matrix(order.state_transitions(states, "c", "d", "k"))
    assert matrix.count() == 81
    assert all(abs(r.s - 1) < 1e-12 for r in matrix.groupBy("from").agg(F.sum("p").alias("s")).collect())
    assert matrix.where("from = 'SE' AND to = 'MG'").first().p == pytest.approx(2 / 10)


#: Points with classes.
KNN_S = [(100, "c1", 1.0, 1.0), (101, "c1", 1.1, 1.2), (102, "c1", 1.2, 1.0), (103, "c1", 1.6, 1.5), (104, "c1", 1.3, 1.7), (105, "c1", 2.0, 2.1), (106, "c1", 2.0, 2.2), (107, "c1", 2.3, 2.3), (208, "c2", 9.0, 9.0), (209, "c2", 9.1, 9.2), (210, "c2", 9.2, 9.0), (211, "c2", 10.6, 10.5), (212, "c2", 10.3, 10.7), (213, "c2", 9.6, 9.1), (214, "c2", 9.4, 10.4), (215, "c2", 10.3, 10.3), (300, "c3", 10.0, 1.0), (301, "c3", 10.1, 1.2), (302, "c3", 10.2, 1.0), (303, "c3", 10.6, 1.5), (304, "c3", 10.3, 1.7), (305, "c3", 1.0, 2.1), (306, "c3", 10.0, 2.2), (307, "c3", 10.3, 2.3)]


def test_knn(spark):
    q = spark.createDataFrame([(i, [x, y]) for i, x, y in [(1000, 3.0, 3.0), (1001, 10.1, 3.2), (1003, 2.7, 2.7), (1004, 5.0, 5.0), (1005, 13.1, 2.2), (1006, 12.7, 12.7)]], "id long, f array<double>")
    s = spark.createDataFrame([(i, c, [x, y]) for i, c, x, y in KNN_S], "id long, class string, f array<double>")
    got = rows(mining.knn_classify(q, s, "id", "f", "class", 4), "id", "label")
    assert got == [(1000, "c1"), (1001, "c3"), (1003, "c1"), (1004, "c1"), (1005, "c3"), (1006, "c2")]


def test_rank_product(spark):
    data = {1: [30.0, 60.0, 10.0, 80.0], 2: [90.0, 70.0, 40.0, 50.0], 3: [4.0, 8.0]}
    df = spark.createDataFrame([(s, f"K_{i + 1}", v) for s, vs in data.items() for i, v in enumerate(vs)], "s int, g string, v double")
    got = {r.g: (round(r.rank_product, 5), r.n) for r in mining.rank_product(df, "s", "g", "v").collect()}
    assert got == {"K_1": (1.81712, 3), "K_2": (1.58740, 3), "K_3": (4.0, 2), "K_4": (1.73205, 2)}


def test_rules_and_similarity(spark):
    baskets = [(1, x) for x in "abc"] + [(2, x) for x in "ab"] + [(3, x) for x in "ab"] + [(4, "c")]
    df = spark.createDataFrame(baskets, "g int, i string")
    rules = {(r.antecedent, r.consequent): (r.support, r.confidence) for r in mining.association_rules(df, "g", "i").collect()}
    assert rules["a", "b"] == (3, 1.0) and rules["a,b", "c"] == (1, pytest.approx(1 / 3)) and rules["c", "a"] == (1, 0.5)
    assert rows(mining.basket_combinations(df, "g", "i", 3), "item1", "item2", "item3", "n") == [("a", "b", "c", 1)]
    ratings = spark.createDataFrame([(u, i, r) for i, v in {"x": [2, 4, 45, 6, 7], "y": [23, 5, 54, 6, 7]}.items() for u, r in enumerate(v)], "u int, i string, r int")
    row = mining.item_similarity(ratings, "u", "i", "r").first()
    assert row.pearson == pytest.approx(0.9012502759005416) and row.jaccard == 1.0
    flat = spark.createDataFrame([(1, "x", 3), (2, "x", 3), (1, "y", 1), (2, "y", 5)], "u int, i string, r int")
    assert mining.item_similarity(flat, "u", "i", "r").first().pearson is None


@pytest.mark.parametrize(("x", "y", "r", "p"), [((2, 4, 45, 6, 7), (23, 5, 54, 6, 7), 0.9012502759005416, 0.03669423980590647), ((12, 14, 45, 6, 17), (3, 5, 15, 16, 17), 0.2802537958851099, 0.6478974587092594)])
def test_correlation(spark, x, y, r, p):
    data = [("x", i, float(v)) for i, v in enumerate(x)] + [("y", i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame([*data, ("z", 0, 1.0), ("z", 1, 2.0)], "g string, s int, v double")
    out = {(q.item1, q.item2): q for q in stats.all_pairs_correlation(df, "g", "s", "v").collect()}
    assert (out["x", "y"].r, out["x", "y"].p) == (pytest.approx(r), pytest.approx(p)) and out["x", "z"].r is None and out["x", "z"].p is None
    assert "CartesianProduct" not in plan(stats.all_pairs_correlation(df, "g", "s", "v"))


def test_t_distribution():
    t = np.array([0.0, 0.5, 1.0, 3.0, 50.0])
    assert fn.t_two_sided(t, np.ones(5)) == pytest.approx(1 - 2 / math.pi * np.arctan(t), abs=1e-12)
    assert fn.t_two_sided(t, np.full(5, 2.0)) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-12)
    assert fn.t_two_sided(np.array([3.602619932479022]), np.array([3.0]))[0] == pytest.approx(0.03669423980590647)


def test_membership_t_test(spark):
    dim = spark.createDataFrame([(f"b{i}", float(v)) for i, v in enumerate([1, 2, 3, 10, 12, 17])], "b string, t double")
    facts = spark.createDataFrame([("g", "b0"), ("g", "b1"), ("g", "b2"), ("g", "b2"), ("one", "b5"), ("all", "b0"), *(("all", f"b{i}") for i in range(6))], "g string, b string")
    got = {r.g: r for r in stats.membership_t_test(facts, dim, "b", "g", F.col("t")).collect()}
    a, b = np.array([1, 2, 3.0]), np.array([10, 12, 17.0])
    va, vb = a.var(ddof=1) / 3, b.var(ddof=1) / 3
    assert got["g"].t == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
    assert got["g"].df == pytest.approx((va + vb) ** 2 / (va**2 / 2 + vb**2 / 2))
    assert (got["one"].n1, got["one"].df) == (1, 4.0) and got["all"].t is None and got["all"].p is None


def test_spearman(spark):
    df = spark.createDataFrame([("g", x, y) for x, y in [(1, 10), (2, 20), (2, 15), (4, 5), (5, 50)]], "g string, x int, y int")
    rank = lambda v: [sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v]
    want = np.corrcoef(rank([1, 2, 2, 4, 5]), rank([10, 20, 15, 5, 50]))[0, 1]
    assert stats.spearman(df, "g", "x", "y").first().rho == pytest.approx(want)


def test_naive_bayes_and_outliers(spark):
    data = [(1, "a", "x", "yes"), (2, "a", "y", "yes"), (3, "b", "y", "no"), (4, "b", None, "no"), (5, "a", "x", "no")]
    df = spark.createDataFrame(data, "id int, p string, q string, label string")
    table = mining.naive_bayes_table(df, ["p", "q"], "label")
    got = dict(rows(mining.naive_bayes_classify(df, "id", ["p", "q"], table), "id", "label"))
    assert got == {1: "yes", 2: "yes", 3: "no", 4: "no", 5: "yes"}
    scores = dict(rows(mining.avf_scores(df, "id", ["p", "q"]), "id", "score"))
    assert scores[1] == 2.5 and scores[3] == 2.0


def test_large_values_lose_no_digits(spark):
    dim = spark.createDataFrame([(f"b{i}", 1e9 + 0.1 * i) for i in range(6)], "b string, t double")
    facts = spark.createDataFrame([("g", f"b{i}") for i in range(3)] + [("none", "elsewhere")], "g string, b string")
    got = {r.g: r for r in joins.membership_split(facts, dim, "b", "g", F.col("t")).collect()}
    assert (got["g"].var1, got["g"].var2) == (pytest.approx(0.01, rel=1e-5), pytest.approx(0.01, rel=1e-5))
    assert got["g"].mean1 == pytest.approx(1e9 + 0.1, abs=1e-6) and got["g"].mean2 == pytest.approx(1e9 + 0.4, abs=1e-6)
    assert tuple(got["none"])[1:5:3] == (0, 6) and got["none"].mean1 is None and got["none"].var1 is None
    t = {r.g: r for r in stats.membership_t_test(facts, dim, "b", "g", F.col("t")).collect()}
    assert t["g"].t == pytest.approx(-0.3 / math.sqrt(0.02 / 3), rel=1e-5) and (t["none"].n1, t["none"].t, t["none"].p) == (0, None, None)
    line = spark.createDataFrame([(k, i, 1e8 + 0.001 * i * s) for i in range(10) for k, s in (("x", 1), ("y", 2))], "g string, s int, v double")
    out = stats.all_pairs_correlation(line, "g", "s", "v").first()
    assert out.r == pytest.approx(1, abs=1e-6) and out.p == pytest.approx(0, abs=1e-6)
    flat = spark.createDataFrame([(k, i, 3.0 if k == "x" else float(i)) for i in range(5) for k in "xy"], "g string, s int, v double")
    assert tuple(stats.all_pairs_correlation(flat, "g", "s", "v").first())[2:] == (5, None, None)
    one = mining.item_similarity(line, "s", "g", "v").first()
    assert one.pearson == pytest.approx(1, abs=1e-6)


def test_ranks_of_one_large_group(spark):
    df = spark.createDataFrame([("g", float(i % 50), i) for i in range(500)] + [(None, 1.0, 1)], "g string, v double, i int")
    out = order.positional_rank(df.repartition(7), "g", F.desc("v"), "i")
    want = {i: k + 1 for k, i in enumerate(sorted(range(500), key=lambda i: (-(i % 50), i)))}
    assert {r.i: r["rank"] for r in out.where("g = 'g'").collect()} == want
    assert [r["rank"] for r in out.where("g IS NULL").collect()] == [1]
    rho = stats.spearman(df.withColumn("w", F.col("i") * -1.0), "g", "i", "w").where("g = 'g'").first()
    assert (rho.n, rho.rho, rho.p) == (500, -1.0, 0.0)
    flat = stats.spearman(df.withColumn("w", F.lit(1)), "g", "i", "w").where("g = 'g'").first()
    assert (flat.n, flat.rho, flat.p) == (500, None, None)


def test_long_baskets(spark):
    """More items than are listed in one array, against all subsets."""
    items = [f"i{k:02d}" for k in range(14)]
    df = spark.createDataFrame([(1, x) for x in items] + [(2, items[0]), (2, items[13])], "g int, i string")
    out = mining.association_rules(df, "g", "i")
    assert out.count() == sum(math.comb(14, k) * k for k in range(2, 15))
    assert {(r.consequent, r.support, r.confidence) for r in out.where("antecedent = 'i00'").collect()} == {(x, 2 if x == "i13" else 1, 1.0 if x == "i13" else 0.5) for x in items[1:]}


def test_pooled_naive_bayes(spark):
    """A pooled table holds for every attribute, and many attributes don't underflow."""
    names = [f"c{i}" for i in range(120)]
    df = spark.createDataFrame([(i, *[str(i % 2) if k % 3 else str(i % 10) for k in range(120)], "even" if i % 2 == 0 else "odd") for i in range(40)], f"id int, {', '.join(f'{n} string' for n in names)}, label string")
    for pooled in (False, True):
        few = names if not pooled else names[:4]
        got = dict(rows(mining.naive_bayes_classify(df, "id", few, mining.naive_bayes_table(df, few, "label", pooled)), "id", "label"))
        assert got == {i: "even" if i % 2 == 0 else "odd" for i in range(40)}


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(4)
    s = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=3)], int(i % 3)) for i in range(200)], "id long, f array<double>, c int")
    q = s.where("id < 20")
    blocks = mining.knn_classify(q, s, "id", "f", "c", 5, most_bytes=500)
    assert plan(blocks).count("BroadcastNestedLoopJoin") > 1 and "CartesianProduct" not in plan(blocks)
    assert rows(blocks, "id", "label") == rows(mining.knn_classify(q, s, "id", "f", "c", 5), "id", "label")


def test_rectangles_of_all_sizes(spark):
    """Few rows for each rectangle, however large; overlap and containment against all pairs."""
    r = random.Random(6)
    boxes = []
    for i in range(120):
        x, y, w, h = r.uniform(-500, 500), r.uniform(-500, 500), 10 ** r.uniform(-1, 3.5), 10 ** r.uniform(-1, 3.5)
        boxes.append((i, x, x + w, y, y + h))
    df = spark.createDataFrame(boxes, "id int, xmin double, xmax double, ymin double, ymax double")
    a, b = df.where("id < 60"), df.where("id >= 60")
    meet = lambda p, q: p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]
    within = lambda p, q: p[1] >= q[1] and p[2] <= q[2] and p[3] >= q[3] and p[4] <= q[4]
    assert rows(spatial.overlap_join(a, b, 5.0), "a", "b") == [(p[0], q[0]) for p in boxes[:60] for q in boxes[60:] if meet(p, q)]
    assert rows(spatial.overlap_join(a, b, 5.0, spatial.inside), "a", "b") == [(p[0], q[0]) for p in boxes[:60] for q in boxes[60:] if within(p, q)]
    levels = list(range(12))
    assert spatial.cells(spatial._levelled(df, 5.0), 5.0, levels).groupBy("id").count().agg(F.max("count")).first()[0] <= 9 * len(levels)
    assert spatial.overlap_join(a.where("false"), b.where("false"), 5.0).count() == 0


def test_csv_goes_by_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('roll,name,grade\n1,"x ""q"", y",9.5\n2,z,bad\n3,short\n4,,7\n')
    (tmp_path / "b.csv").write_text("name,grade,extra,roll\nw,8,e,5\n")
    (tmp_path / "c d.csv").write_text("roll,name,grade\r\n6,v,1\r\n")
    out = sources.delimited(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c d.csv")], "roll int, name string, grade double", header=True)
    assert sorted((r.roll, r.name, r.grade) for r in out.collect()) == [(1, 'x "q", y', 9.5), (4, None, 7.0), (5, "w", 8.0), (6, "v", 1.0)]
    with pytest.raises(ValueError, match="cid"):
        sources.delimited(spark, str(tmp_path / "b.csv"), "cid int", header=True)


def test_counts_of_characters_and_bases(spark):
    lines = ["Abca", "", None, "a\u00e9\u00e9\n", "%"]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    want = {}
    for c in "".join(x or "" for x in lines):
        want[c.lower()] = want.get(c.lower(), 0) + 1
    assert dict(rows(text.char_count(df), "ch", "n")) == want == dict(rows(text.char_count(df, local=False), "ch", "n"))
    seqs = spark.createDataFrame([(">ACGT",), ("acgN",), (" AC ",), (None,), ("",)], "value string")
    assert dict(rows(text.base_count(seqs), "base", "n")) == {"A": 2, "C": 2, "G": 1, "other": 1}


def test_shared_tables(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = tables.materialize(spark.range(5).toDF("x"), "numbers")
    assert df.count() == 5 and os.path.isdir(df.written_at)
    tables.discard(df)
    assert not os.path.exists(df.written_at)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        tables.scratch(Elsewhere)


def test_functions(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [3.0, 4.0], [0.0, 0.0], 5, 2)], "i array<string>, x array<double>, y array<double>, n int, k int")
    row = df.select(fn.subsets("i"), fn.euclidean("x", "y"), fn.without_index("i", 1), fn.choose(F.col("n"), F.col("k")), fn.choose(F.col("k"), F.col("n")), fn.dot("x", "x"), fn.add("x", "x"), fn.scale("x", 2.0), fn.sorted_letters(F.lit("cab"))).first()
    assert sorted(map(tuple, row[0])) == sorted(c for k in (1, 2, 3) for c in combinations("abc", k))
    assert tuple(row[1:6]) == (5.0, ["a", "c"], 10.0, 0.0, 25.0) and row[6] == row[7] == [6.0, 8.0] and row[8] == "abc"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,v\n1,"x, y",2.5\nbad,row\n3,z,1\n')
    assert rows(sources.delimited(spark, str(tmp_path / "a.csv"), "id int, name string, v double", header=True), "id", "name") == [(1, "x, y"), (3, "z")]
    lines = spark.createDataFrame([("a 1",), ("b x",), ("c",), (None,)], "value string")
    assert rows(sources.split_lines(lines, [("k", "string"), ("n", "int")]), "k", "n") == [("a", 1)]
    assert [sources.buckets_needed(*a) for a in ((3, 10, 5), (100, 10, 20), (1000, 10, 20))] == [3, 10, 50]
    for i in range(7):
        (tmp_path / f"t{i}.txt").write_text(f"line {i}\n")
    assert sources.consolidate(spark, str(tmp_path / "t*.txt"), str(tmp_path / "out"), 2, 4) == 2
    assert len(list((tmp_path / "out").glob("part-*"))) == 2 and sources.lines(spark, str(tmp_path / "out")).count() == 7
    df = sources.generate_counts(spark, 100, 7)
    sources.write_parquet(df, str(tmp_path / "p"), "key")
    sources.write_text(df, str(tmp_path / "w"), single=True)
    assert sources.parquet(spark, str(tmp_path / "p")).count() == 100 and len(list((tmp_path / "w").glob("part-*"))) == 1
    (tmp_path / "j.json").write_text('{"name": "n", "address": {"city": "c"}}\n')
    assert sources.json_rows(spark, str(tmp_path / "j.json")).select("address.city").first()[0] == "c"


def test_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2)) + np.repeat([[0, 0], [10, 10]], 100, axis=0)
    df = spark.createDataFrame([(i, [float(a), float(b)], float(a), float(b), 3 * float(a) - 2 * float(b) + 1, float(i >= 100), "cheap pills" if i >= 100 else "see you soon") for i, (a, b) in enumerate(x)], "id int, f array<double>, a double, b double, y double, label double, text string")
    linear = ml.fit_linear(df, ["a", "b"], "y")
    assert [*linear.coefficients, linear.intercept] == pytest.approx([3, -2, 1])
    logistic = ml.fit_logistic(df, ["a", "b"], "label")
    assert agg.accuracy(logistic.transform(ml.as_vector(df, ["a", "b"])), "prediction", "label").first()[0] > 0.99
    mail = ml.fit_text_logistic(df, "text", "label").transform(df)
    assert agg.accuracy(mail, "prediction", "label").first()[0] == 1.0
    centres = sorted(ml.kmeans(df, "id", "f", 2))
    model, cost = ml.fit_kmeans(df, "f", 2)
    assert np.allclose(centres, sorted(c.tolist() for c in model.clusterCenters()), atol=1e-6) and cost > 0
    positive = df.select("label", *((F.col(c) + 20).alias(c) for c in "ab"))
    bayes = ml.fit_naive_bayes(positive, ["a", "b"], "label")
    ml.save_model(bayes, str(tmp_path / "m"))
    again, want = (m.transform(ml.as_vector(positive, ["a", "b"])) for m in (ml.load_model(str(tmp_path / "m")), bayes))
    assert rows(again, "a", "prediction") == rows(want, "a", "prediction")
    ml.save_model(ml.fit_text_logistic(df, "text", "label"), str(tmp_path / "p"))
    assert rows(ml.load_model(str(tmp_path / "p")).transform(df), "id", "prediction") == rows(mail, "id", "prediction")


def test_kmeans_goes_on_until_it_rests(spark):
    """Centres that begin at one end of a line need more than twenty rounds."""
    points = [float(i) for i in range(300)]
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(points)], "id int, f array<double>").coalesce(1)
    centres, rounds = np.array(points[:4]), 0
    while True:
        near = np.abs(np.array(points)[:, None] - centres[None, :]).argmin(axis=1)
        new = np.array([np.mean(np.array(points)[near == k]) for k in range(4)])
        rounds += 1
        if np.mean((new - centres) ** 2) <= 1e-6:
            break
        centres = new
    assert rounds > 20 and [c[0] for c in ml.kmeans(df, "id", "f", 4)] == pytest.approx(list(new))
    assert ml.kmeans(df.where("false"), "id", "f", 2) == []
    assert len(ml.kmeans(df, "id", "f", 2, rounds=1)) == 2


def test_streaming(spark, tmp_path):
    rows_ = [(f"2020-01-01 00:{m:02d}:00", "u" if m % 2 else "v") for m in range(0, 40, 3)] + [("2020-01-02 00:00:00", "u")]
    df = spark.createDataFrame(rows_, "t string, k string").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    batch = streaming.windowed_counts(df, "t", "k", "10 minutes")
    q = streaming.windowed_counts(stream, "t", "k", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts"), "start", "k", "n") == rows(batch, "start", "k", "n")
    assert streaming.sessions(df, "t", "k", "10 minutes").count() == 3
