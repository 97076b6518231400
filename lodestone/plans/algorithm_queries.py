"""Graph, spatial, mining, statistics and model queries."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import graph, mining, ml, spatial, stats
from lodestone.plans.registry import query
from lodestone.tables import discard_at_exit, scratch

# edges join the parts of neighbouring lines of an order
_EDGES = """e AS MATERIALIZED (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey),
s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


def _edges(t):
    a = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    b = t("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return graph.undirected(a.join(b, ["l_orderkey", "l_linenumber"]))


@query(f"WITH {_EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst")
def triangles(t):
    return graph.triangles(_edges(t))


_COMMON = "k AS (SELECT e.src, e.dst, p.dst AS o FROM e JOIN s p ON p.src = e.src JOIN s q ON q.src = e.dst AND q.dst = p.dst)"


@query(f"WITH {_EDGES}, {_COMMON} SELECT p.src AS u, p.dst AS v, p.o AS b, q.o AS d FROM k p JOIN k q ON p.src = q.src AND p.dst = q.dst AND p.o < q.o")
def diamonds(t):
    return graph.diamonds(_edges(t))


_TOTAL = f"WITH {_EDGES}, {_COMMON} SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT AS total FROM (SELECT count(*) AS c FROM k GROUP BY src, dst)"


@query(_TOTAL)
def diamond_total(t):
    return graph.diamond_total(_edges(t))


@query(_TOTAL)
def diamond_total_partitioned(t):
    return graph.diamond_total_partitioned(_edges(t), 5)


@query(f"WITH {_EDGES}, {_COMMON} SELECT e.src, e.dst, coalesce(string_agg(o, ',' ORDER BY o), '') AS common FROM e LEFT JOIN k ON k.src = e.src AND k.dst = e.dst GROUP BY ALL")
def common_friends(t):
    return graph.common_friends(_edges(t)).withColumn("common", F.array_join("common", ","))


_RECOMMENDED = f"WITH {_EDGES}, r AS (SELECT p.dst AS person, q.dst AS candidate, p.src AS m FROM s p JOIN s q ON p.src = q.src AND p.dst <> q.dst ANTI JOIN s d ON d.src = p.dst AND d.dst = q.dst)"


@query(_RECOMMENDED + " SELECT person, candidate, count(*) AS n, string_agg(m, ',' ORDER BY m) AS mutual FROM r GROUP BY ALL")
def friend_recommendation(t):
    return graph.recommend_friends(_edges(t)).withColumn("mutual", F.array_join("mutual", ","))


@query(_RECOMMENDED + ", c AS (SELECT person, candidate, count(*) AS n FROM r GROUP BY ALL) SELECT person, candidate, n, row_number() OVER (PARTITION BY person ORDER BY n DESC, candidate) AS rank FROM c QUALIFY rank <= 5")
def friend_recommendation_topn(t):
    return graph.recommend_friends_topn(_edges(t), 5).withColumn("rank", F.col("rank").cast("long"))


# views are groupings of lineitem by some of three columns; a view costs its number of rows and answers all coarser ones
_BY = ["l_returnflag", "l_linestatus", "l_linenumber"]
_VIEWS = [[c for i, c in enumerate(_BY) if not m >> i & 1] for m in range(8)]
_name = lambda v: "+".join(c[2:] for c in v) or "all"
_COSTS = "views AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT {i} AS place, '{_name(v)}' AS view, [{', '.join(repr(c) for c in v)}]::VARCHAR[] AS cols, {f'(SELECT count(*) FROM (SELECT DISTINCT {", ".join(v)} FROM lineitem))' if v else 1} AS cost" for i, v in enumerate(_VIEWS)
) + ")"
_GREEDY = f"WITH {_COSTS}, below AS (SELECT a.place AS v, b.place AS d FROM views a JOIN views b ON list_has_all(a.cols, b.cols)), now0 AS (SELECT place AS d, (SELECT cost FROM views WHERE place = 0) AS cost FROM views), pick0 AS (SELECT 0 AS v)"
for _i in range(1, 4):
    _taken = " UNION ALL ".join(f"SELECT v FROM pick{j}" for j in range(_i))
    _GREEDY += f""", gain{_i} AS (SELECT v, sum(greatest(0, n.cost - views.cost))::BIGINT AS benefit FROM below JOIN now{_i - 1} n USING (d) JOIN views ON views.place = v WHERE v NOT IN ({_taken}) GROUP BY v),
pick{_i} AS MATERIALIZED (SELECT v, benefit FROM gain{_i} ORDER BY benefit DESC, v LIMIT 1),
now{_i} AS MATERIALIZED (SELECT d, least(n.cost, coalesce((SELECT views.cost FROM pick{_i} JOIN views ON place = pick{_i}.v JOIN below b ON b.v = pick{_i}.v AND b.d = n.d), n.cost)) AS cost FROM now{_i - 1} n)"""


def _lattice(t):
    """(cost of each view, finest first; edges from a view to those with one column less)."""
    rows = t("lineitem").agg(*(F.countDistinct(F.struct(*v)).alias(str(i)) if v else F.lit(1).alias(str(i)) for i, v in enumerate(_VIEWS))).first()
    edges = [(_name(v), _name([c for c in v if c != gone])) for v in _VIEWS for gone in v]
    return [(_name(v), rows[i]) for i, v in enumerate(_VIEWS)], edges


@query(_GREEDY + "".join(f" {'UNION ALL ' if i > 1 else ''}SELECT {i} AS round, view, benefit FROM pick{i} JOIN views ON place = v" for i in range(1, 4)))
def greedy_views(t):
    picks = graph.greedy_views(*_lattice(t), 3)
    return t("region").sparkSession.createDataFrame([(i + 1, v, b) for i, (v, b) in enumerate(picks)], "round int, view string, benefit long")


@query(f"WITH {_COSTS} SELECT a.view AS parent, b.view AS child FROM views a JOIN views b ON list_has_all(a.cols, b.cols)")
def reachable_views(t):
    return graph.reachable(t("region").sparkSession.createDataFrame(_lattice(t)[1], "parent string, child string"))


# an order points to the customer's next one; the oldest orders reach all later ones
_NEXT = "(SELECT o_orderkey AS parent, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS child FROM orders)"


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_NEXT} WHERE child IS NOT NULL), n AS (SELECT parent AS x FROM e UNION SELECT child FROM e), r AS (SELECT x AS parent, x AS child FROM n UNION SELECT r.parent, e.child FROM r JOIN e ON r.child = e.parent) SELECT parent, child FROM r")
def reachable_orders(t):
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return graph.reachable(t("orders").select(F.col("o_orderkey").alias("parent"), after.alias("child")).where("child IS NOT NULL"))


_RECTS = "(SELECT c_custkey AS id, c_custkey % 4 AS rel, c_acctbal AS xmin, c_acctbal + 250 AS xmax, (c_custkey * 7919 % 10007)::DOUBLE AS ymin, (c_custkey * 7919 % 10007)::DOUBLE + 250 AS ymax FROM customer)"
_MEET = "{0}.xmin <= {1}.xmax AND {1}.xmin <= {0}.xmax AND {0}.ymin <= {1}.ymax AND {1}.ymin <= {0}.ymax"


@query(f"WITH t AS (SELECT * FROM {_RECTS}) SELECT p.id AS p, q.id AS q, r.id AS r, s.id AS s FROM t p JOIN t q ON {_MEET.format('p', 'q')} JOIN t r ON {_MEET.format('q', 'r')} JOIN t s ON {_MEET.format('r', 's')} WHERE p.rel = 0 AND q.rel = 1 AND r.rel = 2 AND s.rel = 3")
def spatial_overlap_join(t):
    y = (F.col("c_custkey") * 7919 % 10007).cast("double")
    boxes = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("rel"), F.col("c_acctbal").alias("xmin"), (F.col("c_acctbal") + 250).alias("xmax"), y.alias("ymin"), (y + 250).alias("ymax"))
    return spatial.overlap_chain([boxes.where(F.col("rel") == i) for i in range(4)], ["p", "q", "r", "s"], 500.0)


_BRANDS = "(SELECT DISTINCT l_orderkey AS g, p_brand AS x FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _baskets(t, item):
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", item)


@query(f"SELECT a.x AS item1, b.x AS item2, count(*) AS n FROM {_BRANDS} a JOIN {_BRANDS} b ON a.g = b.g AND a.x < b.x GROUP BY ALL")
def basket_pairs(t):
    return mining.basket_combinations(_baskets(t, "p_brand"), "l_orderkey", "p_brand")


@query(f"SELECT a.x AS item1, b.x AS item2, c.x AS item3, count(*) AS n FROM {_BRANDS} a JOIN {_BRANDS} b ON a.g = b.g AND a.x < b.x JOIN {_BRANDS} c ON b.g = c.g AND b.x < c.x GROUP BY ALL")
def basket_triples(t):
    return mining.basket_combinations(_baskets(t, "p_brand"), "l_orderkey", "p_brand", 3)


@query("""WITH b AS (SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
p AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)::INT) & 1 = 1) AS s FROM (SELECT items, unnest(range(1, (1 << len(items)::INT))) AS m FROM b)),
c AS (SELECT s, count(*) AS n FROM p GROUP BY s), r AS (SELECT s, n, unnest(s) AS consequent FROM c WHERE len(s) > 1)
SELECT array_to_string(c.s, ',') AS antecedent, consequent, r.n AS support, round(r.n / c.n, 9) AS confidence FROM r JOIN c ON c.s = list_filter(r.s, lambda x: x <> consequent)""")
def association_rules(t):
    return mining.association_rules(_baskets(t, "p_type"), "l_orderkey", "p_type").withColumn("confidence", F.round("confidence", 9))


@query("""WITH b AS (SELECT o_custkey AS u, p_brand AS i, round(avg(l_quantity), 0) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY i) AS k FROM b),
s AS (SELECT x.i AS item1, y.i AS item2, count(*) AS n, covar_pop(x.r, y.r) / nullif(sqrt(var_pop(x.r)) * sqrt(var_pop(y.r)), 0) AS p, sum(x.r * y.r) AS sxy, sum(x.r * x.r) AS sxx, sum(y.r * y.r) AS syy, max(x.k) AS n1, max(y.k) AS n2 FROM c x JOIN c y ON x.u = y.u AND x.i < y.i GROUP BY ALL)
SELECT item1, item2, n, round(p, 6) AS pearson, round(sxy / nullif(sqrt(sxx) * sqrt(syy), 0), 6) AS cosine, round(n / (n1 + n2 - n), 6) AS jaccard FROM s""")
def movie_similarity(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    ratings = rows.groupBy("o_custkey", "p_brand").agg(F.round(F.avg("l_quantity"), 0).alias("rating"))
    out = mining.item_similarity(ratings, "o_custkey", "p_brand", "rating")
    return out.select("item1", "item2", "n", *(F.round(c, 6).alias(c) for c in ("pearson", "cosine", "jaccard")))


@query("""WITH v AS (SELECT p_partkey, unnest([p_brand, p_type, p_size::VARCHAR]) AS x FROM part), c AS (SELECT x, count(*) AS n FROM v GROUP BY x)
SELECT p_partkey, round(avg(n), 6) AS score FROM v JOIN c USING (x) GROUP BY 1 ORDER BY score, p_partkey LIMIT 10""")
def avf_outliers(t):
    return mining.avf_scores(t("part"), "p_partkey", ["p_brand", "p_type", "p_size"]).withColumn("score", F.round("score", 6)).orderBy("score", "p_partkey").limit(10)


@query("""WITH m AS (SELECT l_returnflag AS s, l_partkey AS g, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL), r AS (SELECT g, row_number() OVER (PARTITION BY s ORDER BY abs(m) DESC, g) AS r FROM m)
SELECT g AS l_partkey, round(exp(avg(ln(r))), 6) AS rank_product, count(*) AS n FROM r GROUP BY g""")
def rank_product(t):
    return mining.rank_product(t("lineitem"), "l_returnflag", "l_partkey", "l_extendedprice").withColumn("rank_product", F.round("rank_product", 6))


@query("""WITH d AS (SELECT r.vec_id, s.label, s.vec_id AS s, row_number() OVER (PARTITION BY r.vec_id ORDER BY sqrt(list_sum(list_transform(list_zip(r.embedding::DOUBLE[], s.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), s.vec_id) AS k
  FROM embeddings r, embeddings s WHERE r.vec_id % 100 = 0 AND s.vec_id % 100 <> 0),
v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE k <= 5 GROUP BY ALL) SELECT vec_id, label FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""")
def knn_classify(t):
    e = t("embeddings")
    return mining.knn_classify(e.where("vec_id % 100 = 0"), e.where("vec_id % 100 <> 0"), "vec_id", "embedding", "label", 5)


_BAYES = """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS label, l_linestatus AS status, floor(l_quantity / 10)::INT::VARCHAR AS band, year(l_shipdate)::VARCHAR AS yr FROM lineitem),
tot AS (SELECT label, count(*) AS m FROM r GROUP BY 1), cells AS (SELECT label, unnest([{'a': 'status', 'v': status}, {'a': 'band', 'v': band}, {'a': 'yr', 'v': yr}]) AS c FROM r),
tab AS (SELECT c.a AS attr, c.v AS value, label, count(*) / any_value(m) AS p FROM cells JOIN tot USING (label) GROUP BY c.a, c.v, label)"""


def _bayes(t):
    li = t("lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("status"), F.floor(F.col("l_quantity") / 10).cast("int").cast("string").alias("band"), F.year("l_shipdate").cast("string").alias("yr"))


@query(_BAYES + " SELECT attr, value, label, round(p, 9) AS p FROM tab UNION ALL SELECT 'CLASS', NULL, label, round(m / sum(m) OVER (), 9) FROM tot")
def naive_bayes_table(t):
    return mining.naive_bayes_table(_bayes(t), ["status", "band", "yr"], "label").withColumn("p", F.round("p", 9))


@query(_BAYES + """, u AS (SELECT DISTINCT status, band, yr FROM r), prior AS (SELECT label, m / sum(m) OVER () AS p FROM tot),
sc AS (SELECT u.status, u.band, u.yr, prior.label, prior.p * coalesce(a.p, 0) * coalesce(b.p, 0) * coalesce(c.p, 0) AS score FROM u CROSS JOIN prior
  LEFT JOIN tab a ON a.attr = 'status' AND a.value = u.status AND a.label = prior.label LEFT JOIN tab b ON b.attr = 'band' AND b.value = u.band AND b.label = prior.label LEFT JOIN tab c ON c.attr = 'yr' AND c.value = u.yr AND c.label = prior.label),
best AS (SELECT status, band, yr, label FROM sc QUALIFY row_number() OVER (PARTITION BY status, band, yr ORDER BY score DESC, label) = 1)
SELECT r.id, best.label FROM r JOIN best ON r.status = best.status AND r.band = best.band AND r.yr = best.yr""")
def naive_bayes_classify(t):
    rows, attributes = _bayes(t), ["status", "band", "yr"]
    return mining.naive_bayes_classify(rows, "id", attributes, mining.naive_bayes_table(rows, attributes, "label"))


# two-sided p of Student's t: the density over the angle atan(t / sqrt(df)), by Simpson's rule
_T_P = """(1 - 2 * exp(lgamma(({1} + 1) / 2) - lgamma({1} / 2)) / sqrt(pi()) * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * pow(cos(atan(abs({0}) / sqrt({1})) * i / 400), {1} - 1))) * atan(abs({0}) / sqrt({1})) / 1200)"""

# every other brand also has a customer who is not in the dimension, and one group has no other
_TTEST = f"""WITH f AS (SELECT DISTINCT p_brand AS g, o_custkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'nobody', -1),
d AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), gs AS (SELECT DISTINCT g FROM f),
x AS (SELECT gs.g, d.v, f.k IS NOT NULL AS inside FROM gs CROSS JOIN d LEFT JOIN f ON f.g = gs.g AND f.k = d.k),
s AS (SELECT g, count(*) FILTER (inside) AS n1, count(*) FILTER (NOT inside) AS n2, avg(v) FILTER (inside) AS m1, avg(v) FILTER (NOT inside) AS m2, var_samp(v) FILTER (inside) AS v1, var_samp(v) FILTER (NOT inside) AS v2 FROM x GROUP BY g),
r AS (SELECT g, n1, n2, CASE WHEN n1 > 1 AND n2 > 1 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) WHEN n1 = 1 AND n2 > 1 THEN (m1 - m2) / sqrt(v2 / n2) WHEN n2 = 1 AND n1 > 1 THEN (m1 - m2) / sqrt(v1 / n1) END AS t,
  CASE WHEN n1 > 1 AND n2 > 1 THEN pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) WHEN n1 = 1 AND n2 > 1 THEN n2 - 1.0 WHEN n2 = 1 AND n1 > 1 THEN n1 - 1.0 END AS df FROM s)
SELECT g AS p_brand, n1, n2, round(t, 5) AS t, round(df, 3) AS df, CASE WHEN t IS NOT NULL THEN round({_T_P.format('t', 'df')}, 5) END AS p FROM r"""


@query(_TTEST)
def ttest(t):
    facts = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.col("o_custkey").alias("c_custkey"))
    facts = facts.unionByName(t("region").where("r_regionkey = 0").select(F.lit("nobody").alias("p_brand"), F.lit(-1).cast("long").alias("c_custkey")))
    out = stats.membership_t_test(facts, t("customer").select("c_custkey", "c_acctbal"), "c_custkey", "p_brand", F.col("c_acctbal"))
    return out.select("p_brand", "n1", "n2", F.round("t", 5).alias("t"), F.round("df", 3).alias("df"), F.round("p", 5).alias("p"))


_R_T = "r * sqrt(n - 2) / sqrt(greatest(1 - r * r, 0))"
_R_P = f"CASE WHEN n > 2 AND r IS NOT NULL THEN CASE WHEN r * r >= 1 THEN 0 ELSE round({_T_P.format(f'({_R_T})', '(n - 2.0)')}, 5) END END"


@query(f"""WITH m AS (SELECT p_brand AS i, o_custkey AS s, avg(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
q AS (SELECT a.i AS item1, b.i AS item2, count(*) AS n, CASE WHEN count(*) >= 3 THEN covar_pop(a.v, b.v) / nullif(sqrt(var_pop(a.v)) * sqrt(var_pop(b.v)), 0) END AS r FROM m a JOIN m b ON a.s = b.s AND a.i < b.i GROUP BY ALL)
SELECT item1, item2, n, round(r, 6) AS r, {_R_P} AS p FROM q""")
def all_vs_all_corr(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.all_pairs_correlation(rows, "p_brand", "o_custkey", "l_quantity").select("item1", "item2", "n", F.round("r", 6).alias("r"), F.round("p", 5).alias("p"))


@query(f"""WITH x AS (SELECT l_suppkey AS g, l_quantity AS a, l_extendedprice AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS a, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2 AS b FROM x),
q AS (SELECT g, count(*) AS n, covar_pop(a, b) / nullif(sqrt(var_pop(a)) * sqrt(var_pop(b)), 0) AS r FROM k GROUP BY g)
SELECT g AS l_suppkey, n, round(r, 6) AS rho, {_R_P} AS p FROM q""")
def spearman(t):
    return stats.spearman(t("lineitem"), "l_suppkey", "l_quantity", "l_extendedprice").select("l_suppkey", "n", F.round("rho", 6).alias("rho"), F.round("p", 5).alias("p"))


_CENTRES = [[10.0, 20000.0], [25.0, 35000.0], [40.0, 55000.0]]


@query("""WITH d AS (SELECT l_quantity AS q, l_extendedprice AS e, pow(l_quantity - 10, 2) + pow(l_extendedprice - 20000, 2) AS a, pow(l_quantity - 25, 2) + pow(l_extendedprice - 35000, 2) AS b, pow(l_quantity - 40, 2) + pow(l_extendedprice - 55000, 2) AS c FROM lineitem)
SELECT CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cluster, count(*) AS n, round(avg(q), 6) AS q, round(avg(e), 4) AS e FROM d GROUP BY 1""")
def kmeans_step(t):
    points = t("lineitem").select(F.array("l_quantity", "l_extendedprice").alias("f"))
    out = ml.kmeans_step(points, "f", _CENTRES)
    return out.select("cluster", "n", F.round(F.col("centre")[0], 6).alias("q"), F.round(F.col("centre")[1], 4).alias("e"))


_OLS = """WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS y, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab,
  covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS by_ FROM lineitem),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb, a, b, y FROM m), c AS (SELECT wa, wb, y - wa * a - wb * b AS w0 FROM w)"""


@query(_OLS + " SELECT round(w0, 2) AS intercept, round(wa, 3) AS quantity, round(wb, 1) AS discount FROM c")
def ols_fit(t):
    model = ml.fit_linear(t("lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    row = (round(model.intercept, 2), *(round(float(c), n) for c, n in zip(model.coefficients, (3, 1), strict=True)))
    return t("region").sparkSession.createDataFrame([row], "intercept double, quantity double, discount double")


# rounds of the loop, each an aggregate over all rows, until no centre moves
_LLOYD = f"""WITH RECURSIVE r(i, c, shift) AS (SELECT 0, {_CENTRES}::DOUBLE[][], 1e300::DOUBLE UNION ALL
  SELECT i + 1, list([q, e] ORDER BY k), avg(pow(q - c[k][1], 2) + pow(e - c[k][2], 2)) FROM (
    SELECT i, any_value(c) AS c, k, avg(q) AS q, avg(e) AS e FROM (
      SELECT i, c, q, e, list_position(d, list_min(d)) AS k FROM (SELECT r.i, r.c, l_quantity AS q, l_extendedprice AS e, [pow(l_quantity - c[1][1], 2) + pow(l_extendedprice - c[1][2], 2), pow(l_quantity - c[2][1], 2) + pow(l_extendedprice - c[2][2], 2), pow(l_quantity - c[3][1], 2) + pow(l_extendedprice - c[3][2], 2)] AS d
        FROM r, lineitem WHERE r.shift > 1e-6)) GROUP BY i, k) GROUP BY i)"""


@query(_LLOYD + " SELECT k - 1 AS cluster, round(c[k][1], 4) AS q, round(c[k][2], 2) AS e FROM (SELECT c, unnest([1, 2, 3]) AS k FROM r ORDER BY i DESC LIMIT 3)")
def kmeans_model(t):
    points = t("lineitem").select("l_orderkey", F.array("l_quantity", "l_extendedprice").alias("f"))
    centres = ml.kmeans(points, "l_orderkey", "f", 3, centres=_CENTRES)
    return t("region").sparkSession.createDataFrame([(i, round(q, 4), round(e, 2)) for i, (q, e) in enumerate(centres)], "cluster long, q double, e double")


@query()
def kmeans_library_model(t):
    model, _ = ml.fit_kmeans(t("embeddings"), "embedding", 5)
    return model.transform(ml.as_vector(t("embeddings"), "embedding")).select("vec_id", "prediction")


@query(_OLS + " SELECT l_orderkey, l_linenumber, round(w0 + wa * l_quantity + wb * l_discount, 2) AS prediction FROM lineitem, c")
def linear_regression(t):
    model = ml.fit_linear(t("lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    out = model.transform(ml.as_vector(t("lineitem"), ["l_quantity", "l_discount"]))
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@query()
def logistic_regression(t):
    rows = t("lineitem").withColumn("label", (F.col("l_returnflag") == "N").cast("double"))
    model = ml.fit_logistic(rows, ["l_quantity", "l_discount", "l_tax"], "label", rounds=10)
    return model.transform(ml.as_vector(rows, ["l_quantity", "l_discount", "l_tax"])).select("l_orderkey", "l_linenumber", "prediction")


@query()
def multinomial_logistic(t):
    rows = t("embeddings").withColumn("label", F.col("label").cast("double"))
    model = ml.fit_logistic(rows, "embedding", "label", "multinomial", 10)
    return model.transform(ml.as_vector(rows, "embedding")).select("vec_id", "prediction")


@query()
def text_logistic(t):
    rows = t("documents").join(t("labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))
    return ml.fit_text_logistic(rows, "text", "label").transform(rows).select("doc_id", "prediction")


_MULTINOMIAL = """WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 0.0 WHEN 'R' THEN 1.0 ELSE 2.0 END AS label, [l_quantity, l_discount, l_tax] AS f FROM lineitem),
m AS (SELECT label, count(*) AS n, sum(f[1]) AS a, sum(f[2]) AS b, sum(f[3]) AS c FROM r GROUP BY label),
w AS (SELECT label, ln(n + 1.0) - ln(sum(n) OVER () + count(*) OVER ()) AS w0, ln(a + 1) - ln(a + b + c + 3) AS wa, ln(b + 1) - ln(a + b + c + 3) AS wb, ln(c + 1) - ln(a + b + c + 3) AS wc FROM m),
u AS (SELECT DISTINCT f FROM r), p AS (SELECT f, arg_max(label, w0 + wa * f[1] + wb * f[2] + wc * f[3]) AS prediction FROM u, w GROUP BY f)
SELECT l_orderkey, l_linenumber, prediction FROM r JOIN p USING (f)"""


def _labelled(t):
    return t("lineitem").withColumn("label", F.when(F.col("l_returnflag") == "N", 0.0).when(F.col("l_returnflag") == "R", 1.0).otherwise(2.0))


@query(_MULTINOMIAL)
def naive_bayes_model(t):
    model = ml.fit_naive_bayes(_labelled(t), ["l_quantity", "l_discount", "l_tax"], "label")
    return model.transform(ml.as_vector(_labelled(t), ["l_quantity", "l_discount", "l_tax"])).select("l_orderkey", "l_linenumber", "prediction")


@query(_MULTINOMIAL)
def model_saved_and_loaded(t):
    place = f"{scratch(t('region').sparkSession)}/model-{uuid.uuid4().hex}"
    ml.save_model(ml.fit_naive_bayes(_labelled(t), ["l_quantity", "l_discount", "l_tax"], "label"), place)
    discard_at_exit(t("region").sparkSession, place)
    return ml.load_model(place).transform(ml.as_vector(_labelled(t), ["l_quantity", "l_discount", "l_tax"])).select("l_orderkey", "l_linenumber", "prediction")
