"""Joins, aggregations, orderings and set operations over the star schema."""

from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone import sources
from lodestone.operators import agg, joins, order
from lodestone.plans.registry import query
from lodestone.streaming import sessions, windowed_counts
from lodestone.tables import materialize

_DAY = "strftime({}, '%Y-%m-%d')"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("SELECT o_orderkey, c_custkey, c_name, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def equi_join(t):
    return joins.equi_join(t("orders"), t("customer").withColumn("o_custkey", F.col("c_custkey")), "o_custkey").select("o_orderkey", "c_custkey", "c_name", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def broadcast_join(t):
    dims = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("c_nationkey", F.col("n_nationkey"))
    return joins.lookup_join(t("customer"), dims, "c_nationkey").select("c_custkey", "n_name", "r_name")


_CHAIN = "SELECT c_custkey AS a, o_orderkey AS b, l_partkey AS c, p_brand AS d FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"


def _chain(t, strategy):
    r = t("orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    s = t("lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_partkey").alias("c"))
    d = t("part").select(F.col("p_partkey").alias("c"), F.col("p_brand").alias("d"))
    return joins.chain_join(r, s, d, strategy=strategy).select("a", "b", "c", "d")


@query(_CHAIN)
def chain_join(t):
    return _chain(t, "chain")


@query(_CHAIN)
def shares_join(t):
    return _chain(t, "shares")


_USERS = "(SELECT c_custkey AS u, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS location FROM customer)"


@query(f"SELECT o_orderpriority, count(DISTINCT location) AS n FROM orders LEFT JOIN {_USERS} ON u = o_custkey GROUP BY 1")
def left_join_distinct_locations(t):
    users = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("location"))
    return joins.left_join_distinct(t("orders"), users, "o_custkey", "o_orderpriority", "location")


@query(f"SELECT o_orderpriority, count(DISTINCT coalesce(location::VARCHAR, 'unknown')) AS n FROM orders LEFT JOIN {_USERS} ON u = o_custkey GROUP BY 1")
def left_join_unknown_location(t):
    users = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).cast("string").alias("location"))
    return joins.left_join_distinct(t("orders"), users, "o_custkey", "o_orderpriority", "location", "unknown")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_orderkey), 0), 9) AS share FROM lineitem")
def share_of_order(t):
    return joins.share_of_group(t("lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", F.round("share", 9).alias("share"))


@query("SELECT r_name, n_name FROM region, nation")
def cartesian(t):
    return joins.cartesian(t("region").select("r_name"), t("nation").select("n_name"))


@query("SELECT a.l_returnflag, n, m, round(n / m, 9) AS part FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) a JOIN (SELECT l_returnflag, count(*) AS m FROM lineitem GROUP BY ALL) b ON a.l_returnflag = b.l_returnflag")
def subquery_join(t):
    text = """SELECT a.l_returnflag, n, m, round(n / m, 9) AS part FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus) a
      JOIN (SELECT l_returnflag, count(*) AS m FROM {lineitem} GROUP BY l_returnflag) b ON a.l_returnflag = b.l_returnflag"""
    return sources.sql(text, lineitem=t("lineitem"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join_extension(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_extension(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY l_suppkey")
def mean_by_key(t):
    return agg.mean_by_key(t("lineitem"), "l_suppkey", "l_quantity").withColumn("mean", F.round("mean", 6))


@query("SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_partkey")
def sum_by_key(t):
    return agg.sum_by_key(t("lineitem"), "l_partkey", "l_quantity")


@query("SELECT min(value) AS min, max(value) AS max, round(sum(value), 3) AS sum, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events")
def min_max(t):
    out = agg.min_max(t("events"), "value")
    return out.select("min", "max", F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL")
def combine_by_key(t):
    return agg.combine_by_key(t("lineitem"), ["l_returnflag", "l_linestatus"], n=F.count("*"), quantity=F.sum("l_quantity"), discount=F.round(F.avg("l_discount"), 6))


@query("SELECT user_id, event_type, count(*) AS n, sum(coalesce(CASE WHEN event_id % 10 <> 0 THEN floor(value)::BIGINT END, 0))::BIGINT AS bytes FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND event_type <> '-' GROUP BY ALL")
def log_query_stats(t):
    logs = t("events").withColumn("bytes", F.when(F.col("event_id") % 10 != 0, F.floor("value")))
    return agg.log_statistics(logs, ["user_id", "event_type"], "bytes")


@query("""WITH g AS (SELECT o_custkey, year(o_orderdate) AS term, CASE l_returnflag WHEN 'A' THEN 9 WHEN 'N' THEN 8 WHEN 'R' THEN 7 END AS p, l_quantity AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT o_custkey, term, sum(p * c) AS s, sum(c) AS w FROM g WHERE c > 0 AND p IS NOT NULL GROUP BY ALL)
SELECT o_custkey, term, round(s / w, 9) AS term_mean, round(sum(s) OVER o / sum(w) OVER o, 9) AS running_mean FROM s WINDOW o AS (PARTITION BY o_custkey ORDER BY term ROWS UNBOUNDED PRECEDING)""")
def weighted_mean_running(t):
    grades = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("term", F.year("o_orderdate").cast("long"))
    points = F.when(F.col("l_returnflag") == "A", 9).when(F.col("l_returnflag") == "N", 8).when(F.col("l_returnflag") == "R", 7)
    out = agg.weighted_mean_running(grades, "o_custkey", "term", points, F.col("l_quantity"))
    return out.select("o_custkey", "term", F.round("term_mean", 9).alias("term_mean"), F.round("running_mean", 9).alias("running_mean"))


def _genes(t):
    return t("lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("ref"), F.col("l_partkey").alias("patient"), (F.col("l_quantity") - 25).alias("value"))


for _mode, _test in (("up", "{} >= 10"), ("down", "{} <= 10"), ("abs", "abs({}) >= 10")):

    def _by_individual(t, mode=_mode):
        return agg.genes_by_individual(_genes(t), "R", mode, 10)

    _by_individual.__name__ = f"gene_by_individual_{_mode}"
    query(f"SELECT l_suppkey AS gene, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND {_test.format('(l_quantity - 25)')} GROUP BY 1")(_by_individual)


@query("SELECT gene, sum((m >= 10)::INT)::BIGINT AS n FROM (SELECT l_suppkey AS gene, l_partkey, avg(l_quantity - 25) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY gene")
def gene_by_average(t):
    return agg.genes_by_average(_genes(t), "R", "up", 10)


@query("""WITH m AS (SELECT event_type, hour(ts) AS h, avg(value) AS v FROM events GROUP BY ALL), g AS (SELECT event_type, h, v, sum(v) OVER (PARTITION BY event_type) AS s, count(*) FILTER (v > 0) OVER (PARTITION BY event_type) AS n FROM m)
SELECT event_type, h::INT AS hour, round(v / s, 9) AS part FROM g WHERE n = 24""")
def hour_features(t):
    out = agg.hour_features(t("events"), "event_type", "ts", "value")
    return out.select("event_type", F.posexplode("features").alias("hour", "part")).withColumn("part", F.round("part", 9))


@query("SELECT avg((CASE WHEN l_quantity > 25 THEN 'N' ELSE 'R' END = l_returnflag)::INT::DOUBLE) AS accuracy, count(*) AS n FROM lineitem")
def accuracy(t):
    guess = F.when(F.col("l_quantity") > 25, "N").otherwise("R")
    return agg.accuracy(t("lineitem").withColumn("guess", guess), "guess", "l_returnflag")


@query("SELECT round(avg(pow(l_quantity * 1500 - l_extendedprice, 2)), 0) AS mse FROM lineitem")
def mean_squared_error(t):
    return agg.mean_squared_error(t("lineitem").withColumn("guess", F.col("l_quantity") * 1500), "guess", "l_extendedprice").select(F.round("mse", 0).alias("mse"))


@query(f"SELECT o_custkey, string_agg({_DAY.format('o_orderdate')} || ':' || o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS series FROM orders GROUP BY o_custkey")
def secondary_sort_orders(t):
    out = order.secondary_sort(t("orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return out.select("o_custkey", F.array_join(F.transform("series", lambda s: F.concat_ws(":", day(s["o_orderdate"]), s["o_orderkey"])), ",").alias("series"))


@query(f"SELECT o_custkey, string_agg({_DAY.format('o_orderdate')} || ':' || o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS series FROM orders GROUP BY o_custkey")
def secondary_sort_descending(t):
    out = order.secondary_sort(t("orders"), "o_custkey", "o_orderdate", "o_orderkey", ascending=False)
    return out.select("o_custkey", F.array_join(F.transform("series", lambda s: F.concat_ws(":", day(s["o_orderdate"]), s["o_orderkey"])), ",").alias("series"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place, 1::BIGINT AS partitions FROM orders")
def sort_in_partitions(t):
    """Places are those in which the rows lie, not computed from the order; all rows of a key lie in one partition."""
    lying = order.sort_in_partitions(t("orders"), "o_custkey", F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    lying = materialize(lying, "sorted")
    first = lying.groupBy("o_custkey").agg(F.min("at").alias("first"), F.countDistinct("p").alias("partitions"))
    return lying.join(first, "o_custkey").select("o_custkey", "o_orderkey", (F.col("at") - F.col("first")).alias("place"), "partitions")


_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey{})"


@query(f"SELECT o_orderkey, round(avg(o_totalprice) {_W.format(' ROWS 2 PRECEDING')}, 6) AS moving_avg FROM orders")
def moving_avg_orders(t):
    return order.moving_average(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 3).select("o_orderkey", F.round("moving_avg", 6).alias("moving_avg"))


@query(f"SELECT o_orderkey, round(avg(o_totalprice) {_W.format(' ROWS 2 PRECEDING')}, 6) AS moving_avg FROM orders QUALIFY row_number() {_W.format('')} >= 3")
def moving_avg_full_windows(t):
    return order.moving_average(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 3, 3).select("o_orderkey", F.round("moving_avg", 6).alias("moving_avg"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n_unique(t):
    return order.top_n(t("orders"), 10, "o_totalprice", "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT l_partkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_partkey ORDER BY l_quantity DESC, l_partkey LIMIT 10")
def top_n_parts(t):
    return order.top_n_by_key(t("lineitem"), 10, "l_quantity", "l_partkey")


@query("SELECT l_quantity, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_quantity ORDER BY l_quantity DESC LIMIT 10")
def top_n_distinct(t):
    return order.top_n_distinct(t("lineitem"), 10, "l_quantity", "l_partkey").select("l_quantity", "l_partkey")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def bottom_k(t):
    return order.top_n(t("orders"), 10, "o_totalprice", "o_orderkey", ascending=True).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT p_brand, p_partkey, q, rank FROM (SELECT p_brand, p_partkey, q, row_number() OVER (PARTITION BY p_brand ORDER BY q DESC, p_partkey) AS rank FROM (SELECT p_brand, p_partkey, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE rank <= 3")
def top_n_per_group(t):
    sums = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_partkey").agg(F.sum("l_quantity").alias("q"))
    return order.top_n_per_group(sums, 3, "p_brand", F.desc("q"), "p_partkey").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT 100")
def sample_fixed(t):
    return order.sample_fixed(t("customer"), 100, "c_custkey").select("c_custkey")


_STATES = """WITH l AS (SELECT o_custkey, o_orderkey, o_orderdate, floor(o_totalprice)::BIGINT AS amount, lag(floor(o_totalprice)::BIGINT) OVER w AS prior, datediff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
s AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN days < 30 THEN 'S' WHEN days < 60 THEN 'M' ELSE 'L' END || CASE WHEN prior < 0.9 * amount THEN 'L' WHEN prior < 1.1 * amount THEN 'E' ELSE 'G' END AS state FROM l WHERE prior IS NOT NULL),
b AS (SELECT state AS "from", lead(state) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "to" FROM s),
c AS (SELECT "from", "to", count(*) AS n FROM b WHERE "to" IS NOT NULL GROUP BY ALL)"""


def _states(t):
    amounts = t("orders").withColumn("amount", F.floor("o_totalprice"))
    return order.purchase_states(amounts, "o_custkey", "o_orderdate", "amount", "o_orderkey")


@query(_STATES + " SELECT o_orderkey, state FROM s")
def markov_states(t):
    return _states(t).where("state IS NOT NULL").select("o_orderkey", "state")


@query(_STATES + ' SELECT "from", "to", n FROM c')
def markov_counts(t):
    return order.state_transitions(_states(t), "o_custkey", "o_orderdate", "o_orderkey")


@query(_STATES + """, g AS (SELECT a || b AS st FROM (VALUES ('S'), ('M'), ('L')) x(a), (VALUES ('L'), ('E'), ('G')) y(b)),
f AS (SELECT p.st AS "from", q.st AS "to", coalesce(n, 0) AS n FROM g p CROSS JOIN g q LEFT JOIN c ON c."from" = p.st AND c."to" = q.st),
a AS (SELECT "from", "to", n + CASE WHEN min(n) OVER (PARTITION BY "from") = 0 THEN 1 ELSE 0 END AS n FROM f)
SELECT "from", "to", round(n / sum(n) OVER (PARTITION BY "from"), 9) AS p FROM a""")
def markov_matrix(t):
    counts = order.state_transitions(_states(t), "o_custkey", "o_orderdate", "o_orderkey")
    return order.transition_matrix(counts).withColumn("p", F.round("p", 9))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice) DESC, p_partkey) AS rank FROM part")
def positional_rank(t):
    return order.positional_rank(t("part"), "p_brand", F.abs("p_retailprice").desc(), F.col("p_partkey")).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return t("nation").select(F.col("n_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(t):
    return t("lineitem").select("l_partkey", "l_suppkey").distinct()


_ARRAYS = "WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT l_linestatus || l_returnflag)) AS a, list_sort(list(DISTINCT l_returnflag || 'X')) || ['NO'] AS b, list_sort(list(DISTINCT l_linestatus || 'A')) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"


@query(_ARRAYS + " SELECT o_custkey, array_to_string(list_sort(list_intersect(a, c)), ',') AS both, array_to_string(list_filter(a, lambda x: NOT list_contains(c, x)), ',') AS only_a FROM o")
def array_set_operations(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.concat("l_linestatus", "l_returnflag"))).alias("a"), F.array_sort(F.collect_set(F.concat("l_linestatus", F.lit("A")))).alias("c"))
    return sets.select("o_custkey", F.array_join(F.array_sort(F.array_intersect("a", "c")), ",").alias("both"), F.array_join(F.array_except("a", "c"), ",").alias("only_a"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events WHERE value > 10 GROUP BY event_type")
def json_fields(t):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t("events").where("value > 10").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_extension(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window_extension(t):
    return windowed_counts(t("events"), "ts", "event_type", "1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_window_extension(t):
    return sessions(t("events"), "ts", "user_id", "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_HASH = "list_reduce(list_prepend(1125899906842597::HUGEINT, list_transform(regexp_extract_all(p_name, '(?s).'), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616)"


@query(f"SELECT p_partkey, h, abs(h % 10) AS bucket FROM (SELECT p_partkey, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS h FROM (SELECT p_partkey, {_HASH} AS u FROM part))")
def hash_partition(t):
    return t("part").select("p_partkey", fn.polynomial_hash("p_name").alias("h")).withColumn("bucket", fn.bucket(F.col("h"), 10))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"SELECT o_orderkey, (CASE WHEN list_contains({_PRIORITIES}, o_orderpriority) THEN list_position({_PRIORITIES}, o_orderpriority) - 1 END)::BIGINT AS code FROM orders")
def category_codes(t):
    return t("orders").select("o_orderkey", fn.category_code("o_orderpriority", _PRIORITIES).cast("long").alias("code"))


_RANGE = "SELECT c_name, c_mktsegment FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 5000"


@query(_RANGE)
def sql_range_filter(t):
    return sources.sql(_RANGE.replace("FROM customer", "FROM {customer}"), customer=t("customer"))


_LOCATIONS = "SELECT o_orderpriority, count(DISTINCT c_nationkey) AS locations FROM orders LEFT OUTER JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority"


@query(_LOCATIONS)
def sql_left_outer_join(t):
    return sources.sql(_LOCATIONS.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}"), orders=t("orders"), customer=t("customer"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sql_nested_field(t):
    return sources.sql("SELECT event_id, p.k FROM (SELECT event_id, from_json(props, 'k BIGINT') AS p FROM {events})", events=t("events"))


@query("SELECT p_partkey, (CASE WHEN k > p_size THEN 0 ELSE round(exp(lgamma(p_size + 1) - lgamma(k + 1) - lgamma(p_size - k + 1))) END)::BIGINT AS ways FROM (SELECT p_partkey, p_size, p_partkey % 6 AS k FROM part)")
def binomials(t):
    return t("part").select("p_partkey", fn.choose(F.col("p_size"), (F.col("p_partkey") % 6).cast("int")).cast("long").alias("ways"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x, i: i <> p_partkey % 3 + 1), ' ') AS rest FROM part")
def all_but_one(t):
    return t("part").select("p_partkey", F.array_join(fn.without_index(F.split("p_name", " "), (F.col("p_partkey") % 3).cast("int")), " ").alias("rest"))
