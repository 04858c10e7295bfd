"""Joins of every kind, hints, and subqueries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.registry import query, table, views

#: Largest estimated side, in bytes, that is broadcast on request; beyond it the plan is left to the optimizer.
BROADCAST_BYTES = 64 << 20
#: A key is hot from this part of all rows on; places that a hot key's rows are spread over.
HOT, SALTS = 200, 8
_LEFT = "(SELECT * FROM VALUES (1, 'a'), (2, 'b'), (2, 'c'), (NULL, 'd') AS l(k, v))"
_RIGHT = "(SELECT * FROM VALUES (2, 'x'), (2, 'y'), (3, 'z'), (NULL, 'w') AS r(k, w))"


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, if the optimizer's estimate of the side is within the limit."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def _pairs(spark):
    return spark.sql(f"SELECT * FROM {_LEFT}"), spark.sql(f"SELECT * FROM {_RIGHT}")


def _sql(kind: str) -> str:
    return f"SELECT l.k AS lk, v, r.k AS rk, w FROM (VALUES (1, 'a'), (2, 'b'), (2, 'c'), (NULL, 'd')) l(k, v) {kind} JOIN (VALUES (2, 'x'), (2, 'y'), (3, 'z'), (NULL, 'w')) r(k, w) ON l.k = r.k"


def _join(spark, kind):
    left, right = _pairs(spark)
    return left.join(right, left["k"] == right["k"], kind).select(left["k"].alias("lk"), "v", right["k"].alias("rk"), "w")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey")
def join_left(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 250000").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_regionkey < 3) FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 8) ON n_nationkey = s_nationkey")
def join_full(spark, sf):
    return table(spark, sf, "nation").filter("n_regionkey < 3").join(table(spark, sf, "supplier").filter("s_nationkey > 8"), F.col("n_nationkey") == F.col("s_nationkey"), "full").select("n_name", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_semi(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN (SELECT * FROM nation WHERE n_nationkey < 4)")
def join_cross(spark, sf):
    """Five regions with four nations: both sides are fixed lists."""
    return table(spark, sf, "region").crossJoin(table(spark, sf, "nation").filter("n_nationkey < 4")).select("r_name", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, sf):
    a, b = table(spark, sf, "nation").alias("a"), table(spark, sf, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40) USING (l_orderkey, l_linenumber) GROUP BY ALL")
def join_using_multi(spark, sf):
    items = table(spark, sf, "lineitem")
    return items.join(items.filter("l_quantity > 40").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity > 48")
def join_multi_condition(spark, sf):
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("l_quantity") > 48)
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), on).select("o_orderkey", "l_linenumber")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_suppkey < 20")
def join_theta(spark, sf):
    """An inequality has no key to deal by; suppliers are few, and the filtered side is the smaller one."""
    a, b = table(spark, sf, "supplier").filter("s_suppkey < 20").alias("a"), table(spark, sf, "supplier").alias("b")
    return a.join(b, F.col("a.s_acctbal") < F.col("b.s_acctbal")).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("SELECT r_name, c_mktsegment, round(sum(l_extendedprice), 2) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment")
def join_star_5way(spark, sf):
    t = lambda n: table(spark, sf, n)
    star = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    star = star.join(broadcast_if_small(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(broadcast_if_small(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return star.groupBy("r_name", "c_mktsegment").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark, sf):
    return table(spark, sf, "customer").join(broadcast_if_small(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_merge_hint(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def join_hash_hint(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "supplier").hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("SELECT p_brand, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def join_salted(spark, sf):
    """A join whose hot keys are spread: of keys with more than a part in HOT of all rows, at most HOT, the large side's
    rows go to SALTS places, and the other side's are there once each; all other keys are joined as they are."""
    items, parts = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber"), table(spark, sf, "part").select("p_partkey", "p_brand")
    least = items.count() // HOT
    hot = F.broadcast(items.groupBy(F.col("l_partkey").alias("hot_key")).agg(F.count("*").alias("n")).filter(F.col("n") > least).select("hot_key"))
    salt = F.when(F.col("hot_key").isNull(), 0).otherwise(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(SALTS))).cast("int")
    salts = F.when(F.col("hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = items.join(hot, F.col("l_partkey") == F.col("hot_key"), "left").select("l_partkey", "l_quantity", salt.alias("salt"))
    copied = parts.join(hot, F.col("p_partkey") == F.col("hot_key"), "left").select("p_partkey", "p_brand", F.explode(salts).alias("part_salt"))
    joined = spread.join(copied, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("salt") == F.col("part_salt")))
    return joined.groupBy("p_brand").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("""WITH bought AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40),
ps AS (SELECT DISTINCT p, s FROM bought), sc AS (SELECT DISTINCT s, c FROM bought), cp AS (SELECT DISTINCT c, p FROM bought)
SELECT ps.s AS s, CAST(count(*) AS BIGINT) AS n FROM ps JOIN sc ON ps.s = sc.s JOIN cp ON cp.c = sc.c AND cp.p = ps.p GROUP BY ps.s""")
def join_triangle(spark, sf):
    """A cyclic join: part and supplier, supplier and customer, customer and part. The two edges of a part that are few
    for each part meet first, and the third edge is a semi-join on both its ends, so no two-edge path is widened by it."""
    items = table(spark, sf, "lineitem").filter("l_quantity > 40").select("l_orderkey", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    bought = items.join(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c")), F.col("l_orderkey") == F.col("o_orderkey"))
    edge = lambda *ends: bought.select(*ends).distinct()
    closed = edge("p", "s").join(edge("c", "p"), "p").join(edge("s", "c"), ["s", "c"], "left_semi")
    return closed.groupBy("s").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY c_mktsegment")
def join_bloom(spark, sf):
    """A selective small side behind two shuffled joins: where the sides are large, a Bloom filter of its keys runs over
    the large scan before it is shuffled (a setting of the session; a test shows the plan)."""
    t = lambda n: table(spark, sf, n)
    rich = t("customer").filter("c_acctbal > 9000")
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(rich, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(_sql(""))
def join_null_keys(spark, sf):
    return _join(spark, "inner")


@query(_sql("LEFT"))
def join_null_keys_left(spark, sf):
    return _join(spark, "left")


@query(_sql("FULL"))
def join_null_keys_full(spark, sf):
    return _join(spark, "full")


@query("SELECT l.v, r.w FROM (VALUES (1, 'a'), (2, 'b'), (2, 'c'), (NULL, 'd')) l(k, v) JOIN (VALUES (2, 'x'), (2, 'y'), (3, 'z'), (NULL, 'w')) r(k, w) ON l.k IS NOT DISTINCT FROM r.k")
def join_null_safe(spark, sf):
    left, right = _pairs(spark)
    return left.join(right, left["k"].eqNullSafe(right["k"])).select("v", "w")


def _text(name: str, sql: str, *tables: str) -> None:
    """Registers a query that is the same text in both engines."""

    def run(spark, sf):
        views(spark, sf, *tables)
        return spark.sql(sql)

    run.__name__ = name
    query(sql)(run)


_text("cte_chain", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM big GROUP BY o_custkey) SELECT c_name, n, top FROM per JOIN customer ON o_custkey = c_custkey WHERE n > 1", "orders", "customer")
_text("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 8) SELECT n, f FROM t")
_text("derived_table", "SELECT s.n_regionkey, s.total FROM (SELECT n_regionkey, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey) s JOIN (SELECT r_regionkey FROM region WHERE r_regionkey > 0) r ON s.n_regionkey = r.r_regionkey", "customer", "nation", "region")
_text("subq_scalar_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.2 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "orders")
_text("subq_scalar_projection", "SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation", "nation", "supplier")
_text("subq_exists", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)", "part", "lineitem")
_text("subq_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)", "part", "lineitem")
_text("subq_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "customer", "nation")
_text("subq_not_in", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "customer", "nation")
_text("subq_case_exists", "SELECT n_nationkey, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'yes' ELSE 'no' END AS has FROM nation", "nation", "supplier")
_text("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", "nation", "region")
_text("join_natural", "SELECT k, v, w FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders) a NATURAL JOIN (SELECT o_orderkey AS k, o_orderpriority AS w FROM orders WHERE o_totalprice > 100000) b", "orders")
