"""Scans, projections, filters, sorting, limits and distinct rows."""

from pyspark.sql import functions as F

from sparkloom.operators.registry import query, table, views


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_projection(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, CAST(round(CAST(o_totalprice AS DECIMAL(15, 4)) * CAST(1.1 AS DECIMAL(2, 1)), 2) AS DOUBLE) AS gross, o_orderstatus || '-' || o_orderpriority AS tag FROM orders")
def project_expressions(spark, sf):
    """Money is rounded as a decimal: ties of a double product fall as its last bit does."""
    gross = F.round(F.col("o_totalprice").cast("decimal(15, 4)") * F.lit(1.1).cast("decimal(2, 1)"), 2).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", gross.alias("gross"), F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("tag"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_ne(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_mktsegment") != "BUILDING").select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
def filter_range(spark, sf):
    return table(spark, sf, "orders").filter((F.col("o_totalprice") >= 1000) & (F.col("o_totalprice") < 50000)).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_returnflag = 'N'")
def filter_and(spark, sf):
    return table(spark, sf, "lineitem").filter((F.col("l_quantity") > 30) & (F.col("l_discount") <= 0.05) & (F.col("l_returnflag") == "N")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND (l_quantity < 5 OR (l_quantity > 45 AND NOT l_linestatus = 'O'))")
def filter_or_nested(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").filter((F.col("l_returnflag") == "R") & ((q < 5) | ((q > 45) & ~(F.col("l_linestatus") == "O")))).select("l_orderkey", "l_linenumber")


@query("SELECT x FROM (VALUES (1), (NULL), (3)) t(x) WHERE NOT (x = 1)")
def filter_three_valued(spark, sf):
    return spark.sql("SELECT x FROM (VALUES (1), (CAST(NULL AS INT)), (3)) t(x)").filter(~(F.col("x") == 1))


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'")
def filter_timestamp(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").filter((d >= F.lit("1996-01-01").cast("timestamp")) & (d < F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in(spark, sf):
    return table(spark, sf, "nation").filter(F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 3)")
def filter_not_in(spark, sf):
    return table(spark, sf, "nation").filter(~F.col("n_regionkey").isin(1, 3)).select("n_nationkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_brand LIKE 'Brand#_%'")
def filter_like(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_type").like("%A%") & F.col("p_brand").like("Brand#_%")).select("p_partkey", "p_type")


@query("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%1%'")
def filter_not_like(spark, sf):
    return table(spark, sf, "part").filter(~F.col("p_name").like("%1%")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'")
def filter_ilike(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_mktsegment").ilike("build%")).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[05]$')")
def filter_rlike(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_name").rlike("[05]$")).select("c_custkey", "c_name")


@query("SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
def filter_is_null(spark, sf):
    orders = table(spark, sf, "orders").filter(F.col("o_totalprice") > 300000)
    c = table(spark, sf, "customer")
    return c.join(orders, c["c_custkey"] == orders["o_custkey"], "left").filter(F.col("o_orderkey").isNull()).select("c_custkey")


@query("SELECT k FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) t(k, v) WHERE v IS NOT NULL")
def filter_is_not_null(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL), (3, 'c') AS t(k, v)").filter(F.col("v").isNotNull()).select("k")


@query("SELECT n_name FROM nation WHERE upper(n_name) = n_name AND length(n_name) + n_regionkey > 7")
def filter_expression(spark, sf):
    return table(spark, sf, "nation").filter((F.upper("n_name") == F.col("n_name")) & (F.length("n_name") + F.col("n_regionkey") > 7)).select("n_name")


@query("SELECT c_custkey, c_mktsegment, c_acctbal, rn FROM (SELECT *, CAST(row_number() OVER (ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey ASC) AS BIGINT) AS rn FROM customer) ORDER BY rn LIMIT 100")
def sort_multi(spark, sf):
    """The order is in the result as rn: the rows are those of the first 100 places, each with its place."""
    top = table(spark, sf, "customer").orderBy(F.col("c_mktsegment").asc(), F.col("c_acctbal").desc(), "c_custkey").limit(100)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.col("c_mktsegment").asc(), F.col("c_acctbal").desc(), "c_custkey"))
    return top.select("c_custkey", "c_mktsegment", "c_acctbal", place.cast("long").alias("rn"))


@query("SELECT k, v FROM (VALUES (1, 5), (2, NULL), (3, 1), (4, NULL)) t(k, v) ORDER BY v ASC NULLS FIRST, k LIMIT 3")
def sort_nulls(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, 5), (2, NULL), (3, 1), (4, NULL) AS t(k, v)").orderBy(F.col("v").asc_nulls_first(), "k").limit(3)


@query("SELECT k, v FROM (VALUES (1, 5), (2, NULL), (3, 1), (4, NULL)) t(k, v) ORDER BY v DESC NULLS LAST, k LIMIT 3")
def sort_nulls_last(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, 5), (2, NULL), (3, 1), (4, NULL) AS t(k, v)").orderBy(F.col("v").desc_nulls_last(), "k").limit(3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf):
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").offset(25).limit(10)


@query("SELECT n_regionkey AS r, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1 ORDER BY 2 DESC, r LIMIT 3")
def order_by_alias_position(spark, sf):
    views(spark, sf, "nation")
    return spark.sql("SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1 ORDER BY 2 DESC, r LIMIT 3")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 2")
def distinct_limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").limit(2)


@query("SELECT s_suppkey, n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
def filter_scalar_subquery(spark, sf):
    views(spark, sf, "supplier", "nation")
    return spark.sql("SELECT s_suppkey, n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
