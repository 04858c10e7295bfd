"""Scalar functions, conditions and casts."""

from pyspark.sql import functions as F

from sparkloom.functions.scalars import call
from sparkloom.operators.registry import query, table


@query("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, trim('  ' || c_name || ' ') AS t, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt FROM customer")
def str_case_trim(spark, sf):
    name, two = F.col("c_name"), F.lit("  ")
    return table(spark, sf, "customer").select("c_custkey", call("ucase", name).alias("u"), call("lower", F.col("c_mktsegment")).alias("l"), call("trim", F.concat(two, name, F.lit(" "))).alias("t"), call("ltrim", F.concat(two, name)).alias("lt"), call("rtrim", F.concat(name, two)).alias("rt"))


@query("SELECT p_partkey, p_brand || '/' || p_type AS b, replace(p_brand, 'Brand', 'B') AS r FROM part")
def str_concat_replace(spark, sf):
    return table(spark, sf, "part").select("p_partkey", call("concat", F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("b"), call("replace", F.col("p_brand"), F.lit("Brand"), F.lit("B")).alias("r"))


@query("SELECT k, 'x' || v AS joined FROM (VALUES (1, 'a'), (2, NULL)) t(k, v)")
def str_concat_null(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL) AS t(k, v)").select("k", call("concat", F.lit("x"), F.col("v")).alias("joined"))


@query("SELECT p_partkey, substring(p_type, 2, 4) AS s, substring(p_type, 3) AS rest, CAST(length(p_type) AS BIGINT) AS n, CAST(strlen('é' || p_type) AS BIGINT) AS bytes FROM part")
def str_substring_length(spark, sf):
    t = F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", call("substr", t, F.lit(2), F.lit(4)).alias("s"), call("substring", t, F.lit(3)).alias("rest"), call("len", t).cast("long").alias("n"), call("octet_length", F.concat(F.lit("é"), t)).cast("long").alias("bytes"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r1, round(c_acctbal) AS r0 FROM customer")
def math_abs_round(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", call("abs", x).alias("a"), call("round", x, 1).alias("r1"), call("round", x).alias("r0"))


@query("SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c FROM customer")
def math_floor_ceil(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", call("floor", x).alias("f"), call("ceiling", x).alias("c"))


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, pow(CAST(p_size AS DOUBLE), 2) AS p, p_partkey % 7 AS m, -7 % 3 AS neg, -p_size AS minus FROM part")
def math_sqrt_pow_mod(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(call("sqrt", F.col("p_retailprice")), 6).alias("s"), call("pow", F.col("p_size").cast("double"), F.lit(2.0)).alias("p"), call("mod", F.col("p_partkey"), F.lit(7)).alias("m"), (F.lit(-7) % 3).alias("neg"), (-F.col("p_size")).alias("minus"))


@query("SELECT p_partkey, round(p_retailprice + p_size, 4) AS a, round(p_retailprice - p_size, 4) AS s, round(p_retailprice * p_size, 4) AS m, round(p_retailprice / p_size, 4) AS d, round(p_size / 4, 4) AS half FROM part WHERE p_size > 0")
def math_arithmetic(spark, sf):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").filter(size > 0).select("p_partkey", F.round(price + size, 4).alias("a"), F.round(price - size, 4).alias("s"), F.round(price * size, 4).alias("m"), F.round(price / size, 4).alias("d"), F.round(size / 4, 4).alias("half"))


@query("SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, ~p_size AS n FROM part")
def bitwise_ops(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", call("bitwise_and", s, F.lit(12)).alias("a"), call("bitwise_or", s, F.lit(3)).alias("o"), call("bitwise_xor", s, F.lit(5)).alias("x"), call("bitwise_not", s).alias("n"))


@query("SELECT k, coalesce(a, b, 0) AS c, nullif(a, b) AS n, ifnull(a, -1) AS i FROM (VALUES (1, 5, 5), (2, NULL, 4), (3, 7, NULL), (4, NULL, NULL)) t(k, a, b)")
def cond_coalesce_nullif(spark, sf):
    t = spark.sql("SELECT * FROM VALUES (1, 5, 5), (2, NULL, 4), (3, 7, NULL), (4, NULL, NULL) AS t(k, a, b)")
    a, b = F.col("a"), F.col("b")
    return t.select("k", call("coalesce", a, b, F.lit(0)).alias("c"), call("nullif", a, b).alias("n"), call("isnull", a, F.lit(-1)).alias("i"))


@query("SELECT k, greatest(a, b) AS g, least(a, b) AS l FROM (VALUES (1, 5, 9), (2, NULL, 4), (3, 7, NULL)) t(k, a, b)")
def cond_greatest_least(spark, sf):
    t = spark.sql("SELECT * FROM VALUES (1, 5, 9), (2, NULL, 4), (3, 7, NULL) AS t(k, a, b)")
    return t.select("k", call("greatest", F.col("a"), F.col("b")).alias("g"), call("least", F.col("a"), F.col("b")).alias("l"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders")
def case_simple(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", F.when(s == "F", "final").when(s == "O", "open").otherwise("other").alias("s"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS band FROM orders")
def case_searched(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.when(p > 200000, "high").when(p > 50000, "mid").alias("band"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST('12' AS INTEGER) AS i, CAST('2.5' AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS DOUBLE) AS f, CAST(1 AS BOOLEAN) AS b FROM orders")
def cast_types(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("s"), F.lit("12").cast("int").alias("i"), F.lit("2.5").cast("double").alias("d"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").cast("double").alias("f"), F.lit(1).cast("boolean").alias("b"))


@query("SELECT k, TRY_CAST(v AS INTEGER) AS i FROM (VALUES (1, '12'), (2, 'x'), (3, NULL)) t(k, v)")
def try_cast_bad(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, '12'), (2, 'x'), (3, NULL) AS t(k, v)").select("k", F.col("v").try_cast("int").alias("i"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS first FROM orders")
def date_parts(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", *(f(d).cast("long").alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.day, "d"), (F.quarter, "q"))), F.date_trunc("month", d).cast("date").alias("first"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
