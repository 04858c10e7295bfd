"""Window functions. Every window is partitioned by a key and ordered to the last tie."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators.registry import query, table

_ORDER = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _line():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query(f"SELECT o_orderkey, CAST(row_number() OVER ({_ORDER}) AS BIGINT) AS rn FROM orders")
def win_row_number(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(_line()).cast("long").alias("rn"))


@query("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part")
def win_rank_dense(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf, "part").select("p_partkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"))


@query("SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS q, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd FROM part")
def win_ntile_percent(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf, "part").select("p_partkey", F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).cast("long").alias("q"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query(f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_running_sum(spark, sf):
    w = _line().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query(f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({_ORDER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS m FROM orders")
def win_moving_avg_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(_line().rowsBetween(-2, 1)), 4).alias("m"))


@query("SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM part")
def win_range_frame(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, Window.currentRow)
    return table(spark, sf, "part").select("p_partkey", F.count("*").over(w).alias("n"))


@query("SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n FROM orders")
def win_min_max_count(spark, sf):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", F.min("o_totalprice").over(w).alias("lo"), F.max("o_totalprice").over(w).alias("hi"), F.count("*").over(w).alias("n"))


@query(f"SELECT o_orderkey, lag(o_totalprice) OVER ({_ORDER}) AS before, lead(o_totalprice, 2, -1.0) OVER ({_ORDER}) AS after FROM orders")
def win_lag_lead(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_totalprice").over(_line()).alias("before"), F.lead("o_totalprice", 2, -1.0).over(_line()).alias("after"))


@query(f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_ORDER}) AS first, last_value(o_orderkey) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders")
def win_first_last(spark, sf):
    whole = _line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "orders").select("o_orderkey", F.first_value("o_orderkey").over(_line()).alias("first"), F.last_value("o_orderkey").over(whole).alias("last"))


@query(f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def win_topk_per_group(spark, sf):
    """The filter on the rank lets Spark keep two rows a key before the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("o_custkey", "o_orderkey")
