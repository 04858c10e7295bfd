"""End-to-end queries over the star schema."""

from pyspark.sql import functions as F

from sparkloom.operators.registry import query, table

_DAY = "TIMESTAMP '{0} 00:00:00'"


def _ts(day: str):
    return F.lit(day).cast("timestamp")


@query(f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS count_order
FROM lineitem WHERE l_shipdate <= {_DAY.format('1998-09-02')} GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
def q1_pricing_summary(spark, sf):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    items = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= _ts("1998-09-02"))
    return (
        items.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(disc), 2).alias("sum_disc_price"),
            F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query(f"""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < {_DAY.format('1998-03-15')} AND l_shipdate > {_DAY.format('1998-03-15')}
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def q3_shipping_priority(spark, sf):
    customers = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf, "orders").filter(F.col("o_orderdate") < _ts("1998-03-15"))
    items = table(spark, sf, "lineitem").filter(F.col("l_shipdate") > _ts("1998-03-15"))
    joined = items.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("l_orderkey", "o_orderdate").agg(revenue.alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query(f"SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= {_DAY.format('1997-01-01')} AND l_shipdate < {_DAY.format('1998-01-01')} AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6_forecast_revenue(spark, sf):
    d = F.col("l_shipdate")
    items = table(spark, sf, "lineitem").filter((d >= _ts("1997-01-01")) & (d < _ts("1998-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return items.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("""WITH spent AS (SELECT o_custkey, c_nationkey, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_nationkey)
SELECT s.o_custkey FROM spent s WHERE s.total > (SELECT avg(i.total) * 1.2 FROM spent i WHERE i.c_nationkey = s.c_nationkey)""")
def ctds_style_above_avg(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spent = joined.groupBy("o_custkey", "c_nationkey").agg(F.sum("o_totalprice").alias("total"))
    limits = spent.groupBy(F.col("c_nationkey").alias("nation")).agg((F.avg("total") * 1.2).alias("bar"))
    return spent.join(limits, F.col("c_nationkey") == F.col("nation")).filter(F.col("total") > F.col("bar")).select("o_custkey")


@query("SELECT CAST(year(l_shipdate) AS BIGINT) AS y, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def revenue_by_nation_year(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.year("l_shipdate").cast("long").alias("y"), "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
