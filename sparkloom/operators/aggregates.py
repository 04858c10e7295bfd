"""Aggregation: plain, distinct, filtered, over nothing, by sets of keys, and by sketches."""

from pyspark.sql import functions as F

from sparkloom.functions import sketches
from sparkloom.operators.registry import query, table, views
from sparkloom.session import scratch_dir
from sparkloom.sources import ingest
from sparkloom.sources.materialised import Materialised
from sparkloom.sources.store import TableStore


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def agg_global(spark, sf):
    p = "o_totalprice"
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.round(F.sum(p), 2).alias("s"), F.round(F.avg(p), 4).alias("a"), F.min(p).alias("lo"), F.max(p).alias("hi"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_multi(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 6).alias("d"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND max(o_totalprice) > 200000")
def agg_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).filter("n > 10 AND top > 200000").select("o_custkey", "n")


@query("SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT g, CAST(count(*) AS BIGINT) AS n, CAST(count(v) AS BIGINT) AS c, CAST(sum(v) AS BIGINT) AS s, max(v) AS hi, min(v) AS lo, avg(v) AS a FROM (VALUES ('a', 1), ('a', NULL), ('b', NULL), ('b', NULL), (NULL, 3)) t(g, v) GROUP BY g")
def agg_nulls(spark, sf):
    t = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', NULL), ('b', NULL), ('b', NULL), (NULL, 3) AS t(g, v)")
    return t.groupBy("g").agg(F.count("*").alias("n"), F.count("v").alias("c"), F.sum("v").alias("s"), F.max("v").alias("hi"), F.min("v").alias("lo"), F.avg("v").alias("a"))


@query("SELECT CAST(sum(CAST(o_orderkey AS INTEGER)) AS BIGINT) AS s, CAST(sum(CAST(json_extract_string('{\"k\": 3}', '$.k') AS INTEGER)) AS BIGINT) AS k FROM orders")
def agg_cast(spark, sf):
    return table(spark, sf, "orders").agg(F.sum(F.col("o_orderkey").cast("int")).alias("s"), F.sum(F.get_json_object(F.lit('{"k": 3}'), "$.k").cast("int")).alias("k"))


@query("SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(sum(l_quantity) / count(*), 6) AS per FROM lineitem GROUP BY l_linestatus")
def agg_expression(spark, sf):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(charge), 2).alias("charge"), F.round(F.sum("l_quantity") / F.count("*"), 6).alias("per"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0")
def agg_empty_input(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey < 0").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("a"), F.min("o_orderkey").alias("lo"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def agg_group_all(spark, sf):
    views(spark, sf, "orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf):
    views(spark, sf, "orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS big, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS cheap FROM lineitem GROUP BY l_returnflag")
def agg_filtered(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("big"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("cheap"))


@query("SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def agg_topk_frequent(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def agg_count_star(spark, sf):
    """With aggregate pushdown on, this reads row counts from footers alone."""
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS o FROM orders GROUP BY 1")
def agg_pivot(spark, sf):
    """Values of the pivot are given, so no query is run to find them."""
    counted = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate").cast("long")).groupBy("y").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return counted.select("y", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, TRUE AS within FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(spark, sf):
    """Registers for a relative deviation of 2 percent: the exact count, and whether the estimate is within three times that."""
    parts = F.count_distinct("l_partkey")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(parts.alias("parts"), (F.abs(F.approx_count_distinct("l_partkey", 0.02) - parts) <= 0.06 * parts).alias("within"))


@query("SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, TRUE AS within FROM lineitem")
def agg_hll_sketch(spark, sf):
    """Sketches by flag of 2^12 registers, merged over the flags, against the exact count of the union: within 5 percent,
    three times the standard error."""
    items = table(spark, sf, "lineitem")
    per = items.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey", F.lit(12)).alias("sketch"))
    estimate = per.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = items.agg(F.count_distinct("l_partkey").alias("parts"))
    return exact.join(F.broadcast(estimate)).select("parts", (F.abs(F.col("estimate") - F.col("parts")) <= 0.05 * F.col("parts")).alias("within"))


@query("SELECT l_partkey, CAST(count(*) AS BIGINT) AS n, TRUE AS within FROM lineitem GROUP BY l_partkey")
def agg_count_min(spark, sf):
    """Point estimates of a Count-Min sketch: never under the exact count, and over it by a thousandth of all rows at most."""
    items = table(spark, sf, "lineitem")
    sketch = sketches.count_min(items, "l_partkey", 0.001, 0.999)
    exact = items.groupBy("l_partkey").agg(F.count("*").alias("n"))
    found = sketches.estimated(exact, "l_partkey", sketch, 0.001, 0.999).join(F.broadcast(items.agg(F.count("*").alias("rows"))))
    return found.select("l_partkey", "n", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + 0.001 * F.col("rows"))).alias("within"))


@query("SELECT share, TRUE AS within FROM (VALUES (0.25::DOUBLE), (0.5), (0.75)) t(share)")
def agg_approx_percentile(spark, sf):
    """Whether the rank of each approximate percentile is within a hundredth of what is asked for."""
    orders = table(spark, sf, "orders")
    found = ingest.percentiles(orders, "o_totalprice", (0.25, 0.5, 0.75), 1000)
    ranked = orders.select("o_totalprice").join(F.broadcast(found))
    rank = F.avg((F.col("o_totalprice") <= F.col("value")).cast("int"))
    return ranked.groupBy("share").agg((F.abs(rank - F.col("share")) <= 0.01).alias("within"))


@query("SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_bitmap_distinct(spark, sf):
    """Exact distinct whole numbers by bitmaps: a bit for each key, in buckets of 32,768, which are or-ed before they are counted."""
    key = F.col("l_partkey")
    held = table(spark, sf, "lineitem").groupBy("l_returnflag", F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))
    return held.groupBy("l_returnflag").agg(F.sum(F.bitmap_count("bits")).alias("parts"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least FROM orders GROUP BY o_custkey")
def agg_materialised(spark, sf):
    """A group-by kept as a table of partial results: built from one half of the rows, brought up to date with the other."""
    orders = table(spark, sf, "orders")
    kept = Materialised(TableStore(spark, scratch_dir(spark)), "per_customer", ["o_custkey"], {"n": ("count", "o_orderkey"), "total": ("sum", "o_totalprice"), "least": ("min", "o_totalprice")})
    kept.add(orders.filter("o_orderkey % 2 = 0"))
    kept.add(orders.filter("o_orderkey % 2 = 1"))
    return kept.read().withColumn("total", F.round("total", 2))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(o_totalprice) AS BIGINT) AS nulls, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS distinct_priorities, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def stats_columns(spark, sf):
    """What a table's statistics hold, exactly."""
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), (F.count("*") - F.count("o_totalprice")).alias("nulls"), F.count_distinct("o_orderpriority").alias("distinct_priorities"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def stats_histogram(spark, sf):
    return ingest.histogram(table(spark, sf, "orders"), "o_totalprice", 10).select("bin", "n")


@query("SELECT CAST(count(*) AS BIGINT) AS \"values\", CAST(sum(n) AS BIGINT) AS rows, CAST(max(n) AS BIGINT) AS most, round(max(n) * count(*) / sum(n), 6) AS ratio FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)")
def stats_skew(spark, sf):
    return ingest.skew(table(spark, sf, "orders"), "o_custkey").withColumn("ratio", F.round("ratio", 6))
