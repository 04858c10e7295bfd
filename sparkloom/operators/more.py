"""Queries over ingestion, governance, results and event windows: the operators of the other modules at work."""

from pyspark.sql import functions as F

from sparkloom.operators.registry import query, table
from sparkloom.plans.governance import FilterRule, JoinRule, World
from sparkloom.plans.intent import Filter, Intent, Metric, answer
from sparkloom.sources import connectors, ingest, results
from sparkloom.sources.flatten import flatten, merged
from sparkloom.streaming import events as streams


@query("SELECT i AS id, 'user_' || i AS user__name, 'user_' || i || '@example.com' AS user__email, CAST(CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (i % 365) DAY AS DATE) AS VARCHAR) AS metadata__created_at, CAST(1 AS BIGINT) AS metadata__version FROM range(500) t(i)")
def ingest_nested_flatten(spark, sf):
    return flatten(connectors.simulated(spark, "nested", 500), "users")["users"]


@query("SELECT i AS orders_id, CAST(j - 1 AS INTEGER) AS _pos, i * 7 + j AS product_id, 'product_' || j AS product_name, j AS quantity, CAST(round(j * 9.99, 2) AS DOUBLE) AS unit_price FROM range(300) t(i), range(1, 4) u(j) WHERE j <= i % 3 + 1")
def ingest_child_table(spark, sf):
    return flatten(connectors.simulated(spark, "ecommerce", 300), "orders", "order_id")["orders__items"]


@query("SELECT id, CAST(v AS DOUBLE) AS v, w FROM (VALUES (1, 1.0, NULL), (2, 2.0, NULL), (3, 2.5, 'new')) t(id, v, w)")
def ingest_evolution(spark, sf):
    old = spark.createDataFrame([(1, 1), (2, 2)], "id int, v long")
    return merged(old, spark.createDataFrame([(3, 2.5, "new")], "id int, v double, w string")).select(F.col("id").cast("int"), "v", "w")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def ingest_dedupe_latest(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    order = F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k"))
    return ingest.deduplicated(rows, ["o_custkey"], "latest", order).select("o_custkey", "o_orderkey")


def _column_stats(name, kind):
    return f"SELECT '{name}' AS \"column\", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({name}) AS BIGINT) AS nulls, TRUE AS near, CAST(CAST(min({name}) AS {kind}) AS VARCHAR) AS least, CAST(CAST(max({name}) AS {kind}) AS VARCHAR) AS most FROM orders"


@query(" UNION ALL ".join(_column_stats(n, k) for n, k in (("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "VARCHAR"), ("o_orderpriority", "VARCHAR"))))
def stats_table(spark, sf):
    """Statistics of a table's columns in one pass; near: the estimate of distinct values is within 15 percent, three
    times its deviation, of the exact number."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    exact = orders.agg(F.array(*[F.struct(F.lit(c).alias("of"), F.count_distinct(c).alias("n")) for c in orders.columns]).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    found = ingest.statistics(orders).join(F.broadcast(exact), F.col("column") == F.col("of"))
    return found.select("column", "rows", "nulls", (F.abs(F.col("distinct") - F.col("n")) <= 0.15 * F.col("n")).alias("near"), "least", "most")


@query("SELECT CAST(least(20, count(*)) AS BIGINT) AS rows, TRUE AS known, TRUE AS repeats FROM orders")
def result_sample(spark, sf):
    """The size of a sample, whether all its rows are the table's, and whether it comes out the same again."""
    orders = table(spark, sf, "orders")
    one, two = results.sample(orders, 20), results.sample(orders.repartition(3), 20)
    return one.agg(F.count("*").alias("rows")).select("rows", F.lit(one.join(orders, orders.columns, "left_anti").isEmpty()).alias("known"), F.lit(one.exceptAll(two).isEmpty()).alias("repeats"))


@query("SELECT 'count' AS summary, CAST(count(o_totalprice) AS DOUBLE) AS v FROM orders UNION ALL SELECT 'min', min(o_totalprice) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders UNION ALL SELECT 'mean', round(avg(o_totalprice), 4) FROM orders UNION ALL SELECT 'stddev', round(stddev_samp(o_totalprice), 4) FROM orders")
def result_summary(spark, sf):
    found = results.summary(table(spark, sf, "orders").select("o_totalprice")).filter(F.col("summary").isin("count", "mean", "stddev", "min", "max"))
    v = F.col("o_totalprice").cast("double")
    return found.select("summary", F.when(F.col("summary").isin("mean", "stddev"), F.round(v, 4)).otherwise(v).alias("v"))


def _world(frames):
    world = World()
    for name, df in frames.items():
        world.register(name, df)
    world.add_join(JoinRule("orders", "customer", "o_custkey", "c_custkey", state="approved"))
    world.add_join(JoinRule("customer", "nation", "c_nationkey", "n_nationkey", state="approved"))
    world.filters.append(FilterRule("orders", "o_orderstatus", "ne", "P", "pending orders don't count"))
    return world


@query("SELECT n_name, round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= 1000 AND o_orderstatus <> 'P' GROUP BY n_name")
def intent_compiled(spark, sf):
    """An intent over three tables, with a business rule that it doesn't name."""
    frames = {n: table(spark, sf, n) for n in ("orders", "customer", "nation")}
    intent = Intent([Metric("sum", "o_totalprice", "revenue"), Metric("count", None, "n")], ["n_name"], [Filter("o_totalprice", "gte", 1000)])
    return answer(_world(frames), frames, intent).withColumn("revenue", F.round("revenue", 2))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_governed(spark, sf):
    frames = {n: table(spark, sf, n) for n in ("orders", "customer", "nation")}
    return _world(frames).join(frames, "orders", "customer", "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return streams.tumbling(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf):
    return streams.sessions(table(spark, sf, "events"))


@query("SELECT start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS start FROM events) GROUP BY start")
def events_sliding(spark, sf):
    return streams.sliding(table(spark, sf, "events"))
