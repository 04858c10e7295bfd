"""Set operations, with and without duplicates."""

from pyspark.sql import functions as F

from sparkloom.operators.registry import query, table, views


def _keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))


def _sql(op: str) -> str:
    return f"SELECT c_nationkey AS k FROM customer {op} SELECT s_nationkey AS k FROM supplier"


@query(_sql("UNION"))
def set_union(spark, sf):
    a, b = _keys(spark, sf)
    return a.union(b).distinct()


@query(_sql("UNION ALL"))
def set_union_all(spark, sf):
    a, b = _keys(spark, sf)
    return a.union(b)


@query(_sql("INTERSECT"))
def set_intersect(spark, sf):
    a, b = _keys(spark, sf)
    return a.intersect(b)


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_suppkey < 9")
def set_except(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf, "supplier").filter("s_suppkey < 9").select(F.col("s_nationkey").alias("k")))


@query(_sql("INTERSECT ALL"))
def set_intersect_all(spark, sf):
    a, b = _keys(spark, sf)
    return a.intersectAll(b)


@query(_sql("EXCEPT ALL"))
def set_except_all(spark, sf):
    a, b = _keys(spark, sf)
    return a.exceptAll(b)


_NESTED = "(SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 2) EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey > 15 ORDER BY k LIMIT 5"


@query(_NESTED)
def set_nested(spark, sf):
    views(spark, sf, "nation")
    return spark.sql(_NESTED)


@query("SELECT v FROM (VALUES (1), (NULL), (NULL)) t(v) UNION SELECT v FROM (VALUES (NULL), (2)) u(v)")
def set_union_nulls(spark, sf):
    return spark.sql("SELECT v FROM VALUES (1), (NULL), (NULL) AS t(v) UNION SELECT v FROM VALUES (NULL), (2) AS u(v)")
