"""Similarity of vectors as expressions on array columns; sums are in double. No Python runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def inner_product(a: Column, b: Column) -> Column:
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(inner_product(a, b) / size)


def l2_distance(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))))


METRICS = {"cosine": (cosine_similarity, False), "l2": (l2_distance, True), "inner_product": (inner_product, False)}


def nearest(vectors: DataFrame, probe: list[float], k: int, metric: str = "cosine", column: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k rows nearest to one given vector, after an optional filter; ties by key. Sorts only k rows a task."""
    measure, ascending = METRICS[metric]
    rows = vectors if where is None else vectors.filter(where)
    scored = rows.withColumn("score", measure(F.col(column), F.array(*[F.lit(float(x)) for x in probe])))
    order = F.col("score").asc_nulls_last() if ascending else F.col("score").desc_nulls_last()
    return scored.orderBy(order, key).limit(k)


def hash_planes(column: Column, bits: int, dimensions: int, seed: int = 5) -> Column:
    """A code of the sides of ``bits`` random planes that a vector lies on, for approximate search by buckets."""
    import random

    draw = random.Random(seed)
    code = F.lit(0)
    for i in range(bits):
        plane = F.array(*[F.lit(draw.gauss(0, 1)) for _ in range(dimensions)])
        code = code + F.when(inner_product(column, plane) >= 0, 1 << i).otherwise(0)
    return code


def hashed_nearest(vectors: DataFrame, probes: list[tuple[int, list[float]]], k: int, tables: int = 4, planes: int = 6, flips: int = 2) -> DataFrame:
    """(probe, vec_id, score): for each (id, vector) of ``probes`` the k rows of the highest cosine among those that lie,
    in one of ``tables`` sets of planes at least, in the probe's bucket or at most ``flips`` planes away; without the probe itself."""
    spark, size = vectors.sparkSession, len(probes[0][1])

    def codes() -> Column:
        return F.array(*[hash_planes(F.col("embedding"), planes, size, 5 + t) for t in range(tables)])

    given = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in probes], "probe long, embedding array<double>")
    wanted = F.broadcast(given.select("probe", F.col("embedding").alias("wanted"), codes().alias("at")))
    near = F.exists(F.zip_with("codes", "at", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= flips), lambda x: x)
    held = vectors.select("vec_id", "embedding", codes().alias("codes"))
    close = held.join(wanted, near & (F.col("vec_id") != F.col("probe")))
    scored = close.select("probe", "vec_id", cosine_similarity(F.col("embedding"), F.col("wanted")).alias("score"))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc_nulls_last("score"), "vec_id"))
    return scored.withColumn("rn", place).filter(F.col("rn") <= k).select("probe", "vec_id", "score")
