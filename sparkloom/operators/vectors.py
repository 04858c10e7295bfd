"""Vector search by exact distances: one probe, a filtered one, and many probes in blocks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.operators.joins import broadcast_if_small
from sparkloom.operators.registry import query, table
from sparkloom.session import scratch_dir
from sparkloom.sources.vector_index import VectorIndex

_DOT = "list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_COS = f"{_DOT} / ({_NORM.format('e')} * {_NORM.format('p')})"
_L2 = "sqrt(list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2))))"


def _sql(score: str, order: str, where: str = "") -> str:
    return f"SELECT e.vec_id, round({score}, 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) p WHERE e.vec_id <> 7 {where} ORDER BY {score} {order}, e.vec_id LIMIT 10"


def _probe(rows):
    """One vector, by its id."""
    return rows.filter("vec_id = 7").select("embedding").first()[0]


def _nearest(spark, sf, metric, where=None):
    rows = table(spark, sf, "embeddings")
    keep = F.col("vec_id") != 7
    return V.nearest(rows, _probe(rows), 10, metric, where=keep if where is None else keep & where).select("vec_id", F.round("score", 5).alias("score"))


@query(_sql(_COS, "DESC"))
def vec_cosine_topk(spark, sf):
    return _nearest(spark, sf, "cosine")


@query(_sql(_L2, "ASC"))
def vec_l2_topk(spark, sf):
    return _nearest(spark, sf, "l2")


@query(_sql(_DOT, "DESC"))
def vec_inner_product(spark, sf):
    return _nearest(spark, sf, "inner_product")


@query(_sql(_COS, "DESC", "AND e.label = 3"))
def vec_filtered_topk(spark, sf):
    return _nearest(spark, sf, "cosine", F.col("label") == 3)


@query(f"SELECT probe, vec_id, CAST(rn AS BIGINT) AS rn FROM (SELECT p.vec_id AS probe, e.vec_id, row_number() OVER (PARTITION BY p.vec_id ORDER BY round({_COS}, 6) DESC, e.vec_id) AS rn FROM embeddings e JOIN embeddings p ON p.vec_id < 8 AND e.vec_id <> p.vec_id) WHERE rn <= 3")
def vec_batch_topk(spark, sf):
    """A fixed list of eight probes against all rows; each task keeps three rows a probe before the shuffle."""
    rows = table(spark, sf, "embeddings")
    probes = broadcast_if_small(rows.filter("vec_id < 8").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("wanted")))
    scored = rows.join(probes, F.col("vec_id") != F.col("probe")).withColumn("score", F.round(V.cosine_similarity(F.col("embedding"), F.col("wanted")), 6))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rn", place.cast("long")).filter("rn <= 3").select("probe", "vec_id", "rn")


@query("SELECT k, CASE WHEN d = 0 THEN 0.0 ELSE round(n / d, 6) END AS cosine FROM (SELECT k, list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) AS n, sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))) AS d FROM (VALUES (1, [1.0::DOUBLE, 0.0], [1.0::DOUBLE, 1.0]), (2, [0.0::DOUBLE, 0.0], [1.0::DOUBLE, 2.0])) t(k, a, b))")
def vec_similarity_zero_norm(spark, sf):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 0.0], [1.0, 2.0])], "k int, a array<double>, b array<double>")
    return rows.select("k", F.round(V.cosine_similarity(F.col("a"), F.col("b")), 6).alias("cosine"))


def _recall(rows, probes, found):
    """Of the probes' ten nearest rows by brute force the share that was found, in one row."""
    asked = rows.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in probes], "probe long, wanted array<double>")
    scored = rows.join(F.broadcast(asked), F.col("vec_id") != F.col("probe")).withColumn("score", V.cosine_similarity(F.col("embedding"), F.col("wanted")))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    exact = scored.withColumn("rn", place).filter("rn <= 10").select("probe", "vec_id")
    hit = exact.join(found.select("probe", "vec_id", F.lit(1).alias("hit")), ["probe", "vec_id"], "left")
    return hit.agg(F.count("*").alias("wanted"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


_PROBED = "SELECT CAST(8 * least(10, (SELECT count(*) FROM embeddings) - 1) AS BIGINT) AS wanted, TRUE AS enough"


@query(_PROBED)
def vec_index(spark, sf):
    """An index built from all rows, kept, loaded and asked for eight probes: whether nine in ten of their ten nearest
    rows were found."""
    rows = table(spark, sf, "embeddings")
    path = scratch_dir(spark)
    VectorIndex.build(rows, path)
    probes = [(r["vec_id"], r["embedding"]) for r in rows.filter("vec_id < 8").collect()]
    return _recall(rows, probes, VectorIndex.load(spark, path).search(probes, 10))


@query(_PROBED)
def vec_hashed_buckets(spark, sf):
    """Approximate search for eight probes: rows at most two of 6 planes from the probe in one of 4 tables of planes;
    whether nine in ten of their ten nearest rows were found."""
    rows = table(spark, sf, "embeddings")
    probes = [(r["vec_id"], r["embedding"]) for r in rows.filter("vec_id < 8").collect()]
    return _recall(rows, probes, V.hashed_nearest(rows, probes, 10))
