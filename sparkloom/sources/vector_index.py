"""An index for nearest neighbours by cosine that is built once, kept as Parquet and asked many times.

Rows lie in lists by their nearest centre; a list is a directory, so a search reads the directories of the probes'
nearest centres only. Centres are fitted on at most SAMPLE rows, those with the smallest hashes of their ids; every row
is indexed. How many lists a search reads is measured when the index is built: as few as give the recall asked for, over
PROBES rows of the sample against brute force within it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.vectors import cosine_similarity

SAMPLE, PROBES, ROUNDS, LIST_ROWS, MOST_PROBES = 16_384, 128, 8, 1_000_000, 10_000


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def _centres(rows: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centres of spherical k-means, from rows drawn by seed."""
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:lists]].copy()
    for _ in range(ROUNDS):
        nearest = (rows @ centres.T).argmax(1)
        for i in range(len(centres)):
            if (own := rows[nearest == i]).size:
                centres[i] = own.sum(0)
        centres = _unit(centres)
    return centres


def _measured(rows: np.ndarray, centres: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """(lists to read, recall) over probes of the sample."""
    probes = rows[:PROBES]
    scores, nearest = probes @ rows.T, (rows @ centres.T).argmax(1)
    scores[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    order = np.argsort(-(probes @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    needed = np.sort(np.take_along_axis(place, nearest[best], 1).ravel())
    reads = 1 + int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1
    return reads, float((needed < reads).mean()) if len(needed) else 1.0


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    reads: int
    recall: float

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, recall: float = 0.95, k: int = 10, seed: int = 3) -> VectorIndex:
        """Of rows (vec_id, embedding) of one size; those without either take no part."""
        rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id is not null and embedding is not null")
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        held = _unit(np.array(sample.column("embedding").to_pylist(), np.float64).reshape(len(sample), -1))
        centres = _centres(held, lists or max(1, int(np.sqrt(len(held)))), seed) if len(held) else np.zeros((1, 0))
        reads, measured = _measured(held, centres, k, recall)
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def assign(batches):
            for batch in batches:
                values = np.asarray(batch.column("embedding").flatten()).reshape(batch.num_rows, -1)
                yield batch.append_column("list", pa.array((_unit(values) @ shared.value.T).argmax(1).astype(np.int32)))

        placed = rows.mapInArrow(assign, "vec_id long, embedding array<double>, list int")
        spread = -(-rows.count() // (LIST_ROWS * len(centres)))  # a list's rows go to so many files at least
        placed.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(max(spread, 1)))).write.partitionBy("list").parquet(f"{path}/lists")
        meta = rows.sparkSession.createDataFrame([(json.dumps({"centres": centres.tolist(), "reads": reads, "recall": measured}),)], "meta string")
        meta.coalesce(1).write.parquet(f"{path}/meta")
        return cls(rows.sparkSession, path, centres, reads, measured)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        return cls(spark, path, np.array(meta["centres"]), meta["reads"], meta["recall"])

    def search(self, probes: list[tuple[int, list[float]]], k: int = 10, reads: int | None = None) -> DataFrame:
        """(probe, vec_id, score): the k rows of the highest cosine in the lists that are read, without the probe's own
        id, ties to the smaller id; for MOST_PROBES (id, vector) at most."""
        if len(probes) > MOST_PROBES:
            raise ValueError(f"more than {MOST_PROBES} probes at a time")
        wanted = np.array([v for _, v in probes], np.float64).reshape(len(probes), -1)
        near = np.argsort(-(_unit(wanted) @ self.centres.T), axis=1, kind="stable")[:, : reads or self.reads]
        asked = self.spark.createDataFrame([(int(c), int(i), [float(x) for x in v]) for (i, v), row in zip(probes, near, strict=True) for c in row], "list int, probe long, wanted array<double>")
        held = self.spark.read.schema("vec_id long, embedding array<double>, list int").parquet(f"{self.path}/lists").filter(F.col("list").isin(sorted({int(c) for c in near.ravel()})))
        met = held.join(F.broadcast(asked), "list").filter(F.col("vec_id") != F.col("probe"))
        scored = met.select("probe", "vec_id", cosine_similarity(F.col("embedding"), F.col("wanted")).alias("score"))
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
        return scored.withColumn("rn", place).filter(F.col("rn") <= k).select("probe", "vec_id", "score")
