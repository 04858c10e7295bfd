"""Count-Min sketches as tables of counters, so that they are built, merged and asked with joins and sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shape(error: float, confidence: float) -> tuple[int, int]:
    """(counters in a row, rows): an estimate is over by ``error`` of all rows at most, with the confidence."""
    return math.ceil(math.e / error), max(1, math.ceil(math.log(1 / (1 - confidence))))


def _cells(key: Column, error: float, confidence: float) -> Column:
    width, rows = _shape(error, confidence)
    return F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(key, F.lit(r)), F.lit(width)).alias("cell")) for r in range(rows)])


def count_min(df: DataFrame, column: str, error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """(row, cell, n): the counters. Keys are counted first, so a hot key is one row when it meets them."""
    keys = df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    cells = keys.select(F.explode(_cells(F.col("key"), error, confidence)).alias("at"), "n")
    return cells.groupBy("at.row", "at.cell").agg(F.sum("n").alias("n"))


def united(*sketches: DataFrame) -> DataFrame:
    """The sketch of all that several sketches of one shape have counted."""
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy("row", "cell").agg(F.sum("n").alias("n"))


def estimated(keys: DataFrame, column: str, sketch: DataFrame, error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """``keys`` with the column ``estimate``: the least of each key's counters, 0 where one was never counted. The
    sketch's size is that of its shape, so it is broadcast."""
    width, rows = _shape(error, confidence)
    counters = F.broadcast(sketch.select(F.col("row").alias("_row"), F.col("cell").alias("_cell"), F.col("n").alias("_n")))
    asked = keys.withColumn("_at", F.explode(_cells(F.col(column), error, confidence)))
    met = asked.join(counters, (F.col("_at.row") == F.col("_row")) & (F.col("_at.cell") == F.col("_cell")), "left")
    return met.groupBy(*[F.col(f"`{c}`") for c in keys.columns]).agg(F.min(F.coalesce("_n", F.lit(0))).alias("estimate"))
