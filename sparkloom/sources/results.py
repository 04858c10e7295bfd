"""Forms of a result: whole, summary, sample, representatives, or what it looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame) -> DataFrame:
    return df.summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")


def sample(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows by a seeded hash of the whole row, so that a repeated call gives the same ones; only n a task are sorted."""
    return df.orderBy(F.xxhash64(F.to_json(F.struct(*df.columns)), F.lit(seed))).limit(n)


def representative(df: DataFrame, n: int, by: str, rows: int | None = None) -> DataFrame:
    """About n rows, evenly spaced in the order of a column: the first of each of n ranges of equal size.

    The ranges' limits come from quantiles, and a task keeps one row of each, so nothing is sorted."""
    cuts = df.filter(F.col(by).isNotNull()).stat.approxQuantile(by, [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bucket = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(by))) if cuts else F.lit(0)
    first = F.min_by(F.struct(*df.columns), F.struct(F.col(by), F.xxhash64(F.to_json(F.struct(*df.columns)))))
    return df.groupBy(bucket.alias("_bucket")).agg(first.alias("_row")).select("_row.*")


def metadata(df: DataFrame) -> dict:
    return {"columns": [(f.name, f.dataType.simpleString()) for f in df.schema], "rows": df.count()}


def formatted(df: DataFrame, form: str = "full", n: int = 100, by: str | None = None):
    """full, summary, sample, representative (by a column) or metadata."""
    forms = {"full": lambda: df, "summary": lambda: summary(df), "sample": lambda: sample(df, n), "representative": lambda: representative(df, n, by or df.columns[0]), "metadata": lambda: metadata(df)}
    if form not in forms:
        raise ValueError(f"no such form: {form}")
    return forms[form]()
