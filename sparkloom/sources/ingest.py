"""Ingestion: fetch, flatten, evolve, store, count, and note where rows came from."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.connectors import Checkpoint, JsonConnector, payload_frame
from sparkloom.sources.flatten import evolution, flatten
from sparkloom.sources.store import TableStore

@dataclass
class Run:
    table: str
    rows: dict[str, int] = field(default_factory=dict)
    evolved: dict[str, str] = field(default_factory=dict)
    checkpoint: Checkpoint = Checkpoint()
    seconds: float = 0.0


class Ingestion:
    """Loads connectors and frames into a store; runs and lineage are kept as rows."""

    def __init__(self, store: TableStore):
        self.store, self.runs, self.lineage = store, [], []

    def _load(self, run: Run, tables: dict[str, DataFrame], source: str, batch: tuple[str, int] | None = None) -> None:
        for name, rows in tables.items():
            # an array without elements tells no type; where its elements have a table of their own it is no column
            rows = rows.drop(*[c for c, t in rows.dtypes if t.startswith("array") and (f"{name}__{c}" in tables or self.store.history(f"{name}__{c}"))])
            if not self.store.history(name) and not (self.store.pending or {}).get(name):
                self.store.create(name, rows.schema)
                kind = "none"
            else:
                kind, columns = evolution(self.store.read(name).schema, rows.schema)
                if kind == "break" and (lost := [c for c in columns if c not in rows.columns]):
                    rows = rows.withColumns({c: F.lit(None).cast(self.store.read(name).schema[c].dataType) for c in lost})
            run.evolved[name] = max(kind, run.evolved.get(name, "none"), key=["none", "add", "break"].index)
            run.rows[name] = run.rows.get(name, 0) + self.store.evolve(name, rows, batch)
            self.lineage.append({"source": source, "table": name, "columns": rows.columns, "rows": run.rows[name]})

    def ingest(self, connector: JsonConnector, table: str, key: str | None = None, checkpoint: Checkpoint = Checkpoint()) -> Run:
        """All batches of a connector from a checkpoint on; each batch is a version of the tables."""
        run, began = Run(table, checkpoint=checkpoint), time.time()
        for batch in connector.batches(checkpoint):
            if batch.payloads:
                self._load(run, flatten(payload_frame(self.store.spark, batch.payloads), table, key), type(connector).__name__)
            run.checkpoint = batch.checkpoint
        run.seconds = time.time() - began
        self.runs.append(run)
        return run

    def ingest_frame(self, df: DataFrame, table: str, key: str | None = None, source: str = "frame", batch: tuple[str, int] | None = None) -> Run:
        run = Run(table)
        self._load(run, flatten(df, table, key), source, batch)
        self.runs.append(run)
        return run

    def each_batch(self, table: str, key: str | None = None, stream: str = "stream"):
        """For foreachBatch of a stream, whose checkpoint then is the source's. Each table holds the number of the last
        batch with its rows, so a batch that is repeated after a failure adds only what it hadn't yet."""
        return lambda df, number: self.ingest_frame(df, table, key, stream, (stream, number))


def deduplicated(df: DataFrame, keys: list[str], policy: str = "latest", order: Column | str | None = None) -> DataFrame:
    """policy: append (all rows), latest or first (by ``order`` within the keys; ties by all columns)."""
    if policy == "append":
        return df
    if policy not in ("latest", "first") or order is None:
        raise ValueError("latest and first need an order; other policies are not known")
    at = F.col(order) if isinstance(order, str) else order
    ties = [F.xxhash64(*df.columns)]
    w = Window.partitionBy(*keys).orderBy(at.desc_nulls_last() if policy == "latest" else at.asc_nulls_last(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def statistics(df: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls, distinct values (approximate), smallest and largest as text. One pass."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        text = c.cast("string") if f.dataType.simpleString() not in ("binary",) and not f.dataType.simpleString().startswith(("array", "map", "struct")) else F.lit(None).cast("string")
        ordered = c if text is not F.lit(None) and not f.dataType.simpleString().startswith(("array", "map", "struct", "binary")) else F.lit(None).cast("string")
        parts.append(F.struct(F.lit(f.name).alias("column"), F.count("*").alias("rows"), (F.count("*") - F.count(c)).alias("nulls"), F.approx_count_distinct(F.xxhash64(c)).alias("distinct"), F.min(ordered).cast("string").alias("least"), F.max(ordered).cast("string").alias("most")))
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): bins of equal width between the least and the largest value; the last one holds it too."""
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("low"), F.max(c).alias("high"))
    if ends.first()["low"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    low, high = ends.first()
    width = (high - low) / bins
    at = F.least(F.floor((c - low) / width).cast("int"), F.lit(bins - 1)) if width else F.lit(0)
    counted = df.filter(c.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")


def percentiles(df: DataFrame, column: str, shares: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.99), accuracy: int = 10_000) -> DataFrame:
    """(share, value): values below which so many of the rows lie, in rank off by 1 / accuracy of them at most."""
    found = df.agg(F.percentile_approx(column, list(shares), accuracy).alias("v"))
    return found.select(F.posexplode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("v").alias("value")))).select("col.share", "col.value")


def skew(df: DataFrame, column: str) -> DataFrame:
    """(values, rows, most, ratio): distinct values, the rows of the most frequent one, and these against the mean."""
    per = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("values"), F.sum("n").alias("rows"), F.max("n").alias("most"), (F.max("n") * F.count("*") / F.sum("n")).alias("ratio"))
