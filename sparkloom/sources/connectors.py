"""Connectors that are pulled in batches with a checkpoint, and generated sources."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Checkpoint:
    """How far a source has been read."""

    cursor: int = 0
    records: int = 0


@dataclass(frozen=True)
class Batch:
    payloads: list[str]
    checkpoint: Checkpoint
    more: bool


@dataclass
class JsonConnector:
    """JSON objects held by the caller, or a JSON text with an array or one object."""

    source: list[dict] | str
    size: int = 100
    records: list[dict] = field(init=False)

    def __post_init__(self):
        found = json.loads(self.source) if isinstance(self.source, str) else self.source
        self.records = found if isinstance(found, list) else [found]

    def fetch(self, checkpoint: Checkpoint = Checkpoint()) -> Batch:
        part = self.records[checkpoint.cursor : checkpoint.cursor + self.size]
        end = checkpoint.cursor + len(part)
        return Batch([json.dumps(r) for r in part], Checkpoint(end, checkpoint.records + len(part)), end < len(self.records))

    def batches(self, checkpoint: Checkpoint = Checkpoint()) -> Iterator[Batch]:
        more = True
        while more:
            batch = self.fetch(checkpoint)
            checkpoint, more = batch.checkpoint, batch.more
            yield batch


SHAPES = ("flat", "nested", "with_arrays", "ecommerce")


def simulated(spark: SparkSession, shape: str, rows: int = 1_000) -> DataFrame:
    """Rows of a generated source, made by the executors from the row's number alone."""
    n, base = F.col("id"), spark.range(rows)
    money = lambda k: F.round((n * k % 9973) / 7, 2)
    if shape == "flat":
        return base.select("id", F.concat(F.lit("item_"), n).alias("name"), money(31).alias("value"), (n % 2 == 0).alias("active"))
    if shape == "nested":
        user = F.struct(F.concat(F.lit("user_"), n).alias("name"), F.concat(F.lit("user_"), n, F.lit("@example.com")).alias("email"))
        return base.select("id", user.alias("user"), F.struct(F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")).cast("string").alias("created_at"), F.lit(1).cast("long").alias("version")).alias("metadata"))
    items = F.sequence(F.lit(1).cast("long"), n % 3 + 1)
    if shape == "with_arrays":
        return base.select("id", (n + 1000).alias("order_id"), F.transform(items, lambda i: F.struct((n * 7 + i).alias("product_id"), i.alias("quantity"), F.round(i * 1.5, 2).alias("price"))).alias("items"))
    if shape == "ecommerce":
        line = lambda i: F.struct((n * 7 + i).alias("product_id"), F.concat(F.lit("product_"), i).alias("product_name"), i.alias("quantity"), F.round(i * 9.99, 2).alias("unit_price"))
        day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")).cast("string")
        return base.select(n.alias("order_id"), (n % 97).alias("customer_id"), day.alias("order_date"), money(57).alias("total_amount"), F.element_at(F.array(F.lit("new"), F.lit("paid"), F.lit("sent")), (n % 3 + 1).cast("int")).alias("status"), F.transform(items, line).alias("items"))
    raise ValueError(f"no such shape: {shape}; there are {', '.join(SHAPES)}")


def payload_frame(spark: SparkSession, payloads: list[str]) -> DataFrame:
    """A batch of JSON texts as rows, with the schema inferred over all of them."""
    ddl = spark.range(1).select(F.schema_of_json(F.lit(f"[{','.join(payloads)}]"))).first()[0]
    texts = spark.createDataFrame([(f"[{p}]",) for p in payloads], "value string")
    return texts.select(F.explode(F.from_json("value", ddl)).alias("r")).select("r.*")
