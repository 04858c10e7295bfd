"""Reading and writing of tables: Parquet, CSV, JSON, rows in memory, Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, merge: bool = False) -> DataFrame:
    """Column lists and filters reach the scan; merge: files with different columns make one schema."""
    df = spark.read.option("mergeSchema", str(merge).lower()).parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """With a header line. Without a schema the types are inferred, which reads the files once more."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, many_lines: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", many_lines)
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def from_rows(spark: SparkSession, rows: list, schema: T.StructType | str, view: str | None = None) -> DataFrame:
    """Rows held by the caller as a DataFrame, under the name of a view if one is given."""
    df = spark.createDataFrame(rows, schema)
    if view:
        df.createOrReplaceTempView(view)
    return df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "errorifexists", codec: str | None = None) -> None:
    """sort_by: ranges of these columns go to the same files in order, so that row groups can be skipped by them.
    codec: zstd, snappy, gzip, lz4, brotli or none; the session's by default."""
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode)
    writer = writer.option("compression", codec) if codec else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def arrow_stream(df: DataFrame, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of a result, one partition after another; the caller may stop at any time. Executors make the batches,
    and the driver holds those of one or two partitions, as bytes. Without rows, one batch without rows."""
    schema, empty = to_arrow_schema(df.schema), True

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["ipc"])

    for row in df.mapInArrow(packed, "ipc binary").toLocalIterator(prefetchPartitions=True):
        for batch in pa.ipc.open_stream(row[0]):
            empty = False
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)
    if empty:
        yield pa.RecordBatch.from_pylist([], schema=schema)


def json_chunks(df: DataFrame, rows: int = 1_000) -> Iterator[list[str]]:
    """JSON texts of the rows, in chunks."""
    held: list[str] = []
    for text in df.toJSON().toLocalIterator(prefetchPartitions=True):
        held.append(text)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path; with a whole-number column, in so many parts at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()
