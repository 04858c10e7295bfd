"""Tables as versions of lists of fragments: a version is a small numbered file that names directories of Parquet.

Inserts write their own rows as one more fragment; updates and deletes write a fragment that replaces the others. A
version's file is written beside and renamed to its number, and readers take the highest number, so at every moment a
whole version is there, whatever a writer does or wherever it stops; earlier versions stay readable. Rolling back
publishes an earlier version once more. One writer a table is assumed; a second one that comes first to a number makes
the other fail. Files go through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.flatten import evolution, merged


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pending: dict[str, list[dict]] | None = None

    # --- files ---
    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _put(self, path: str, text: str) -> None:
        """Written beside and renamed to a path that nobody has taken yet."""
        fs, at = self._fs(path)
        _, beside = self._fs(f"{path}.{uuid.uuid4().hex}.new")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(at) or not fs.rename(beside, at):
            fs.delete(beside, False)
            raise OSError(f"{path} was taken by another writer")

    def _get(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # --- versions ---
    def history(self, name: str) -> list[str]:
        """The names of a table's version files, in order."""
        fs, at = self._fs(f"{self.root}/{name}/versions")
        return sorted(n for s in fs.listStatus(at) if (n := s.getPath().getName()).endswith(".json")) if fs.exists(at) else []

    def version(self, name: str, number: int = -1) -> dict:
        """A version: schema (JSON), parts (directories), by (partition columns), batches (last number of each stream)."""
        if number == -1 and self.pending and self.pending.get(name):
            return self.pending[name][-1]
        versions = self.history(name)
        if not versions:
            raise ValueError(f"no such table: {name}")
        return json.loads(self._get(f"{self.root}/{name}/versions/{versions[number]}"))

    def read(self, name: str, version: int = -1) -> DataFrame:
        """The table, or one of its earlier versions. Columns that a fragment lacks are null."""
        held = self.version(name, version)
        schema = T.StructType.fromJson(held["schema"])
        if not held["parts"]:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}/data").parquet(*[f"{self.root}/{name}/data/{p}" for p in held["parts"]])
        return found.select(*[f"`{f.name}`" for f in schema])

    def _publish(self, name: str, version: dict) -> None:
        if self.pending is not None:
            self.pending.setdefault(name, []).append(version)
        else:
            self._put(f"{self.root}/{name}/versions/{self._next(name):010d}.json", json.dumps(version))

    def _next(self, name: str) -> int:
        versions = self.history(name)
        return int(versions[-1].split(".")[0]) + 1 if versions else 0

    def _fragment(self, name: str, df: DataFrame, by: list[str]) -> str:
        part = f"fragment__={uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.root}/{name}/data/{part}")
        return part

    def _replace(self, name: str, df: DataFrame, **more) -> None:
        old = self.version(name)
        self._publish(name, old | {"schema": df.schema.jsonValue(), "parts": [self._fragment(name, df, old["by"])]} | more)

    def begin(self) -> None:
        """From now on statements are seen by this store alone, until commit()."""
        self.pending = {}

    def commit(self) -> None:
        """A table's last version is published; each table changes at once, several do one after another."""
        pending, self.pending = self.pending or {}, None
        for name, versions in pending.items():
            self._publish(name, versions[-1])

    def rollback(self, name: str | None = None) -> None:
        """Forgets the statements since begin(), or publishes a table's version before the last once more."""
        if name is None:
            self.pending = None
        elif len(self.history(name)) < 2:
            raise ValueError(f"{name} has no earlier version")
        else:
            self._publish(name, self.version(name, -2))

    # --- statements ---
    def create(self, name: str, schema: T.StructType | str, if_not_exists: bool = False, partition_by: list[str] | None = None) -> None:
        """partition_by: columns whose values have directories of their own, so that filters on them prune the scan."""
        if self.history(name) or (self.pending or {}).get(name):
            if if_not_exists:
                return
            raise ValueError(f"the table {name} is there already")
        schema = self.spark.createDataFrame([], schema).schema
        self._publish(name, {"schema": schema.jsonValue(), "parts": [], "by": partition_by or [], "batches": {}})

    def drop(self, name: str) -> None:
        fs, at = self._fs(f"{self.root}/{name}")
        if not fs.delete(at, True):
            raise ValueError(f"no such table: {name}")

    def seen(self, name: str, batch: tuple[str, int] | None) -> bool:
        """Whether a table holds a batch (stream, number) already: a stream repeats its last batch after a failure."""
        return batch is not None and bool(self.history(name)) and self.version(name)["batches"].get(batch[0], -1) >= batch[1]

    def _append(self, name: str, rows: DataFrame, schema: T.StructType, batch: tuple[str, int] | None) -> int:
        old, counted = self.version(name), Observation()
        part = self._fragment(name, rows.observe(counted, F.count(F.lit(1)).alias("n")), old["by"])
        batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish(name, old | {"schema": schema.jsonValue(), "parts": [*old["parts"], part], "batches": batches})
        return counted.get["n"]

    def insert(self, name: str, rows: DataFrame | list, batch: tuple[str, int] | None = None) -> int:
        """Rows, or the rows of a query, with the table's columns by name; missing ones are null. The number of rows."""
        if self.seen(name, batch):
            return 0
        schema = self.read(name).schema
        new = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)
        if extra := set(new.columns) - set(schema.names):
            raise ValueError(f"{name} has no columns {sorted(extra)}")
        whole = new.select(*[(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        return self._append(name, whole, schema, batch)

    def evolve(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """As insert(), but new columns are added and types widened; only a wider type rewrites what is there."""
        if self.seen(name, batch):
            return 0
        old = self.read(name)
        both = merged(old, rows).schema
        if evolution(old.schema, both)[0] == "break":
            self._replace(name, merged(old, self.spark.createDataFrame([], rows.schema)))
        new = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in both])
        return self._append(name, new, both, batch)

    def update(self, name: str, values: dict[str, Column | object], where: Column | None = None) -> int:
        """The number of rows changed. A condition that is null changes nothing. The table is scanned once."""
        old, counted = self.read(name), Observation()
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        new = old.observe(counted, F.count_if(hit).alias("n"))
        new = new.select(*[F.when(hit, (values[c] if isinstance(values[c], Column) else F.lit(values[c])).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])
        self._replace(name, new)
        return counted.get["n"]

    def delete(self, name: str, where: Column | None = None) -> int:
        """The number of rows deleted. A condition that is null deletes nothing. The table is scanned once."""
        old, counted = self.read(name), Observation()
        if where is None:
            self._publish(name, self.version(name) | {"parts": []})
            return old.count()
        hit = F.coalesce(where, F.lit(False))
        self._replace(name, old.observe(counted, F.count_if(hit).alias("n")).filter(~hit))
        try:
            return counted.get["n"]
        except Py4JJavaError:  # a condition that is always true leaves no scan to observe
            return old.filter(hit).count()

    def compact(self, name: str) -> int:
        """Writes a table's fragments as one; the number that there were. For tables with many small inserts."""
        parts = len(self.version(name)["parts"])
        if parts > 1:
            self._replace(name, self.read(name))
        return parts

    def tables(self) -> list[str]:
        fs, at = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if self.history(s.getPath().getName())) if fs.exists(at) else []

    def describe(self, name: str) -> list[tuple[str, str, bool]]:
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.read(name).schema]
