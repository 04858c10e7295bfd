"""Nested JSON to flat tables: objects become ``parent__child`` columns, arrays of objects become child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "__"


def flat_columns(schema: T.StructType, path: str = "", name: str = "") -> list[tuple[str, str, T.DataType]]:
    """(path, column name, type) of the leaves; arrays are leaves."""
    out = []
    for f in schema.fields:
        at, called = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}{SEP}{f.name}" if name else f.name
        out += flat_columns(f.dataType, at, called) if isinstance(f.dataType, T.StructType) else [(at, called, f.dataType)]
    return out


def _objects(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def flatten(df: DataFrame, name: str, key: str | None = None) -> dict[str, DataFrame]:
    """Tables by name. A child ``name__column`` has a row for each element, with the parent's key as ``name_id`` and
    the element's place as ``_pos``; parents with empty or missing arrays have no child rows. key: the parent's
    column; by default ``id``, or else the first column that ends in _id; without either, arrays are an error."""
    columns = flat_columns(df.schema)
    names = [c for _, c, _ in columns]
    if repeated := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"columns meet in one name: {sorted(repeated)}")
    key = key or next((n for n in names if n == "id"), None) or next((n for n in names if n.endswith("_id")), None)
    out = {name: df.select(*[F.col(p).alias(c) for p, c, t in columns if not _objects(t)])}
    for path, column, kind in columns:
        if not _objects(kind):
            continue
        if key is None:
            raise ValueError(f"{name} has the array {column} and no key for its rows")
        rows = df.select(F.col(next(p for p, c, _ in columns if c == key)).alias(f"{name}_id"), F.posexplode(F.col(path)).alias("_pos", "_item"))
        inner = rows.select(f"{name}_id", "_pos", *[F.col(f"_item.{p}").alias(c) for p, c, _ in flat_columns(kind.elementType)])
        deeper = [(c, t) for _, c, t in flat_columns(kind.elementType) if _objects(t)]
        if deeper:
            keyed = inner.withColumn("_key", F.concat_ws("/", f"{name}_id", "_pos"))
            for child, table in flatten(keyed, f"{name}{SEP}{column}", "_key").items():
                out[child] = table.drop("_key") if child == f"{name}{SEP}{column}" else table
        else:
            out[f"{name}{SEP}{column}"] = inner
    return out


#: Types by rank: of two that meet in a column, the higher holds both.
_RANK = [T.BooleanType, T.LongType, T.DoubleType, T.StringType]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    rank = {T.IntegerType: 1, T.ShortType: 1, T.ByteType: 1, T.FloatType: 2, T.DecimalType: 2} | {t: i for i, t in enumerate(_RANK)}
    return _RANK[max(rank.get(type(a), 3), rank.get(type(b), 3))]()


def evolution(old: T.StructType, new: T.StructType) -> tuple[str, list[str]]:
    """("none" | "add" | "break", columns): new columns add, missing ones and narrower types break."""
    before, after = {f.name: f.dataType for f in old}, {f.name: f.dataType for f in new}
    lost = [n for n in before if n not in after]
    changed = [n for n in before if n in after and common_type(before[n], after[n]) != before[n]]
    if lost or changed:
        return "break", lost + changed
    added = [n for n in after if n not in before]
    return ("add", added) if added else ("none", [])


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, by column names: missing columns are null, columns of different types take the common one."""
    kinds = {f.name: f.dataType for f in old.schema}
    for f in new.schema:
        kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    cast = lambda df: df.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in df.columns])
    return cast(old).unionByName(cast(new), allowMissingColumns=True)
