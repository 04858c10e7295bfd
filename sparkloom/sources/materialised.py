"""A group-by that is kept: partial results in a table, to which new rows are added without the old ones being read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.store import TableStore

_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_AGAIN = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


class Materialised:
    """metrics: result name to (count, sum, min or max; column). An average is a sum and a count."""

    def __init__(self, store: TableStore, name: str, keys: list[str], metrics: dict[str, tuple[str, str]]):
        if wrong := {op for op, _ in metrics.values()} - set(_FIRST):
            raise ValueError(f"no partial results of {sorted(wrong)}")
        self.store, self.name, self.keys, self.metrics = store, name, keys, metrics

    def add(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds the partial results of new rows as a fragment; a batch that is repeated adds nothing."""
        partial = rows.groupBy(*self.keys).agg(*[_FIRST[op](c).alias(n) for n, (op, c) in self.metrics.items()])
        self.store.create(self.name, partial.schema, if_not_exists=True)
        self.store.insert(self.name, partial, batch)

    def read(self) -> DataFrame:
        """The results over all rows that were added."""
        return self.store.read(self.name).groupBy(*self.keys).agg(*[_AGAIN[op](n).alias(n) for n, (op, _) in self.metrics.items()])

    def compact(self) -> None:
        """Makes the partial results of each key one row."""
        self.store._replace(self.name, self.read())
