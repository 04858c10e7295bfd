"""One function for each operator, (spark, sf_dir) -> DataFrame, with SQL that gives the same rows."""

from sparkloom.operators import aggregates, benchmarks, joins, more, relational, scalars, setops, stores, vectors, windows  # noqa: F401
from sparkloom.operators.registry import ORACLES, QUERIES  # noqa: F401
