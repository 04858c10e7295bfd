"""Scalar functions by the names that SQL users of the engine know, with standard semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (function, least and most arguments). Nulls propagate unless the function is about nulls.
FUNCTIONS: dict[str, tuple[Callable[..., Column], int, int]] = {
    "concat": (F.concat, 1, 99),
    "substring": (lambda s, start, n=None: F.substr(s, start, n) if n is not None else F.substr(s, start), 2, 3),
    "length": (F.length, 1, 1),
    "octet_length": (F.octet_length, 1, 1),
    "upper": (F.upper, 1, 1),
    "lower": (F.lower, 1, 1),
    "trim": (lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""), 1, 1),
    "ltrim": (lambda s: F.regexp_replace(s, r"^\s+", ""), 1, 1),
    "rtrim": (lambda s: F.regexp_replace(s, r"\s+$", ""), 1, 1),
    "replace": (F.replace, 3, 3),
    "abs": (F.abs, 1, 1),
    "round": (lambda x, d=None: F.round(x.cast("double"), d if d is not None else 0), 1, 2),
    "floor": (lambda x: F.floor(x).cast("double"), 1, 1),
    "ceil": (lambda x: F.ceil(x).cast("double"), 1, 1),
    "sqrt": (F.sqrt, 1, 1),
    "power": (F.pow, 2, 2),
    "mod": (lambda a, b: a % b, 2, 2),
    "coalesce": (F.coalesce, 1, 99),
    "ifnull": (F.ifnull, 2, 2),
    "isnull": (lambda x, other=None: F.isnull(x) if other is None else F.ifnull(x, other), 1, 2),
    "nullif": (F.nullif, 2, 2),
    "greatest": (F.greatest, 2, 99),
    "least": (F.least, 2, 99),
    "bitwise_and": (lambda a, b: a.bitwiseAND(b), 2, 2),
    "bitwise_or": (lambda a, b: a.bitwiseOR(b), 2, 2),
    "bitwise_xor": (lambda a, b: a.bitwiseXOR(b), 2, 2),
    "bitwise_not": (F.bitwise_not, 1, 1),
}
ALIASES = {"substr": "substring", "len": "length", "ucase": "upper", "lcase": "lower", "ceiling": "ceil", "pow": "power"}


def call(name: str, *args: Column | int) -> Column:
    """The function of that name; a ValueError for an unknown name or a wrong number of arguments."""
    key = name.lower()
    key = ALIASES.get(key, key)
    if key not in FUNCTIONS:
        raise ValueError(f"unknown function: {name}")
    function, least, most = FUNCTIONS[key]
    if not least <= len(args) <= most:
        raise ValueError(f"{name} takes {least} to {most} arguments")
    return function(*args)
