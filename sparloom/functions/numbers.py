"""Number formulas, parsing that raises, and C-style number text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, to: int) -> int:
    """The least multiple of `to` that is a or more."""
    return ceil_div(a, to) * to


def number(token: Column, kind: str) -> Column:
    """token as a number; raises on one that isn't."""
    return F.coalesce(token.try_cast(kind), F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.coalesce(token, F.lit("(missing)")))).cast(kind))


def printf(value: Column, pattern: str) -> Column:
    """value as C's printf writes it.

    This needs the digits of the exact binary value: JVM formats start from the shortest text that reads back, so they pad
    0.1 with zeros where 19 digits are asked for, and round it twice where fewer are. Hence Arrow batches and Python's own format.
    """

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: pattern % v if v is not None else None)

    return text(value.cast("double"))


def printf_all(values: Column, pattern: str) -> Column:
    """The numbers of an array, each as printf() writes it, one after another."""

    @F.pandas_udf("string")
    def text(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda x: "".join([pattern % v for v in x]) if x is not None else None)

    return text(values.cast("array<double>"))
