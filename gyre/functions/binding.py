"""Values that an expression uses several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: the bound of a lambda is not spelt out again in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once for each row.

    They come out of a generator, which Catalyst neither merges with projections above it nor pushes filters through;
    a plain projection is spelt out again in every filter and expression that reads it, down to the scan.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
