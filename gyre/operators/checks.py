"""Contracts on tables: columns, unique keys, join cardinality, equal and disjoint key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what an operator relies on."""


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{what} lacks columns {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def _holds(condition: Column, message: Column) -> Column:
    """True, or an error with the message.  No cast stands around the error: the optimiser takes a cast of it for a null, and the row would go unsaid."""
    return F.assert_true(condition, message).isNull()


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, whose rows are checked as they are read: a key that stands twice ends the job with an error that names it.

    The count is a window over the keys, whose shuffle a join or an aggregate on the same keys shares: no second scan, no job of its own.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    message = F.concat(F.lit(f"{what} repeats keys, such as "), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return df.withColumn("_n", n).filter(_holds(F.col("_n") <= 1, message)).drop("_n")


def require_match(df: DataFrame, column: str, keys: list[str], what: str) -> DataFrame:
    """df, whose rows are checked as they are read: a null in `column`, as a left join leaves it, ends the job."""
    message = F.concat(F.lit(f"{what} misses keys, such as "), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return df.filter(_holds(F.col(column).isNotNull(), message))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", kind: str = "1:1", what: str = "join") -> DataFrame:
    """A join whose key sides are checked in its own pass: 1:1, m:1 or 1:m.  A broken one ends with an error instead of repeating rows."""
    if kind[0] == "1":
        left = require_unique(left, on, f"left side of {what}")
    if kind[-1] == "1":
        right = require_unique(right, on, f"right side of {what}")
    return left.join(right, on, how)


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that only the left has, that only the right has, and that both have."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*keys, F.lit(0), F.lit(1)))
    both = sides.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))

    def n(condition: str) -> Column:
        return F.count(F.when(F.expr(condition), 1))

    return both.agg(n("l = 1 AND r = 0").alias("only_left"), n("l = 0 AND r = 1").alias("only_right"), n("l = 1 AND r = 1").alias("in_both"))


def overlaps(df: DataFrame, key: str, split: str) -> DataFrame:
    """For each two splits that share keys: how many.  Empty if all splits are disjoint."""
    keys = df.select(key, split).distinct()
    shared = keys.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    two = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return shared.select(F.explode(two).alias("p")).groupBy(F.col("p.left").alias("left_split"), F.col("p.right").alias("right_split")).agg(F.count("*").alias("n_shared"))


def compared(stored: DataFrame, computed: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Stored against computed values, one row for each key and value: ok, mismatch or missing_value."""
    both = stored.select(*keys, *[F.col(v).alias(f"stored_{v}") for v in values]).join(computed.select(*keys, *[F.col(v).alias(f"computed_{v}") for v in values]), keys, "full_outer")
    rows = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"stored_{v}").cast("double").alias("stored"), F.col(f"computed_{v}").cast("double").alias("computed")) for v in values])
    out = both.select(*keys, F.inline(rows))
    status = F.when(F.col("stored").isNull() | F.col("computed").isNull(), "missing_value").when(F.abs(F.col("stored") - F.col("computed")) <= tolerance, "ok").otherwise("mismatch")
    return out.withColumn("status", status)
