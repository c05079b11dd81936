"""Consecutive numbers over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.sources.shared import written


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """df with the place of each row in an order, from 0; rows that tie get places of their own.

    Rows are sorted by ranges over all tasks and written; a row's number is its place in its range and the rows of the ranges before, of
    which there is one count a task.  An empty table gives no rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id()
    rows = written(ranged.withColumn("_place", F.spark_partition_id()).withColumn("_at", low.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = rows.groupBy("_place").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    sizes = F.broadcast(sizes.select("_place", before.alias("_before")))  # a row a task
    return rows.join(sizes, "_place").withColumn(name, F.col("_before") + F.col("_at")).drop("_place", "_at", "_before")
