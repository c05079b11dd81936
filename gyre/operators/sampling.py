"""Reproducible samples: every draw is an order by SHA-256, so it depends on ids alone, not on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.hashing import hash_order


def splits(rows: DataFrame, key: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """(key, split): consecutive slices of the rows in hash order; rows beyond them are in no split.

    Only the rows that the slices need are ordered: the limit is taken in each task before the tasks' rows meet.
    """
    total = sum(sizes.values())
    first = rows.select(key, hash_order(f"split-{seed}", F.col(key)).alias("_h")).orderBy("_h", key).limit(total)
    place = first.withColumn("_n", F.row_number().over(Window.orderBy("_h", key)))
    label, start = None, 0
    for name, size in sizes.items():
        inside = F.col("_n") <= start + size
        label = F.when(inside, F.lit(name)) if label is None else label.when(inside, F.lit(name))
        start += size
    return place.select(key, label.alias("split"))


def round_robin(rows: DataFrame, cells: list[str], bucket: str, order: list[str], quota: int, key: str, seed: int = 0) -> DataFrame:
    """quota rows of each cell: the first of each bucket in the given order of buckets, then the second, and so on."""
    shuffled = hash_order(f"bucket-{seed}", *[F.col(c) for c in cells], F.col(key))
    rows = rows.withColumn("_b", F.array_position(F.array(*[F.lit(b) for b in order]), F.col(bucket)))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*cells, bucket).orderBy(shuffled, key))).filter(F.col("_i") <= quota)  # in each task, before the shuffle
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*cells).orderBy("_i", "_b", key)))
    return rows.filter(F.col("_n") <= quota).withColumnRenamed("_n", "pick").drop("_b", "_i")


def balanced_cells(rows: DataFrame, cells: list[str], bucket: str, order: list[str], total: int, key: str, seed: int = 0) -> DataFrame:
    """total rows in equal parts of each cell, buckets taking turns; the first cells get what is left over.

    Where a cell has too few rows, others fill the gap, in hash order.  No task sees more than `total` rows of a cell.
    """
    picked = round_robin(rows, cells, bucket, order, total, key, seed)
    cell = F.dense_rank().over(Window.orderBy(*cells))
    picked = picked.withColumn("_cell", cell).withColumn("_cells", F.max("_cell").over(Window.partitionBy()))
    quota = F.expr(f"{total} div _cells") + (F.col("_cell") <= F.lit(total) % F.col("_cells")).cast("int")
    place = F.row_number().over(Window.orderBy((F.col("pick") > quota).cast("int"), hash_order(f"fill-{seed}", F.col(key)), key))
    return picked.withColumn("_place", place).filter(F.col("_place") <= total).drop("_cell", "_cells", "_place", "pick")


def balanced(rows: DataFrame, cell: str, total: int, key: str, seed: int = 0) -> DataFrame:
    """total rows in equal parts of each cell; the remainder goes to the cells that sort first."""
    cells = rows.select(cell).distinct().withColumn("_c", F.row_number().over(Window.orderBy(cell))).withColumn("_all", F.count("*").over(Window.partitionBy()))
    share = F.expr(f"{total} div _all") + (F.col("_c") <= F.lit(total) % F.col("_all")).cast("int")
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(cell).orderBy(hash_order(f"pair-{seed}", F.col(cell), F.col(key)), key))).filter(F.col("_n") <= total)  # in each task, before the shuffle
    return ranked.join(cells.withColumn("_q", share).select(cell, "_q"), cell).filter("_n <= _q").drop("_n", "_q")


def blinded(pairs: DataFrame, left: Column, right: Column, left_name: str, right_name: str, key: str, seed: int = 0) -> DataFrame:
    """pairs with pair_id, response_a, response_b, branch_a and branch_b: a coin by hash says which side is A."""
    coin = F.conv(F.substring(hash_order(f"coin-{seed}", F.col(key)), 1, 1), 16, 10).cast("int") % 2 == 0
    number = F.row_number().over(Window.orderBy(key))
    return pairs.withColumns({
        "pair_id": F.format_string("pair_%04d", number),
        "response_a": F.when(coin, left).otherwise(right), "response_b": F.when(coin, right).otherwise(left),
        "branch_a": F.when(coin, F.lit(left_name)).otherwise(F.lit(right_name)), "branch_b": F.when(coin, F.lit(right_name)).otherwise(F.lit(left_name)),
    })


def decoded(pairs: DataFrame, winner: str, names: list[str]) -> DataFrame:
    """pairs with winner_branch (a name or Tie) and one flag for each name."""
    branch = F.when(F.col(winner) == "A", F.col("branch_a")).when(F.col(winner) == "B", F.col("branch_b")).otherwise(F.lit("Tie"))
    out = pairs.withColumn("winner_branch", branch)
    return out.withColumns({f"{n}_win": F.col("winner_branch") == n for n in names})
