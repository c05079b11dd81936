"""The folder that driver and executors share, tables written there, and joins that know the size of their sides."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that may be broadcast at most: of some numbers each, under 100 MB.  Larger sides are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a session within one machine gets a folder of its own; a cluster has none that all would see.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="gyre-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; cleared() removes it."""
    return f"{shared_dir(spark)}/gyre/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cleared(spark: SparkSession) -> bool:
    """Removes this application's intermediate tables, when no result that reads them is needed any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read from there: lineage ends, and lost executors lose nothing."""
    place = new_folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; they are counted, so df should be written or cheap."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (they are counted), else df as it is.

    The caller keeps df to a few fixed-width columns, so that the bound on rows bounds the bytes.
    """
    return F.broadcast(df) if few(df, rows) else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to right on equal keys, where null equals null; the keys and columns of left, then those of right."""
    right = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    same = reduce(lambda x, y: x & y, (F.col(key).eqNullSafe(F.col(f"_r_{key}")) for key in keys))
    return left.join(right, same, how).drop(*(f"_r_{key}" for key in keys))


def running(df: DataFrame, by: list[str], at: str, value: str, width: int = 4_096) -> DataFrame:
    """df with `before`: the sum of value over rows of the same `by` with a smaller `at`, a whole number and unique in `by`.

    Sums are taken in ranges of `width` values of `at`, then over ranges, so that a large `by` is spread over tasks.
    """
    return all_running(df, by, at, {"before": value}, width)


def all_running(df: DataFrame, by: list[str], at: str, values: dict[str, str], width: int = 4_096) -> DataFrame:
    """df with the running sums (see running) of several columns, each under the name given with it, in one pass."""
    rows = df.withColumn("_range", F.expr(f"`{at}` div {width}"))
    inside = Window.partitionBy(*by, "_range").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*by, "_range").agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in values.items()])
    sums = sums.select(*by, "_range", *[(F.sum(f"_sum_{name}").over(over) - F.col(f"_sum_{name}")).alias(f"_earlier_{name}") for name in values])
    rows = rows.select("*", *[(F.sum(value).over(inside) - F.col(value)).alias(f"_inside_{name}") for name, value in values.items()])
    out = null_safe_join(rows, sums, [*by, "_range"]).withColumns({name: F.col(f"_earlier_{name}") + F.col(f"_inside_{name}") for name in values})
    return out.drop("_range", *[f"_{part}_{name}" for name in values for part in ("inside", "earlier")])
