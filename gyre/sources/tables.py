"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task at most, where a row is heavy work.
ROWS_A_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; paths go to Spark's readers only, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as the session runs tasks, by a hash of key, if it has fewer; in more, if they would hold over ROWS_A_TASK rows; else as it is.

    For tables before work that is heavy for each row: a small file is one task else, and a large one few, however many rows it has.  Rows are
    counted, from the files' footers, only where the table has as many partitions as the session runs tasks.
    """
    n, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts < n:
        return df.repartition(n, key)
    wanted = -(-df.count() // ROWS_A_TASK)
    return df.repartition(wanted, key) if wanted > parts else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df as spread() has it, but in tasks of ROWS_A_TASK rows at most where it has few partitions too, so that no task grows with the table."""
    out = spread(df, key)
    wanted = tasks(df)
    return df.repartition(wanted, key) if wanted > out.rdd.getNumPartitions() else out


def tasks(df: DataFrame) -> int:
    """How many tasks of ROWS_A_TASK rows the rows of df make; they are counted, so df should be a table of files."""
    return max(1, -(-df.count() // ROWS_A_TASK))
