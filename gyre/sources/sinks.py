"""Writing tables, and reading the artifact trees that runs leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def save_tabular(df: DataFrame, place: str, csv: bool = True, parquet: bool = True) -> None:
    """df as CSV with a header, as Parquet, or both, in folders under place."""
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{place}/csv")
    if parquet:
        df.write.mode("overwrite").parquet(f"{place}/parquet")


def save_jsonl(df: DataFrame, place: str) -> None:
    df.write.mode("overwrite").json(place)


def save_context(df: DataFrame, place: str, by: list[str]) -> None:
    """df in a folder for each context; only the contexts that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(place)


def scan_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of model/branch/gen_n/name under the runs of a glob, with model_dir, branch, generation and the file's time."""
    out = spark.read.option("mergeSchema", True).parquet(pattern).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"))
    part = r"([^/]+)/([^/]+)/gen_(\d+)/[^/]+(?:/[^/]*)?$"
    return out.withColumns({
        "model_dir": F.regexp_extract("file_path", part, 1),
        "branch_dir": F.regexp_extract("file_path", part, 2),
        "generation_dir": F.regexp_extract("file_path", part, 3).try_cast("int"),
    })


def scan_reports(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """JSON reports, one object a file, as rows of a given schema; missing fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern)


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """One row: the newest file of a glob."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max_by("path", "modificationTime").alias("path"))
