"""Tables of contexts that count only once they are committed.

A part is a folder of rows by context.  When it is written whole, and read again to be counted, its manifest is written: one small file
with the rows and the digest of each of its contexts.  Readers go by the manifests: a part that a lost driver left behind has none, and of several
commits of a context the last one counts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.sources.shared import null_safe_join, small

HEAD = (("part", T.StringType()), ("number", T.LongType()), ("base", T.LongType()), ("n_rows", T.LongType()), ("digest", T.StringType()))


def row_hash(columns: list[str]) -> Column:
    """Two 64-bit hashes of a row as JSON, nulls and all."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.struct(*[F.xxhash64(F.lit(seed), text).cast("decimal(38,0)").alias(f"h{seed}") for seed in (1, 2)])


def contents(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, digest) of each context: the digest is a sum over rows, so that it does not depend on their order."""
    rows = df.withColumn("_h", row_hash(sorted(c for c in df.columns if c not in by)))
    sums = [F.sum(f"_h.h{seed}").cast("string") for seed in (1, 2)]
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.concat_ws(":", *sums).alias("digest"))


def _typed(schema: T.StructType, by: list[str]) -> T.StructType:
    return T.StructType([*(T.StructField(name, kind) for name, kind in HEAD), *(schema[c] for c in by)])


def write_part(df: DataFrame, place: str, by: list[str]) -> str:
    """df as a new part, which no reader sees yet."""
    part = uuid.uuid4().hex
    df.write.partitionBy(*by).parquet(f"{place}/parts/part={part}")
    return part


def parts(spark: SparkSession, place: str, schema: T.StructType, part: str | None = None) -> DataFrame:
    """The rows of all parts, or of one, with the part's name."""
    typed = T.StructType([*schema, T.StructField("part", T.StringType())])
    return spark.read.schema(typed).option("basePath", f"{place}/parts").parquet(f"{place}/parts" + (f"/part={part}" if part else ""))


def commit(spark: SparkSession, place: str, part: str, schema: T.StructType, by: list[str], compacted: bool = False) -> DataFrame:
    """Writes the manifest of a part, as one file, after counting what the part holds; compacted: older parts count no more."""
    number = (manifests(spark, place, schema, by).agg(F.max("number")).first()[0] or 0) + 1
    found = contents(parts(spark, place, schema, part).drop("part"), by)
    out = found.select(F.lit(part).alias("part"), F.lit(number).cast("long").alias("number"), F.lit(number if compacted else 0).cast("long").alias("base"), "n_rows", "digest", *by)
    out.coalesce(1).write.json(f"{place}/commits/{part}")
    return manifests(spark, place, schema, by).filter(F.col("part") == part)


def manifests(spark: SparkSession, place: str, schema: T.StructType, by: list[str]) -> DataFrame:
    """(part, number, base, n_rows, digest, by) of every committed part that no compaction has replaced."""
    typed = _typed(schema, by)
    try:
        found = spark.read.schema(typed).option("recursiveFileLookup", True).json(f"{place}/commits")
    except AnalysisException:  # nothing is committed
        return spark.createDataFrame([], typed)
    base = found.agg(F.max("base")).first()[0] or 0
    return found.filter(F.col("number") >= base)


def save(df: DataFrame, place: str, by: list[str]) -> DataFrame:
    """df's contexts, committed: from then on they take the place of what was there of them."""
    return commit(df.sparkSession, place, write_part(df, place, by), df.schema, by)


def latest(spark: SparkSession, place: str, schema: T.StructType, by: list[str]) -> DataFrame:
    """The manifest of each context's last commit."""
    last = F.max(F.struct("number", "part", "n_rows", "digest")).alias("last")
    return manifests(spark, place, schema, by).groupBy(*by).agg(last).select("last.*", *by)


def read(spark: SparkSession, place: str, schema: T.StructType, by: list[str]) -> DataFrame:
    """The rows of committed contexts, each from its last commit."""
    known = latest(spark, place, schema, by)
    if known.isEmpty():
        return spark.createDataFrame([], schema)
    return null_safe_join(parts(spark, place, schema), small(known.select("part", *by)), ["part", *by]).select(*schema.names)


def verified(spark: SparkSession, place: str, schema: T.StructType, by: list[str]) -> DataFrame:
    """(by, n_rows, n_found, status) of each committed context: ok, missing, or damaged where rows or digest are others than those committed."""
    known = latest(spark, place, schema, by)
    found = contents(read(spark, place, schema, by), by).withColumnsRenamed({"n_rows": "n_found", "digest": "found"})
    both = null_safe_join(known, found, by, "left")
    status = F.when(F.col("n_found").isNull(), "missing").when((F.col("n_rows") == F.col("n_found")) & (F.col("digest") == F.col("found")), "ok").otherwise("damaged")
    return both.select(*by, "n_rows", F.coalesce("n_found", F.lit(0)).alias("n_found"), status.alias("status"))
