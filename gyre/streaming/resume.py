"""Resumable loops: skip what is done, score equal inputs once, keep the latest row, carry on after a stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class TooManyFailures(RuntimeError):
    """A batch has more failed rows than its budget."""


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not done."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The last row of each key by sequence, of which every tie must be told apart."""
    place = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in sequence])
    return rows.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")


def scored_once(rows: DataFrame, inputs: list[str], score: Callable[[DataFrame], DataFrame], outputs: list[str]) -> DataFrame:
    """rows with what `score` makes of their distinct inputs: equal inputs are scored once and fanned out.

    Null inputs are equal to each other.  score gets the distinct inputs and adds the columns `outputs`.
    """
    key = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)
    keyed = rows.withColumn("input_key", key)
    distinct = keyed.select("input_key", *inputs).dropDuplicates(["input_key"])
    return keyed.join(score(distinct).select("input_key", *outputs), "input_key")


def unresolved(failures: DataFrame, successes: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The latest failure of each key that has no success."""
    return latest(pending(failures, successes, keys), keys, sequence)


def check_failures(failed: Column, rows: DataFrame, budget: int) -> DataFrame:
    """rows, if at most `budget` of them failed; else it raises."""
    if rows.filter(failed).limit(budget + 1).count() > budget:
        raise TooManyFailures(f"more than {budget} failed rows")
    return rows


def upsert_stream(source: DataFrame, work: Callable[[DataFrame], DataFrame], place: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Streams source through `work` into Parquet folders, one a batch; a batch that runs again replaces its own folder.

    Rows whose key an earlier batch has done are skipped, so that a resumed stream does nothing twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates(keys)
        done = finished(spark, place, before=number)
        if done is not None:
            rows = pending(rows, done, keys)
        work(rows).write.mode("overwrite").parquet(f"{place}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judged_batch(rows: DataFrame, number: int, score: Callable[[DataFrame], DataFrame], place: str, keys: list[str], inputs: list[str], outputs: list[str], failed: Column, budget: int) -> None:
    """One batch of rows to judge, with what earlier batches under place have done; a batch that runs again replaces its own folders.

    Rows whose key has succeeded are skipped.  Equal inputs are scored once over all batches: what is known is joined, the rest goes to
    `score`, which adds `outputs` to distinct inputs.  Failed scores are kept as failures, and tried again when their input comes back.
    The batch ends with TooManyFailures if more than `budget` rows of all batches so far have failed and not succeeded since.
    """
    spark = rows.sparkSession
    key = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)
    rows = rows.dropDuplicates(keys).withColumn("input_key", key)
    done = finished(spark, f"{place}/results", before=number)
    rows = rows if done is None else pending(rows, done, keys)
    scores = finished(spark, f"{place}/scores", before=number)
    new = rows.select("input_key", *inputs).dropDuplicates(["input_key"])
    new = new if scores is None else pending(new, scores, ["input_key"])
    score(new).select("input_key", *outputs, failed.alias("failed")).write.mode("overwrite").parquet(f"{place}/tried/batch={number}")
    tried = spark.read.parquet(f"{place}/tried/batch={number}")
    tried.filter("NOT failed").select("input_key", *outputs).write.mode("overwrite").parquet(f"{place}/scores/batch={number}")
    known = tried if scores is None else tried.unionByName(scores.select("input_key", *outputs, F.lit(False).alias("failed")))
    out = rows.join(known, "input_key").withColumn("sequence", F.lit(number))
    out.filter("NOT failed").drop("failed").write.mode("overwrite").parquet(f"{place}/results/batch={number}")
    out.filter("failed").drop("failed").write.mode("overwrite").parquet(f"{place}/failures/batch={number}")
    if open_failures(spark, place, keys, number).limit(budget + 1).count() > budget:
        raise TooManyFailures(f"more than {budget} failed rows up to batch {number}")


def open_failures(spark: SparkSession, place: str, keys: list[str], up_to: int | None = None) -> DataFrame:
    """The last failure of each key that has not succeeded, over all batches or those up to one."""
    before = None if up_to is None else up_to + 1
    failures, done = finished(spark, f"{place}/failures", before), finished(spark, f"{place}/results", before)
    return unresolved(failures, done, keys, ["sequence"])


def judged_stream(source: DataFrame, place: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], keys: list[str], inputs: list[str], outputs: list[str], failed: Column, budget: int) -> StreamingQuery:
    """Streams source through judged_batch(): a stream that stops, by a fault or its budget, goes on with the batch it stopped at."""

    def batch(df: DataFrame, number: int) -> None:
        judged_batch(df, number, score, place, keys, inputs, outputs, failed, budget)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(spark: SparkSession, place: str, before: int | None = None) -> DataFrame | None:
    """What the batches under place have written so far; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    out = spark.read.parquet(place)
    return out if before is None else out.filter(F.col("batch") < before)
