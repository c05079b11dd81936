"""Readers of the artifact trees of many runs: configurations, summaries by precedence, contexts from paths.

A tree has a folder for each run, whose name may hold `seed<number>`; globs find them, so that a read is one job however
many runs there are.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.operators.checks import checked_join, require_columns, require_match, require_unique
from gyre.sources.shared import new_folder, written

SNAPSHOT = "project struct<seed:int>, experiment struct<mode:string,branches:array<struct<name:string,anchor_ratio:double,mixing_mode:string>>>, models struct<base:string>"
SUMMARY = "model_name string, branch string, generation int, sample_count long, accuracy_mean double, accuracy_mean_corrected double, pedagogical_score_mean double, silent_error_rate double"
#: Summary tables, the first that a run has counts: name, format, column of the accuracy, and what the source is called.
SUMMARIES = (
    ("summary_corrected.csv", "csv", "accuracy_mean_corrected", "corrected"),
    ("summary.csv", "csv", "accuracy_mean", "raw_summary"),
    ("summary.parquet", "parquet", "accuracy_mean", "raw_summary"),
)


def run_of(path: Column) -> Column:
    """The name of the run folder that a path lies in: the last part that begins with `run_`."""
    return F.regexp_extract(path, r".*/(run_[^/]*)/", 1)


def seed_of(run: Column) -> Column:
    """The number after the last `seed` of a run's name; null if there is none."""
    return F.regexp_extract(run, r".*seed(\d+)", 1).try_cast("int")


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(run, seed, mode, base_model, branches) of each run's configuration.

    The seed is that of the configuration, or else of the run's name; without a mode it is inference; other nulls stay.
    """
    rows = spark.read.schema(SNAPSHOT).json(f"{root}/run_*/config.json").select("*", run_of(F.col("_metadata.file_path")).alias("run"))
    return rows.select("run", F.coalesce("project.seed", seed_of(F.col("run"))).alias("seed"), F.coalesce("experiment.mode", F.lit("inference")).alias("mode"), F.col("models.base").alias("base_model"), F.col("experiment.branches").alias("branches"))


def summaries(spark: SparkSession, root: str) -> DataFrame:
    """The summary rows of each run with accuracy_mean_effective and accuracy_source, from the first of SUMMARIES that it has.

    A tree that has none of them is an error.
    """
    parts = []
    for rank, (name, kind, accuracy, source) in enumerate(SUMMARIES):
        place = f"{root}/run_*/tables/{name}"
        reader = spark.read.option("recursiveFileLookup", True)
        try:
            rows = reader.option("header", True).csv(place) if kind == "csv" else reader.parquet(place)
        except AnalysisException:  # no run has it
            continue
        if accuracy not in rows.columns:
            raise ValueError(f"{name} lacks {accuracy}")
        fields = [f.split() for f in SUMMARY.split(", ")]
        rows = rows.select(run_of(F.col("_metadata.file_path")).alias("run"), *[F.col(c).cast(t).alias(c) for c, t in fields if c in rows.columns and not c.startswith("accuracy")], F.col(accuracy).cast("double").alias("accuracy_mean_effective"))
        parts.append(rows.withColumns({"accuracy_source": F.lit(source), "_rank": F.lit(rank)}))
    if not parts:
        raise FileNotFoundError(f"no summary under {root}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("_best", F.min("_rank").over(Window.partitionBy("run"))).filter("_rank = _best").drop("_rank", "_best")


def contexts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(run, model_dir, branch, generation, n_rows) of the artifacts run/model/branch/gen_n/name."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/run_*/*/*/gen_*/{name}").select(F.col("_metadata.file_path").alias("path"))
    part = rf".*/(run_[^/]*)/([^/]+)/([^/]+)/gen_(\d+)/{name}/"
    keys = [F.regexp_extract("path", part, k).alias(c) for k, c in ((1, "run"), (2, "model_dir"), (3, "branch"))]
    return rows.groupBy(*keys, F.regexp_extract("path", part, 4).cast("int").alias("generation")).agg(F.count("*").alias("n_rows"))


def new_tree(spark: SparkSession) -> str:
    """A new folder for a tree, where driver and executors see it; shared.cleared() removes it."""
    return new_folder(spark, "runs")


#: Levels of a tree, outermost first: run, model, branch, generation, artifact.
LEVELS = ("run", "model_dir", "branch_dir", "generation_dir", "artifact")


def save_tree(rows: DataFrame, root: str, artifact: str) -> None:
    """rows (LEVELS without the artifact, and their own columns) as files of the tree, one folder a context; its kind is the name's ending.

    Folders bear the level's name before their own, as Spark writes them; readers take them with it and without.  Rows are dealt by context, and a
    large one split by its size, so that the files grow with the rows and not with the tasks that made them.
    """
    kind = {"parquet": "parquet", "json": "json"}[artifact.rpartition(".")[2]]
    rows.withColumn("artifact", F.lit(artifact)).hint("rebalance", *LEVELS[:-1]).write.mode("append").partitionBy(*LEVELS).format(kind).save(root)


def levels(path: Column) -> list[Column]:
    """The levels of a file under root/run/model/branch/gen_n/artifact."""
    name = r"(?:[^/=]+=)?"
    part = rf".*/{name}(run_[^/]*)/{name}([^/]+)/{name}([^/]+)/{name}gen_(\d+)/{name}([^/]+)"
    return [F.regexp_extract(path, part, k).cast("int" if level == "generation_dir" else "string").alias(level) for k, level in enumerate(LEVELS, 1)]


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, time) of the files of a glob; none, if it matches nothing.  Contents are not read."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    except AnalysisException:
        return spark.createDataFrame([], "path string, time timestamp")
    return found.select("path", F.col("modificationTime").alias("time"))


def presence(spark: SparkSession, root: str, artifacts: list[str]) -> DataFrame:
    """Which contexts of a tree have which artifacts, by the paths of its files alone: LEVELS, one flag an artifact, and status.

    status: whole, or skipped where an artifact is missing; the caller joins only whole ones.
    """
    found = files(spark, f"{root}/*/*/*/*gen_*").select(*levels(F.col("path"))).filter("run <> ''")
    context = list(LEVELS[:-1])
    flags = [F.max((F.col("artifact") == a).cast("int")).alias(f"has_{a.partition('.')[0]}") for a in artifacts]
    out = found.groupBy(*context).agg(*flags)
    names = [f"has_{a.partition('.')[0]}" for a in artifacts]
    out = out.withColumns({n: F.col(n) == 1 for n in names})
    every = F.col(names[0])
    for n in names[1:]:
        every = every & F.col(n)
    return out.withColumn("status", F.when(every, "whole").otherwise("skipped"))


def artifact(spark: SparkSession, root: str, name: str, needed: list[str], optional: dict[str, str] | None = None) -> DataFrame:
    """The rows of an artifact of all contexts, with the levels of their files.  A needed column that is missing is an error, an optional one null.

    Levels are read from each file's path once, and joined to its rows; there are as few of them as files.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{root}/*/*/*/*gen_*/*{name}")
    require_columns(rows, needed, name)
    more = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (optional or {}).items()]
    path = F.col("_metadata.file_path").alias("_path")
    places = rows.select(path).distinct().select("_path", *levels(F.col("_path"))[:-1])
    return rows.select(*needed, *more, path).join(F.broadcast(places), "_path").drop("_path")


def processed_splits(spark: SparkSession, place: str, names: list[str], needed: list[str]) -> DataFrame:
    """The rows of processed splits (place/split=name) with their split.  A split that is missing is an error; an example in two splits, or twice in one, ends the job."""
    rows = require_columns(spark.read.parquet(place), ["split", *needed], "processed splits")
    missing = sorted(set(names) - {r["split"] for r in rows.select("split").distinct().limit(1_000).collect()})
    if missing:
        raise FileNotFoundError(f"no processed splits {missing} under {place}")
    return require_unique(rows.filter(F.col("split").isin(names)).select("split", *needed), ["example_id"], "processed splits")


JUDGEMENT = {"judge_provider": "string", "judge_model": "string", "clarity": "int", "structure": "int", "terminology": "int", "reasoning_soundness": "int", "comment": "string"}


def judged_rows(spark: SparkSession, root: str, branches: list[str], generations: list[int], needed: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Outputs of the whole contexts of a tree with their judgement (null where a row has none), question and gold answer, run and seed.

    Contexts without outputs or judgements are skipped before anything is joined.  Every run has its held-out split; a row whose example is not
    in it, a repeated example in a context and a split that repeats one end the job.  needed: columns that judgements must have; others of
    JUDGEMENT may be missing and are null.  prefix: put before the names of the judgement's columns.
    """
    names = ["model_outputs.parquet", "judge_outputs.parquet"]
    context = list(LEVELS[:-1])
    here = presence(spark, root, names).filter("status = 'whole'").select(*context)
    here = here.filter(F.col("branch_dir").isin(branches) & F.col("generation_dir").isin(generations))
    outputs = artifact(spark, root, names[0], ["run_id", "model_name", "branch", "generation", "example_id", "raw_response"])
    score = ["overall_pedagogical_score", "is_silent_error", *needed]
    judged = artifact(spark, root, names[1], ["example_id", *score], {c: k for c, k in JUDGEMENT.items() if c not in needed})
    judged = judged.withColumnsRenamed({c: f"{prefix}{c}" for c in [*score, *JUDGEMENT]})
    outputs, judged = (df.join(here, context, "left_semi") for df in (outputs, judged))
    held = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/*/*splits/*heldout_test.parquet")
    held = require_columns(held, ["example_id", "question", "answer_gold"], "heldout_test").select("example_id", "question", "answer_gold", F.regexp_extract(F.col("_metadata.file_path"), r".*/(?:[^/=]+=)?(run_[^/]*)/", 1).alias("run"))
    rows = checked_join(outputs, judged, [*context, "example_id"], "left", what="outputs and judgements")
    rows = checked_join(rows, held, ["run", "example_id"], "left", kind="m:1", what="outputs and held-out questions")
    rows = require_match(rows, "question", ["run", "example_id"], "held-out split")
    return rows.withColumn("source_seed", seed_of(F.col("run"))).drop("model_dir", "branch_dir", "generation_dir")


def reports(spark: SparkSession, root: str, name: str, fields: dict[str, tuple[str, object]]) -> tuple[DataFrame, DataFrame]:
    """JSON reports of a tree, one object a file: their fields with the levels of their files, and the files that cannot be read.

    fields: type and default of each field; an older report that lacks one gets the default, None stays null.  A damaged file is set aside with
    its text, and spoils no other.
    """
    schema = ", ".join(f"`{field}` {kind}" for field, (kind, _) in fields.items())
    reader = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).option("recursiveFileLookup", True)
    rows = written(reader.json(f"{root}/*/*/*/*gen_*/*{name}").select("*", F.col("_metadata.file_path").alias("path")), "reports")
    values = [(F.col(f) if default is None else F.coalesce(f, F.lit(default).cast(kind) if not isinstance(default, (dict, list)) else F.from_json(F.lit(json.dumps(default)), kind))).alias(f) for f, (kind, default) in fields.items()]
    place = levels(F.col("path"))[:-1]
    good = rows.filter("_corrupt IS NULL").select(*place, *values)
    return good.withColumn("seed", seed_of(F.col("run"))), rows.filter("_corrupt IS NOT NULL").select(*place, F.col("_corrupt").alias("text"))


def latest_targets(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """(place, pattern, path): for each pattern of run folders the one whose files are newest, in the order of the patterns; none where nothing matches.

    pattern: a folder's name under root with `*` for any run of characters.  Paths and times are compared in one job.
    """
    found = files(spark, f"{root}/*").select(F.regexp_extract("path", rf".*/{re.escape(root.rstrip('/').rpartition('/')[2])}/([^/]+)/", 1).alias("path"), "time").groupBy("path").agg(F.max("time").alias("time"))
    wanted = spark.createDataFrame([(k, p, "^" + re.escape(p).replace(r"\*", ".*") + "$") for k, p in enumerate(patterns)], "place int, pattern string, regex string")
    hits = found.join(F.broadcast(wanted), F.expr("path RLIKE regex"))
    return hits.groupBy("place", "pattern").agg(F.max_by("path", F.struct("time", "path")).alias("path"))
