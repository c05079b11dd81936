"""What runs leave behind: commits, the judge's cache, streams with budgets, trees of artifacts, sinks."""

from __future__ import annotations

import os
import random

import pytest
from gyre.functions import quality
from gyre.operators import dbr, numbering
from gyre.plans import exports, trees, whole
from gyre.plans import queries as q
from gyre.sources import bindings, commits, runs, sinks
from gyre.sources.shared import cleared, new_folder, run_folder
from gyre.streaming import resume
from gyre.streaming.cache import JudgeCache, actions
from pyspark.sql import functions as F

BY = ["branch", "generation"]


def rows_of(spark, branch, generation, values):
    return spark.createDataFrame([(branch, generation, v) for v in values], "branch string, generation int, v string")


def test_a_write_that_is_killed_midway_changes_nothing(spark):
    place = new_folder(spark, "commits")
    first = rows_of(spark, "a", 0, "xyz").union(rows_of(spark, "b", 1, "pq")).union(rows_of(spark, None, 2, ["n", None]))
    assert commits.read(spark, place, first.schema, BY).count() == 0
    commits.save(first, place, BY)
    # Some tasks write whole files of a context and then one fails: the job dies with files of its own left behind.
    broken = spark.range(8, numPartitions=8).select(F.lit("a").alias("branch"), F.lit(0).alias("generation"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        commits.save(broken, place, BY)
    # A driver is lost between the rows and their manifest.
    commits.write_part(rows_of(spark, "b", 1, "zz"), place, BY)
    got = sorted(map(tuple, commits.read(spark, place, first.schema, BY).collect()), key=str)
    assert got == sorted(map(tuple, first.collect()), key=str)
    commits.save(rows_of(spark, "a", 0, "w"), place, BY)
    assert sorted(map(tuple, commits.read(spark, place, first.schema, BY).collect()), key=str) == sorted([("a", 0, "w"), ("b", 1, "p"), ("b", 1, "q"), (None, 2, "n"), (None, 2, None)], key=str)
    assert {r["status"] for r in commits.verified(spark, place, first.schema, BY).collect()} == {"ok"}


def test_damaged_and_missing_contexts_are_told(spark):
    place = new_folder(spark, "commits")
    rows = rows_of(spark, "a", 0, "xyz").union(rows_of(spark, "b", 1, "pq")).union(rows_of(spark, "c", 1, "k"))
    part = commits.save(rows, place, BY).first()["part"]
    fs = spark._jvm.org.apache.hadoop.fs.Path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{place}/parts/part={part}/branch=b"), True)
    rows_of(spark, "c", 1, "k").select("v").write.mode("append").parquet(f"{place}/parts/part={part}/branch=c/generation=1")
    assert {r["branch"]: (r["status"], r["n_rows"], r["n_found"]) for r in commits.verified(spark, place, rows.schema, BY).collect()} == {"a": ("ok", 3, 3), "b": ("missing", 2, 0), "c": ("damaged", 1, 2)}


def entries(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, raw_response string, repair_actions_json string, created_at string").withColumn("extra", F.lit(1))


def test_judge_cache(spark):
    cache = JudgeCache(spark, new_folder(spark, "cache"))
    asked = spark.createDataFrame([("aa1", 1), ("aa1", 2), ("aa2", 3), ("bb1", 4), (None, 5)], "cache_key string, n int")

    def said():
        return {r["n"]: (r["hit"], r["raw_response"], r["repair_actions"]) for r in cache.get(asked).collect()}

    assert {hit for hit, _, _ in said().values()} == {False}
    cache.put(entries(spark, [("aa1", "old", None, "2024-01-01"), ("aa1", "new", '["fix", 1]', "2024-01-02"), ("aa2", "two", "", "2024-01-01"), ("bb1", "b", "[]", "2024-01-01"), (None, "x", "[]", "2024-01-01")]))
    assert said() == {1: (True, "new", ["fix", "1"]), 2: (True, "new", ["fix", "1"]), 3: (True, "two", []), 4: (True, "b", []), 5: (False, None, None)}
    cache.put(entries(spark, [("aa2", "broken", "{", "2020-01-01"), ("bb1", "later", " [] ", "2020-01-01")]))
    want = {1: (True, "new", ["fix", "1"]), 2: (True, "new", ["fix", "1"]), 3: (False, None, None), 4: (True, "later", []), 5: (False, None, None)}
    assert said() == want
    cache.compact()
    assert said() == want and commits.manifests(spark, cache.place, cache.entries().schema, []).select("number").distinct().count() == 1
    cache.put(entries(spark, [("aa2", "again", "[]", "2020-01-01")]))
    assert said()[3] == (True, "again", []) and said()[1] == want[1]
    texts = spark.createDataFrame([("[]",), ('["a"]',), ('{"a": 1}',), ("[",), ("x",), (None,)], "t string")
    assert [r["a"] for r in texts.select(actions(F.col("t")).alias("a")).collect()] == [[], ["a"], None, None, None, []]


def test_a_stream_of_three_batches_with_a_restart(spark, tmp_path):
    """Inputs are scored once for all batches, failures add up over batches, and a stream that its budget stops goes on where it stopped."""
    source, place, checkpoint = str(tmp_path / "in"), new_folder(spark, "stream"), str(tmp_path / "checkpoint")
    schema = "id int, text string"
    calls = spark.sparkContext.accumulator(0)
    broken = [True]

    def score(new):
        count = F.udf(lambda t: calls.add(1) or len(t), "int").asNondeterministic()
        return new.withColumn("score", count("text")).withColumn("bad", F.col("text").startswith("f") & F.lit(broken[0]))

    def run(budget):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        return resume.judged_stream(stream, place, checkpoint, score, ["id"], ["text"], ["score"], F.col("bad"), budget)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)

    def done():
        return {r["id"]: r["score"] for r in spark.read.parquet(f"{place}/results").collect()}

    arrive([(1, "aa"), (2, "aa"), (3, "f1"), (4, "ccc")])
    run(2).awaitTermination()
    assert done() == {1: 2, 2: 2, 4: 3} and calls.value == 3
    arrive([(1, "aa"), (5, "aa"), (6, "f2"), (7, "f3"), (8, "dddd")])
    with pytest.raises(Exception, match="more than 2 failed rows"):
        run(2).awaitTermination()
    assert sorted(r["id"] for r in resume.open_failures(spark, place, ["id"]).collect()) == [3, 6, 7]
    tried = calls.value
    assert tried == 3 + 3  # aa was known
    broken[0] = False  # the judge is back: the batch that was stopped is done again, and its failures succeed
    arrive([(3, "f1"), (9, "aa"), (10, "dddd"), (6, "f2")])
    run(2).awaitTermination()
    assert done() == {1: 2, 2: 2, 3: 2, 4: 3, 5: 2, 6: 2, 7: 2, 8: 4, 9: 2, 10: 4}
    assert resume.open_failures(spark, place, ["id"]).count() == 0
    assert calls.value == tried + 3 + 1  # f2, f3 and dddd once more with their batch, then f1; all else was known
    assert spark.read.parquet(f"{place}/scores").groupBy("input_key").count().filter("count > 1").count() == 0


def small_tree(spark, drop=(), twice=False, lost=False):
    root = runs.new_tree(spark)
    rows = spark.createDataFrame([(f"run_x_seed{s}", "m", b, f"gen_{g}", f"e{i}") for s in (1, 2) for b in ("p", "d") for g in (0, 1) for i in range(3)], "run string, model_dir string, branch_dir string, generation_dir string, example_id string")
    outputs = rows.select("*", F.lit("r").alias("run_id"), F.lit("m").alias("model_name"), F.col("branch_dir").alias("branch"), F.lit(0).alias("generation"), F.lit("said").alias("raw_response"))
    judged = rows.select("*", F.lit(5).alias("overall_pedagogical_score"), F.lit(False).alias("is_silent_error"), F.lit("c").alias("comment")).filter("NOT (branch_dir = 'd' AND generation_dir = 'gen_1' AND run = 'run_x_seed2') AND NOT (branch_dir = 'p' AND example_id = 'e0')")
    runs.save_tree(outputs.drop(*drop), root, "model_outputs.parquet")
    runs.save_tree(judged.union(judged.filter("example_id = 'e1'")) if twice else judged, root, "judge_outputs.parquet")
    held = rows.select("run", "example_id").distinct().filter("example_id <> 'e2'" if lost else "true")
    held.select("run", F.lit("s").alias("kind"), F.lit("heldout_test.parquet").alias("artifact"), "example_id", F.lit("q").alias("question"), F.lit("1").alias("answer_gold")).withColumn("kind", F.lit("splits")).write.mode("append").partitionBy("run", "kind", "artifact").parquet(root)
    return root


def test_rows_of_whole_contexts(spark):
    root = small_tree(spark)
    found = {(r["run"], r["branch_dir"], r["generation_dir"]): r["status"] for r in runs.presence(spark, root, ["model_outputs.parquet", "judge_outputs.parquet"]).collect()}
    assert len(found) == 8 and [k for k, v in found.items() if v == "skipped"] == [("run_x_seed2", "d", 1)]
    rows = runs.judged_rows(spark, root, ["p", "d"], [1], needed=("comment",)).collect()
    assert len(rows) == 9 and sum(r["overall_pedagogical_score"] is None for r in rows) == 2
    assert {(r["source_seed"], r["judge_model"], r["question"]) for r in rows} == {(1, None, "q"), (2, None, "q")}
    with pytest.raises(ValueError, match="judge_model"):
        runs.judged_rows(spark, root, ["p"], [1], needed=("judge_model",))


def test_trees_that_break_a_contract(spark):
    with pytest.raises(ValueError, match="raw_response"):
        runs.judged_rows(spark, small_tree(spark, drop=("raw_response",)), ["p"], [1])
    with pytest.raises(Exception, match="right side of outputs and judgements repeats keys"):
        runs.judged_rows(spark, small_tree(spark, twice=True), ["p", "d"], [0, 1]).collect()
    with pytest.raises(Exception, match="held-out split misses keys"):
        runs.judged_rows(spark, small_tree(spark, lost=True), ["p", "d"], [0, 1]).collect()


def test_plain_and_named_folders_are_read_alike(spark):
    paths = ["file:/x/run_a_seed3/m/b/gen_12/outputs.parquet", "file:/x/run=run_a_seed3/model_dir=m/branch_dir=b/generation_dir=gen_12/artifact=outputs.parquet/part-0.parquet"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select(*runs.levels(F.col("path")))
    assert [tuple(r) for r in df.collect()] == [("run_a_seed3", "m", "b", 12, "outputs.parquet")] * 2
    assert runs.files(spark, f"{run_folder(spark)}/no-such-*").count() == 0


def test_a_replayed_selection_keeps_its_budgets_and_a_planted_row_does_not(spark, sf_dir):
    budgets = dbr.Budgets(ratio=0.6)
    rows = dbr.flagged(q._policy_rows(spark, sf_dir))
    decided = rows.join(dbr.dbr(rows, q.CTX, budgets), [*q.CTX, "example_id"]).withColumn("phase", dbr.phase_of(F.col("decision_reason")))
    decided = decided.select(*q.CTX, "example_id", "selection_rank", "phase", *[f"defect_{n}" for n in quality.DEFECTS]).cache()
    found = dbr.budget_checks(decided, q.CTX, budgets).collect()
    assert {r["status"] for r in found} == {"ok"} and {r["phase"] for r in found} > {0}
    last = decided.filter("selection_rank IS NOT NULL").orderBy("phase", F.desc("selection_rank")).first()
    planted = decided.withColumn("defect_parse_failure", F.col("defect_parse_failure") | (F.col("example_id") == last["example_id"]))
    wrong = [r for r in dbr.budget_checks(planted, q.CTX, budgets).collect() if r["status"] == "violation"]
    assert [(r["defect"], r["n_beyond"], r["limit"], r["reached"]) for r in wrong] == [("parse_failure", 1, 0, 1)]
    assert dbr.budget_checks(decided.limit(0), q.CTX, budgets).count() == 0


def test_numbers_of_a_table(spark):
    values = [random.Random(4).randrange(50) for _ in range(500)] + [None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    rows = sorted(numbering.numbered(df, ["v", F.desc("i")]).collect(), key=lambda r: r["number"])
    assert [r["number"] for r in rows] == list(range(501))
    assert [(r["v"], r["i"]) for r in rows] == sorted(((v, i) for i, v in enumerate(values)), key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert numbering.numbered(df.limit(0), ["v"]).count() == 0


def test_sinks_and_scans(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.save_jsonl(rows, str(tmp_path / "lines"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "lines")).select("k", "v").collect()), key=str) == [(1, "a"), (2, None)]
    for n, text in enumerate(['{"a": 1,\n "b": "x"}', '{"a": 2}']):
        (tmp_path / f"report{n}.json").write_text(text)
    assert sorted(map(tuple, sinks.scan_reports(spark, str(tmp_path / "report*.json"), "a int, b string").collect())) == [(1, "x"), (2, None)]
    for name, at in (("old", 1_000), ("new", 2_000), ("older", 500)):
        (tmp_path / f"{name}.bin").write_bytes(b"x")
        os.utime(tmp_path / f"{name}.bin", (at, at))
    assert sinks.latest_file(spark, str(tmp_path / "*.bin")).first()["path"].endswith("/new.bin")


def test_a_report_derives_its_inputs_once(spark, sf_dir, tmp_path):
    """No table of a whole report scans the orders again, and all of them are written as CSV and Parquet under their names."""
    rows = whole.inputs(spark, sf_dir)
    tables = exports.pvf_report(*rows)
    assert len(tables) == 7 and not [f for df in [*rows, *tables.values()] for f in df.inputFiles() if "orders" in f]
    exports.export(tables, str(tmp_path / "report"))
    for name, df in tables.items():
        kept = spark.read.parquet(str(tmp_path / "report" / name / "parquet"))
        lines = spark.read.option("header", True).csv(str(tmp_path / "report" / name / "csv"))
        assert kept.count() == lines.count() == df.count() > 0 and kept.columns == lines.columns == df.columns


def test_trees_go_with_the_run(spark, sf_dir):
    root = runs.new_tree(spark)
    assert root.startswith(run_folder(spark))
    assert trees and bindings and exports and cleared
