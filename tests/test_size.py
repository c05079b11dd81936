"""Tasks, files and passes do not grow with the table, and distinct inputs are derived once."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from gyre import catalog
from gyre.operators import dbr
from gyre.plans import exports
from gyre.plans import queries as q
from gyre.sources import bindings, runs, shared, tables
from pyspark.sql import functions as F


def same(a, b) -> bool:
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_large_table_of_few_partitions_has_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    assert tables.dealt(spark.range(2_050).coalesce(1), "id").rdd.getNumPartitions() == 21
    assert tables.dealt(spark.range(2).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_blocks_of_a_selection_have_more_tasks(spark, sf_dir, monkeypatch):
    rows = q.dbr.flagged(q._policy_rows(spark, sf_dir))
    want = dbr.dbr(rows, q.CTX, dbr.Budgets(ratio=0.6), block=16)
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    seen, blocks = [], dbr._blocks
    monkeypatch.setattr(dbr, "_blocks", lambda *a: seen.append(out := blocks(*a)) or out)
    got = dbr.dbr(rows, q.CTX, dbr.Budgets(ratio=0.6), block=16)
    assert seen[0].rdd.getNumPartitions() >= 10 and same(want, got)


def test_inputs_are_derived_once_or_in_place_alike(spark, sf_dir, monkeypatch):
    for shared_ids in (False, True):
        monkeypatch.setattr(bindings, "INPUT_BYTES", 64 << 20)
        once = bindings.evaluated(spark, sf_dir, shared_ids, keep_missing=True)
        assert "sha2" not in once._jdf.queryExecution().optimizedPlan().toString()
        monkeypatch.setattr(bindings, "INPUT_BYTES", 0)
        each = bindings.evaluated(spark, sf_dir, shared_ids, keep_missing=True)
        assert "sha2" in each._jdf.queryExecution().optimizedPlan().toString()
        assert once.dtypes == each.dtypes and same(once, each)


def test_null_inputs_are_derived_too(spark):
    rows = spark.createDataFrame([(1, "q", "42", None), (2, None, "42", "42"), (3, "q", "42", None), (4, "q", None, "so 42")], "order_id long, question string, answer_gold string, raw_response string")
    got, want = bindings.derived_once(rows, rows, bindings.INPUTS, bindings.values), bindings.values(rows)
    assert got.count() == 4 and same(got, want)
    empty = rows.filter("order_id > 9")
    assert bindings.derived_once(empty, empty, bindings.INPUTS, bindings.values).isEmpty()


def test_files_of_a_tree_do_not_grow_with_the_tasks(spark):
    root = runs.new_tree(spark)
    rows = spark.range(0, 4_000, 1, 16).select(F.concat(F.lit("run_seed"), F.col("id") % 2).alias("run"), F.lit("m").alias("model_dir"), F.lit("b").alias("branch_dir"), F.concat(F.lit("gen_"), F.col("id") % 3).alias("generation_dir"), F.col("id").alias("example_id"))
    runs.save_tree(rows, root, "x.parquet")
    assert len(glob.glob(f"{root.removeprefix('file://')}/**/*.parquet", recursive=True)) == 6 + 6  # a folder's name ends so too
    found = runs.artifact(spark, root, "x.parquet", ["example_id"])
    assert same(found, rows.withColumn("generation_dir", F.substring("generation_dir", 5, 9).cast("int")))
    assert "regexp_extract" not in found._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate")[0]


def test_levels_are_measured_once(spark, sf_dir, monkeypatch):
    """Every table of a series reads the written levels, and a bundle has one series."""
    calls, level = [], exports.run_level
    monkeypatch.setattr(exports, "run_level", lambda rows: calls.append(1) or level(rows))
    plan = catalog.queries()["i03_baseline_series"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "is_correct" not in plan and "place" not in plan
    plan = catalog.queries()["i04_mode_comparison"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "is_correct" not in plan
    calls.clear()
    catalog.queries()["i21_bundle"](spark, sf_dir)
    assert len(calls) == 1


def longest_tables(spark, monkeypatch, name: str, sf_dir: str) -> int:
    """Rows of the largest file that the query writes before its result: a task writes a file."""
    places, new_folder = [], shared.new_folder
    monkeypatch.setattr(shared, "new_folder", lambda *a: places.append(out := new_folder(*a)) or out)
    catalog.queries()[name](spark, sf_dir)
    files = [f for place in places for f in glob.glob(f"{place.removeprefix('file://')}/**/*.parquet", recursive=True) if os.path.isfile(f)]
    return max(pq.read_metadata(f).num_rows for f in files)


@pytest.mark.parametrize("name", ["c03_dbr_ranked", "i07_pvf_confirmatory"])
def test_no_task_of_a_report_grows_with_the_table(spark, tmp_path, monkeypatch, name):
    """Rows are dealt by a hash, and ranges are sampled, so tasks are even only about."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    n = orders.count()
    for times in (4, 16):
        more = orders.crossJoin(spark.range(times)).withColumns({"o_orderkey": F.col("o_orderkey") + F.col("id") * 150_000, "o_custkey": F.col("o_custkey") + F.col("id") * 15_000})
        more.drop("id").coalesce(1).write.parquet(str(tmp_path / f"x{times}" / "orders.parquet"))
    monkeypatch.setattr(tables, "ROWS_A_TASK", n // 2, raising=False)
    small, large = (longest_tables(spark, monkeypatch, name, str(tmp_path / f"x{times}")) for times in (4, 16))
    assert large < 1.5 * small and large < 2 * n, (small, large, n)


@pytest.mark.parametrize("name", ["c03_dbr_ranked", "i07_pvf_confirmatory"])
def test_no_task_of_a_report_is_large_where_rows_derive_their_own(spark, sf_dir, monkeypatch, name):
    """Where distinct inputs might not fit, the heavy work is done in each row, in tasks of about ROWS_A_TASK rows."""
    monkeypatch.setattr(bindings, "INPUT_BYTES", 0, raising=False)
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100, raising=False)
    assert longest_tables(spark, monkeypatch, name, sf_dir) < 200
