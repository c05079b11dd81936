"""Rows are dealt by their number, and each value of a row is computed once."""

import hashlib

from gyre.functions import answers, hashing
from gyre.sources import tables
from pyspark.sql import functions as F


def test_large_tables_have_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    rows = spark.range(0, 2_050, 1, 8)
    assert tables.spread(rows, "id").rdd.getNumPartitions() == 21
    assert tables.spread(rows.limit(700).repartition(8), "id").rdd.getNumPartitions() == 8
    assert tables.spread(rows.coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def operations(column) -> int:
    return str(column).upper().count("RLIKE") + str(column).lower().count("regexp_")


def test_values_of_a_row_are_computed_once(spark):
    """Each regular expression of an answer's value stands once in its column."""
    assert operations(answers.label(F.col("a"), F.col("b"))) <= 20 and operations(answers.clean(F.col("a"))) == 1 and operations(answers.numeric_token(F.col("a"))) == 2


def test_short_forms_of_answers_and_judgements(spark):
    rows = [("( '.", "'"), ("  \"(3/4).\" ", "3/4"), (" (x)]'\t", "x"), (". .", ""), ("(.( ", ".")]
    got = spark.createDataFrame(rows, "t string, want string").select(answers.clean(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in got if r["got"] != r["want"]] == [], got
    texts = [("q", "g", str(n)) for n in range(300)]
    judged = spark.createDataFrame(texts, "q string, g string, r string").select("r", hashing.mock_judgement(F.col("q"), F.col("g"), F.col("r")).alias("j")).select("r", "j.*").collect()
    for row in judged:
        h = int(hashlib.sha256(f"q\ng\n{row['r']}".encode()).hexdigest(), 16)
        assert [row["clarity"], row["structure"], row["terminology"], row["reasoning_soundness"]] == [(h >> s) % 3 for s in (0, 2, 4, 6)] and row["is_silent_error"] == (h % 7 == 0)
