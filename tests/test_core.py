"""The library's own operators: fixtures with known results, and the SQL comparison on sf0.001."""

from __future__ import annotations

import glob
import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from gyre import catalog
from gyre.functions import answers, judge_json, quality
from gyre.operators import checks, dbr, judges, metrics, policies, sampling
from gyre.sources import runs, sinks
from gyre.streaming import resume
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return None if value is pd.NA else value


#: Characters of an optimised plan.
LARGE_PLAN = 150_000


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    # A filter on derived columns that is pushed down copies them again and again, which no result shows.
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < LARGE_PLAN
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    want = [tuple(plain(v) for v in row) for row in cursor.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


EXTRACTION = [
    ("Reasoning...\nFinal answer: 42", "42", None),
    ("We get \\boxed{42}.", "42", None),
    ("The answer is 3.50", "3.50", None),
    ("Answer: 3/4", "3/4", None),
    ("Final answer: ( 42 ).", "42", None),
    ("Final answer: 41\nActually, Final answer: 42", None, "multiple_candidate_answers"),
    ("I cannot tell", None, "no_numeric_candidate"),
    ("  \n", None, "empty_output"),
    (None, None, "empty_output"),
    ("about 1,234", "1", None),
    ("x\r\n.5\r\n", "5", None),
    ("\nAnswer: 5\nanswer: 7", None, "multiple_candidate_answers"),
    ("it is -5", "-5", None),
    ("3 / 4 of it", "3/4", None),
]


def test_extraction(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(EXTRACTION)], "i int, t string").select("i", answers.extract(F.col("t")).alias("e")).collect()
    assert [(EXTRACTION[r["i"]][0], r["e"]["token"], r["e"]["failure"]) for r in sorted(rows)] == EXTRACTION


SCORING = [("1.0", "1", "correct"), ("0.75", "3/4", "correct"), ("6", None, "gold_parse_failure"), (None, "6", "prediction_parse_failure"), ("1.5/2", "1", "prediction_parse_failure"), ("3/0", "1", "prediction_parse_failure"), ("6/8", "-3/-4", "correct"), ("+5", "5", "correct"), ("-0", "0", "correct"), ("1", "2", "incorrect"), ("1" + "0" * 30, "1" + "0" * 30 + ".00", "correct"), ("9" * 25, "9" * 24 + "8", "incorrect")]


def test_exact_comparison(spark):
    rows = spark.createDataFrame(SCORING, "a string, b string, want string").select("a", "b", "want", answers.label(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r["a"], r["b"], r["got"]) for r in rows] == [(r["a"], r["b"], r["want"]) for r in rows]


def test_judge_payloads(spark):
    good = '{"clarity": 1, "structure": "2", "terminology": 0.0, "reasoning_soundness": 1, "overall_pedagogical_score": 4, "is_silent_error": "false", "comment": "a } b"}'
    cases = [
        (good, "direct", None), ("```json\n" + good + "\n```", "embedded", None), ("so " + good + " ok", "embedded", None), (good[:-2], "truncated", None),
        (good.replace('"clarity": 1, ', ""), "direct", "missing_keys"), (good.replace('"clarity": 1', '"clarity": 3'), "direct", "out_of_range"),
        (good.replace('"clarity": 1', '"clarity": "x"'), "direct", "wrong_type"), (good.replace("{", '{"type": "object", ', 1), "direct", None),
        (good.replace("{", '{"more": 1, ', 1), "direct", "unknown_keys"), ("", None, "no_json_object"), (None, None, "no_json_object"), (good[:40], None, "no_json_object"),
        (good.replace(": 4", ": 7"), "direct", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", judge_json.json_object(F.col("t")).alias("o")).select("i", "o.found", judge_json.judge_payload(F.col("o.body")).alias("p"))
    for r in df.collect():
        assert (r["found"], r["p"]["error"]) == cases[r["i"]][1:]
        assert r["p"]["error"] or (r["p"]["overall_pedagogical_score"], r["p"]["is_silent_error"]) == (4, False)
    pairs = [('{"winner": "tie", "confidence": 2, "reason": "x"}', None), ('{"winner": "C", "confidence": 2, "reason": "x"}', "bad_winner"), ('{"winner": "A", "confidence": 3, "reason": "x"}', "bad_confidence"), ('{"winner": "a", "confidence": "1", "reason": " "}', "blank_reason")]
    got = spark.createDataFrame(pairs, "t string, want string").select("want", judge_json.pair_payload(F.col("t")).alias("p")).collect()
    assert [r["p"]["error"] for r in got] == [r["want"] for r in got]


def slow_dbr(bins, flags, budgets):
    """The rounds as described, with a rescan for each pick."""
    n = len(bins)
    target = min(max(round(n * budgets.ratio), 1), n)
    limits = {name: int(budgets.rates[name] * target) for name in quality.DEFECTS}
    totals = {name: int(flags[:, k].sum()) for k, name in enumerate(quality.DEFECTS)}
    chosen = []

    def fits(i):
        if flags[i, 0]:
            return False
        return all(sum(flags[j, k] for j in chosen) + flags[i, k] <= limits[name] for k, name in enumerate(quality.DEFECTS) if name != "parse_failure")

    def sweep():
        while len(chosen) < target:
            before = len(chosen)
            for b in range(3):
                for i in range(n):
                    if bins[i] == b and i not in chosen and fits(i):
                        chosen.append(i)
                        break
            if len(chosen) == before:
                break

    sweep()
    for name in dbr.RELAX[:-1]:
        if len(chosen) >= target:
            break
        if limits[name] < totals[name]:
            limits[name] = totals[name]
            sweep()
    return chosen


def by_blocks(bins, flags, budgets, size, known):
    """Rank and phase of rows by closing steps over blocks of `size` rows; known: whether their flags are there from the beginning."""
    number = flags @ (1 << np.arange(5))
    own = [np.flatnonzero(bins == b) for b in range(3)]
    blocks = [[number[rows[at : at + size]] for at in range(0, len(rows), size)] for rows in own]
    have, asked = {(b, at) for b in range(3) for at in range(len(blocks[b])) if known}, 0
    while True:
        try:
            parts = [dbr.Bin(b, np.array([np.bincount(f, minlength=32) for f in blocks[b]]), {at: f for at, f in enumerate(blocks[b]) if (b, at) in have}) for b in range(3)]
            steps, met = dbr.chosen(parts, budgets)
            break
        except dbr.Wanted as wanted:
            assert set(wanted.blocks) - have
            have, asked = have | set(wanted.blocks), asked + 1
    rank, phase = np.zeros(len(bins), int), np.zeros(len(bins), int)
    for b in range(3):
        for at, f in enumerate(blocks[b]):
            mine = own[b][at * size : (at + 1) * size]
            rank[mine], phase[mine] = dbr.places_of(f, b, [s for s in steps if (s["bin"], s["block"]) == (b, at)])
    return rank, phase, met, asked, len(have)


@pytest.mark.parametrize(("size", "known"), [(1, True), (3, False), (4, True), (50, False)])
def test_closing_steps_match_a_rescan(size, known):
    rng = np.random.default_rng(size)
    for _ in range(40):
        n = int(rng.integers(1, 25))
        bins, flags = rng.integers(0, 3, n), (rng.random((n, 5)) < 0.3).astype(int)
        for ratio in (1.0, 0.5, 0.2):
            budgets = dbr.Budgets(ratio=ratio)
            rank = by_blocks(bins, flags, budgets, size, known)[0]
            assert [int(i) for i in np.argsort(np.where(rank > 0, rank, 999), kind="stable")[: (rank > 0).sum()]] == slow_dbr(bins, flags, budgets)


def test_closing_steps_ask_for_few_blocks():
    """A context of a million rows is solved from counts and a few blocks of flags, in as many askings as there are steps."""
    rng = np.random.default_rng(9)
    bins, flags = rng.integers(0, 3, 1_000_000), (rng.random((1_000_000, 5)) < [0.05, 0.2, 0.4, 0.3, 0.2]).astype(int)
    rank, phase, met, asked, have = by_blocks(bins, flags, dbr.Budgets(ratio=0.6), 1_000, False)
    assert met and 600_000 <= (n := (rank > 0).sum()) < 600_003 and sorted(rank[rank > 0]) == list(range(1, n + 1))
    assert not flags[rank > 0, 0].any() and asked < 60 and have < 200


def test_dbr_does_not_depend_on_row_order(spark, sf_dir):
    from gyre.plans import queries as q

    rows = dbr.flagged(q._policy_rows(spark, sf_dir))
    budgets = dbr.Budgets(ratio=0.5)
    one, two = (sorted(dbr.dbr(r, q.CTX, budgets).collect(), key=str) for r in (rows, rows.orderBy(F.rand(3)).repartition(7)))
    assert one == two and {r["decision_reason"] for r in one} > {"selected_within_budget"}
    small = sorted(dbr.dbr(rows, q.CTX, budgets, block=2, whole=1).collect(), key=str)
    assert one == small and dbr.dbr(rows.limit(0), q.CTX).count() == 0
    by = {}
    for r in rows.collect():
        by.setdefault(tuple(r[c] for c in q.CTX), []).append(r)
    down = lambda v: (v is None, -v if v is not None else 0)
    for context, members in by.items():
        members.sort(key=lambda r: (dbr.BINS.index(r["length_bin"]), r["severity"], down(r["reasoning_soundness"]), down(r["structure"]), down(r["clarity"]), r["sampling_value"], r["example_id"]))
        chosen = slow_dbr([dbr.BINS.index(r["length_bin"]) for r in members], np.array([[int(r[f"defect_{n}"]) for n in quality.DEFECTS] for r in members]), budgets)
        got = sorted((r["selection_rank"], r["example_id"]) for r in one if tuple(r[c] for c in q.CTX) == context and r["selected"])
        assert got == [(k, members[i]["example_id"]) for k, i in enumerate(chosen, 1)]


def jobs_of(spark, work):
    """What work() returns, and the number of jobs it runs."""
    group = f"count-{id(work)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    twice = a.unionByName(a.filter("k = 2"))
    broken = checks.checked_join(a, twice.withColumnRenamed("v", "w"), ["k"], what="outputs and gold")
    with pytest.raises(Exception, match=r'right side of outputs and gold repeats keys, such as \{"k":2\}'):
        broken.collect()
    with pytest.raises(Exception, match="left side of join repeats keys"):
        checks.checked_join(twice, a.withColumnRenamed("v", "w"), ["k"]).collect()
    assert checks.checked_join(twice, a.withColumnRenamed("v", "w"), ["k"], kind="m:1").count() == 3
    with pytest.raises(Exception, match="held-out split misses keys, such as"):
        checks.require_match(a.join(a.filter("k = 1").select("k", F.lit(1).alias("found")), "k", "left"), "found", ["k"], "held-out split").collect()
    with pytest.raises(checks.ContractError):
        checks.require_columns(a, ["k", "z"], "a")


def test_a_contract_costs_no_job_and_no_scan_of_its_own(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        left, right = orders.select("o_orderkey", "o_custkey"), orders.select("o_orderkey", "o_orderstatus")
        plain, checked = left.join(right, ["o_orderkey"]), checks.checked_join(left, right, ["o_orderkey"])
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (plain, checked)]
        assert [p.count("Exchange hash") for p in plans] == [2, 2] and [p.count("FileScan") for p in plans] == [2, 2]
        (one, n_plain), (two, n_checked) = (jobs_of(spark, lambda df=df: df.collect()) for df in (plain, checked))
        assert sorted(one) == sorted(two) and n_plain == n_checked == 1, (n_plain, n_checked)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 1, 1.0), ("b", 2, 3.0)], "g string, seed int, value double")
    rows = {r["g"]: r for r in metrics.spread(df, ["g"]).collect()}
    assert (rows["a"]["std"], rows["a"]["ci_low"], rows["a"]["n_seeds"]) == (0.0, 2.0, 1)
    assert math.isclose(rows["b"]["ci_high"], 2 + 1.96 * math.sqrt(2) / math.sqrt(2))
    assert df.groupBy("g").agg(metrics.correlation(F.col("seed"), F.col("value")).alias("r")).filter("r IS NOT NULL").count() == 0
    assert metrics.bootstrap(df, ["g"], 50).filter("g = 'a' AND boot_low = 2 AND boot_high = 2").count() == 1
    assert metrics.spread(df.limit(0), ["g"]).count() == 0


def test_soft_weights_of_the_fixture(spark):
    rows = [("pf", False, False, True, 6), ("silent", True, True, True, 6), ("high_corr", True, False, True, 6), ("med_high", True, False, True, 4), ("med_low", True, False, True, 2), ("low_corr", True, False, True, 1), ("inc_high", True, False, False, 5), ("inc_low", True, False, False, 1)]
    df = spark.createDataFrame(rows, "id string, pred_parse_success boolean, silent boolean, correct boolean, overall_pedagogical_score int")
    df = df.withColumns({"has_accuracy": F.lit(True), "has_judge": F.lit(True), "seed": F.lit(1), "branch": F.lit("b"), "generation": F.lit(0), "example_id": F.col("id")})
    want = {"soft_pvf_medium": [0, 0, 1, 0.5, 0.25, 0.25, 0.1, 0.1], "soft_pvf_lenient": [0, 0, 1, 0.75, 0.5, 0.25, 0.25, 0.1], "soft_pvf_noisy_keep": [0, 0, 1, 0.75, 0.5, 0.5, 0.25, 0.1], "soft_pvf_silent_only": [0, 0, 1, 1, 1, 1, 1, 1]}
    for policy, weights in want.items():
        got = {r["id"]: r["assigned_weight"] for r in policies.soft_pvf(df, policy).collect()}
        assert [got[r[0]] for r in rows] == weights


def test_upsert_stream_resumes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(10).withColumn("v", F.col("id") * 2)

    def run():
        resume.upsert_stream(spark.readStream.schema(df.schema).parquet(source), lambda d: d.withColumn("w", F.col("v") + 1), out, str(tmp_path / "state"), ["id"]).awaitTermination(60)
        return sorted(r["id"] for r in resume.finished(spark, out).collect())

    df.filter("id < 6").write.mode("append").parquet(source)
    assert run() == list(range(6))
    df.filter("id >= 4").write.mode("append").parquet(source)
    assert run() == list(range(10))
    with pytest.raises(resume.TooManyFailures):
        resume.check_failures(F.col("id") > 3, df, 5)


def test_run_trees_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(g, b, i) for g, b, i in itertools.product(range(2), ("pure", "dbr"), range(3))], "generation int, branch string, example int")
    for g, b in itertools.product(range(2), ("pure", "dbr")):
        df.filter((F.col("generation") == g) & (F.col("branch") == b)).select("example").write.parquet(f"{tmp_path}/run/m/{b}/gen_{g}/eval_merged.parquet")
    got = sinks.scan_runs(spark, f"{tmp_path}/run/*/*/gen_*/eval_merged.parquet").groupBy("branch_dir", "generation_dir").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [("dbr", 0, 3), ("dbr", 1, 3), ("pure", 0, 3), ("pure", 1, 3)]
    sinks.save_tabular(df, f"{tmp_path}/both")
    sinks.save_context(df, f"{tmp_path}/ctx", ["branch", "generation"])
    assert spark.read.parquet(f"{tmp_path}/both/parquet").count() == spark.read.option("header", True).csv(f"{tmp_path}/both/csv").count() == spark.read.parquet(f"{tmp_path}/ctx").count() == 12


def test_two_judges_and_their_conclusions(spark):
    rows = [(1, 1, "pure", 1, 4, True, 6, True), (2, 1, "pure", 1, 6, False, 4, True), (3, 1, "anchor", 1, 8, False, 3, False), (4, 2, "pure", 1, 2, False, 2, False), (5, 1, "anchor", 0, 0, True, 8, True)]
    first = spark.createDataFrame([r[:6] for r in rows], "id int, seed int, branch string, generation int, score int, silent boolean")
    second = spark.createDataFrame([(r[0], r[6], r[7]) for r in rows] + [(9, 1, True)], "id int, score int, silent boolean")
    both = judges.compared_scores(first, second, ["id"], "score", "silent")
    assert {r["id"]: (r["score_delta"], r["silent_agreement"]) for r in both.collect()} == {1: (2, True), 2: (-2, False), 3: (-5, True), 4: (0, True), 5: (8, True)}
    out = judges.sensitivity_summary(both, "pure", "anchor").first()
    assert (out["n_examples"], out["old_delta"], out["new_delta"], out["conclusion_changed"]) == (5, 4.0, -1.0, True)
    (seed,) = judges.seed_summary(both, "pure", "anchor").collect()  # seed 2 has no anchor
    assert (seed["seed"], seed["n"], seed["old_delta"], seed["conclusion_changed"]) == (1, 3, 3.0, True)
    empty = judges.sensitivity_summary(both.filter("generation = 7"), "pure", "anchor").first()
    assert empty["n_examples"] == 0 and empty["old_delta"] is None and empty["conclusion_changed"] is None
    pairs = spark.createDataFrame([(1, 1, "A", "anchor"), (2, 1, "B", "anchor"), (3, 2, "A", "pure"), (4, 2, "Tie", "Tie")], "pair_id int, seed int, winner string, winner_branch string")
    pairs = pairs.withColumns({f"{b}_win": F.col("winner_branch") == b for b in ("pure", "anchor")})
    same = judges.pair_summary(judges.compared_pairs(pairs, pairs.filter("pair_id < 4"), ["pair_id", "seed"]), "pure", "anchor", []).first()
    assert (same["n_pairs"], same["agree_raw_rate"], same["conclusion_changed"]) == (3, 1.0, False)
    scores = spark.createDataFrame([(1, -0.5), (2, None)], "seed int, delta double")
    out = {r["seed"]: (r["conclusion"], r["score_conclusion"], r["changed"]) for r in judges.margin_summary(pairs, scores, "pure", "anchor", ("pure", "anchor"), ["seed"]).collect()}
    assert out == {1: ("anchor_preferred", "pure_preferred", True), 2: ("pure_preferred", "unknown", None)}


def test_cells_fill_gaps_of_others(spark):
    rows = spark.createDataFrame([(i, "a" if i < 2 else "b", "xyz"[i % 3]) for i in range(30)], "id int, cell string, bucket string")
    out = sampling.balanced_cells(rows, ["cell"], "bucket", ["x", "y", "z"], 11, "id").collect()
    assert len(out) == 11 and sum(r["cell"] == "a" for r in out) == 2
    assert sampling.balanced_cells(rows, ["cell"], "bucket", ["x", "y", "z"], 99, "id").count() == 30
    assert sampling.balanced_cells(rows.limit(0), ["cell"], "bucket", ["x"], 9, "id").count() == 0


def test_deltas_of_all_pairs(spark):
    rows = spark.createDataFrame([("r", 0, 1.0), ("r", 2, 4.0), ("r", 1, None), ("s", 0, 1.0)], "run string, generation int, m double")
    got = {(r["from_generation"], r["to_generation"]): r["delta_m"] for r in metrics.generation_deltas(rows, ["run"], ["m"]).collect()}
    assert got == {(0, 1): None, (0, 2): 3.0, (1, 2): None}
    ties = spark.createDataFrame([("r", 10, "a", 1.0), ("r", 10, "b", 3.0)], "run string, ratio int, branch string, m double")
    assert [tuple(r) for r in metrics.ordered_pairs(ties, ["run"], ["ratio", "branch"], "ratio", ["m"]).collect()] == [("r", 10, 10, 2.0)]


def test_objects_are_cut_out_of_replies():
    keys = "".join(f'"{k}": 1, ' for k in judge_json.KEYS)
    for text, want in [
        ('{"a": "}"}', ('{"a": "}"}', "direct")), ('x {"a": {"b": "\\"}"}} y', ('{"a": {"b": "\\"}"}}', "embedded")), ("no", (None, None)), (None, (None, None)),
        ('{"a": 1', (None, None)), ("{" + keys + '"c": "open', ("{" + keys + '"c": "open"}', "truncated")), ("{" + keys + '"c": "es\\"', ("{" + keys + '"c": "es\\""}', "truncated")), ('"{" {}', ('{" {}', None)),
    ]:
        got = judge_json.balanced_object(text)
        assert got == want or (want[1] is None and got == (None, None))


def test_run_trees(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runs.summaries(spark, str(tmp_path))
    row = spark.createDataFrame([("m", "b", 0, 5, 0.5, 1.0, 0.0)], "model_name string, branch string, generation int, sample_count long, accuracy_mean double, pedagogical_score_mean double, silent_error_rate double")
    row.write.option("header", True).csv(f"{tmp_path}/run_a_seed7/tables/summary.csv")
    row.withColumn("accuracy_mean", F.lit(0.1)).write.parquet(f"{tmp_path}/run_a_seed7/tables/summary.parquet")
    row.write.parquet(f"{tmp_path}/run_b/tables/summary.parquet")
    got = {r["run"]: (r["accuracy_mean_effective"], r["accuracy_source"], r["sample_count"]) for r in runs.summaries(spark, str(tmp_path)).collect()}
    assert got == {"run_a_seed7": (0.5, "raw_summary", 5), "run_b": (0.5, "raw_summary", 5)}
    row.write.option("header", True).csv(f"{tmp_path}/run_c/tables/summary_corrected.csv")
    with pytest.raises(ValueError):
        runs.summaries(spark, str(tmp_path))
    assert [r["s"] for r in spark.createDataFrame([("run_seed12_x",), ("none",)], "r string").select(runs.seed_of(F.col("r")).alias("s")).collect()] == [12, None]
