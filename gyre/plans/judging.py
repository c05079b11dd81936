"""Queries on a second judge: samples, comparisons and summaries of scores and of pairs, and audits of the whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.functions import hashing, quality
from gyre.operators import checks, judges, metrics, sampling
from gyre.plans import queries as q
from gyre.plans import reports
from gyre.sources import bindings
from gyre.sources.shared import written

CTX = bindings.CONTEXT
PURE, ANCHOR, DBR = "pure_recycling", "anchor_20_append", "dbr_medium"
BUCKETS = ["silent", "low", "high", "ordinary"]


def _second(question="question", gold="answer_gold", response="raw_response"):
    """The second judge: the stand-in judge with another instruction before the question."""
    return hashing.mock_judgement(F.concat(F.lit("again: "), F.col(question)), F.col(gold), F.col(response))


def _sample(spark, sf_dir, total=120):
    rows = bindings.evaluated(spark, sf_dir).filter(F.col("branch").isin(PURE, ANCHOR) & F.col("generation").isin(1, 2))
    rows = rows.withColumn("bucket", quality.score_bucket(F.col("is_silent_error"), F.col("overall_pedagogical_score")))
    return sampling.balanced_cells(rows, ["branch", "generation"], "bucket", BUCKETS, total, "order_id")


def g04_sensitivity_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("order_id", "branch", "generation", "bucket")


def _rejudged(spark, sf_dir):
    """The second judge's results of all rows; it fails on every 11th."""
    rows = bindings.responses(spark, sf_dir).filter("order_id % 11 <> 0").select("order_id", _second().alias("_j"))
    return rows.select("order_id", "_j.overall_pedagogical_score", "_j.is_silent_error")


def _compared(spark, sf_dir):
    """Both judges of every row: the second judges in place, so that the rows are read once."""
    rows = bindings.evaluated(spark, sf_dir).filter("order_id % 11 <> 0")
    rows = rows.select("order_id", "seed", "branch", "generation", F.col("overall_pedagogical_score").alias("old_score"), F.col("is_silent_error").alias("old_silent"), _second().alias("_j"))
    rows = rows.select("*", F.col("_j.overall_pedagogical_score").alias("new_score"), F.col("_j.is_silent_error").alias("new_silent")).drop("_j")
    delta = F.col("new_score") - F.col("old_score")
    return rows.withColumns({"score_delta": delta, "abs_score_delta": F.abs(delta), "silent_agreement": F.col("old_silent") == F.col("new_silent")})


def i24_judge_comparison(spark, sf_dir):
    """A sample joined with the second judge's results: rows that it failed on are not compared."""
    sample = _sample(spark, sf_dir).select("order_id", "branch", "generation", "overall_pedagogical_score", "is_silent_error")
    return judges.compared_scores(sample, _rejudged(spark, sf_dir), ["order_id"], "overall_pedagogical_score", "is_silent_error")


def i15_failures(spark, sf_dir):
    """Rows of the sample without a result of the second judge."""
    return _sample(spark, sf_dir).join(_rejudged(spark, sf_dir), "order_id", "left_anti").select("order_id", "branch", "generation")


def e09_sensitivity_summary(spark, sf_dir):
    out = judges.sensitivity_summary(_compared(spark, sf_dir), PURE, ANCHOR)
    return out.withColumn("correlation", F.round("correlation", 9))


def e10_judge_branch_summary(spark, sf_dir):
    return judges.branch_summary(_compared(spark, sf_dir))


def e11_seed_branch_summary(spark, sf_dir):
    return judges.seed_summary(_compared(spark, sf_dir), PURE, ANCHOR)


def d11_pair_candidates(spark, sf_dir):
    """Responses of two branches to one example; where several match, the first of each side counts."""
    return q._pairs(spark, sf_dir).select("model_name", "seed", "example_id", "pair_key", "pure_overall_pedagogical_score", "dbr_overall_pedagogical_score")


def _decoded_twice(spark, sf_dir):
    """The sampled pairs' winners by both judges, told apart by the side that each saw as A; the second fails on some pairs."""
    rows = written(q._decoded(spark, sf_dir), "decoded")  # a sample, which both judges read
    two = [hashing.mock_judgement(F.concat(F.lit("again: "), F.col("pair_key")), F.lit(side), F.col(f"response_{side}"))["overall_pedagogical_score"] for side in "ab"]
    second = rows.select("pair_id", "pair_key", "seed", "branch_a", "branch_b", *[s.alias(f"score_{side}") for s, side in zip(two, "ab")])
    second = second.withColumn("winner", F.when(F.col("score_a") > F.col("score_b"), "A").when(F.col("score_b") > F.col("score_a"), "B").otherwise("Tie"))
    second = second.filter("substring(pair_key, -1) <> '7'")
    return rows, sampling.decoded(second, "winner", [PURE, DBR])


def d23_pair_comparison(spark, sf_dir):
    first, second = _decoded_twice(spark, sf_dir)
    out = judges.compared_pairs(first, second, ["pair_id", "seed"])
    return out.select("pair_id", "seed", "old_winner", "new_winner", "old_winner_branch", "new_winner_branch", "agree_branch", "agree_raw")


def d24_decoded_with_failures(spark, sf_dir):
    """All pairs with the second judge's winner, or the mark of a failure."""
    first, second = _decoded_twice(spark, sf_dir)
    out = first.select("pair_id").join(second.select("pair_id", "winner_branch"), "pair_id", "left")
    return out.select("pair_id", "winner_branch", F.col("winner_branch").isNull().alias("failed"))


def i16_pair_summary(spark, sf_dir):
    return judges.pair_summary(judges.compared_pairs(*_decoded_twice(spark, sf_dir), ["pair_id", "seed"]), PURE, DBR, [])


def i16_pair_seed_summary(spark, sf_dir):
    return judges.pair_summary(judges.compared_pairs(*_decoded_twice(spark, sf_dir), ["pair_id", "seed"]), PURE, DBR, ["seed"])


def i17_margin_summary(spark, sf_dir):
    """The second judge's margin by seed beside the first judge's mean difference in generation 1."""
    rows = bindings.evaluated(spark, sf_dir).filter("generation = 1")
    side = {b: F.avg(F.when(F.col("branch") == b, F.col("overall_pedagogical_score"))) for b in (PURE, DBR)}
    scores = rows.groupBy("seed").agg((side[DBR] - side[PURE]).alias("delta"))
    return judges.margin_summary(_decoded_twice(spark, sf_dir)[1], scores, PURE, DBR, ("pure", "dbr"), ["seed"])


def h10_analysis_sources(spark, sf_dir):
    """Whether the runs behind each branch's rows bear the token that its analysis expects.

    A run is a customer's orders, named after the branch of the first of them; an analysis that reads rows of other branches in it is off.
    """
    rows = bindings.responses(spark, sf_dir)
    first = F.concat(F.lit("run_"), F.min_by("branch", "order_id"))
    runs = rows.groupBy("customer").agg(first.alias("run"), F.collect_set("branch").alias("branches")).select("run", F.explode("branches").alias("branch"))
    token = F.when(F.col("branch") == PURE, "pure").when(F.col("branch") == DBR, "dbr").otherwise("anchor")
    rows = runs.groupBy("branch").agg(F.count("*").alias("n_runs"), F.count(F.when(F.contains("run", token), 1)).alias("n_expected"))
    return rows.withColumn("status", F.when(F.col("n_runs") == F.col("n_expected"), "ok").otherwise("mismatch"))


def h11_pairwise_checks(spark, sf_dir):
    """Equal sets of pair ids in the tables of a pairwise study, and its summary's rates against those of its rows.

    The summary is that of all pairs; the rows are those that the second judge has answered, so a rate is off where failures are not left out.
    """
    first, second = _decoded_twice(spark, sf_dir)
    rows = first.select("pair_id", "winner_branch", F.lit(1).alias("selected"), F.lit(0).alias("judged")).union(second.select("pair_id", F.lit(None), F.lit(0), F.lit(1)))
    ids = rows.groupBy("pair_id").agg(F.max("selected").alias("l"), F.max("judged").alias("r"), F.max("winner_branch").alias("winner_branch"))
    counts = [F.sum("l").alias("left_count"), F.sum("r").alias("right_count"), F.sum((F.col("l") != F.col("r")).cast("int")).alias("apart")]
    rates = [f(F.when(F.col(side) == 1, (F.col("winner_branch") == b).cast("int"))).alias(f"{b}_{side}") for b in (PURE, DBR) for side, f in (("l", F.avg), ("r", F.avg))]
    one = ids.agg(*counts, *rates)

    def check(name, left, right, same):
        return F.struct(F.lit(name).alias("check_name"), F.when(same, "ok").otherwise("mismatch").alias("status"), left.cast("double").alias("left_value"), right.cast("double").alias("right_value"))

    checks_ = [check("selected_vs_judged_pair_ids", F.col("left_count"), F.col("right_count"), F.col("apart") == 0)]
    checks_ += [check(f"{b}_rate", F.round(f"{b}_l", 9), F.round(f"{b}_r", 9), F.abs(F.col(f"{b}_l") - F.col(f"{b}_r")) <= 1e-9) for b in (PURE, DBR)]
    return one.select(F.inline(F.array(*checks_)))


def i20_findings(spark, sf_dir):
    """Findings of all checks by severity and category: stages, row counts, stored summaries, sources, pairs."""
    rows = written(bindings.evaluated(spark, sf_dir, keep_missing=True).select("example_id", *CTX, "raw_response", "accuracy_label", "is_correct", "pred_parse_success", "overall_pedagogical_score", "is_silent_error", "has_judge"), "evaluated")
    parts = [
        reports.h07_manifest_findings(spark, sf_dir).select("severity", F.lit("manifest").alias("category")),
        reports.row_counts(rows).filter("accuracy_mismatch OR judged_mismatch").select(F.lit("HIGH").alias("severity"), F.lit("row_counts").alias("category")),
        q.summary_recomputed(rows.filter("has_judge")).filter("status <> 'ok'").select(F.when(F.col("status") == "mismatch", "CRITICAL").otherwise("MEDIUM").alias("severity"), F.lit("summary").alias("category")),
        h10_analysis_sources(spark, sf_dir).filter("status <> 'ok'").select(F.lit("HIGH").alias("severity"), F.lit("sources").alias("category")),
        h11_pairwise_checks(spark, sf_dir).filter("status <> 'ok'").select(F.lit("CRITICAL").alias("severity"), F.lit("pairwise").alias("category")),
    ]
    parts = [written(part, "findings") for part in parts]  # each is a report of its own, and small
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("category", "severity").agg(F.count("*").alias("n"))


def e14_gen2_metrics(spark, sf_dir):
    return gen2_metrics(bindings.evaluated(spark, sf_dir))


def gen2_metrics(evaluated: DataFrame) -> DataFrame:
    rows = evaluated.filter(F.col("branch").isin(PURE, DBR) & (F.col("generation") == 2))
    return metrics.metrics(rows, ["seed", "branch"]).select("seed", "branch", "sample_count", *metrics.METRICS)


def f11_gen2_deltas(spark, sf_dir):
    """Differences of two branches by seed, and below them their mean, deviation and number over seeds."""
    return gen2_deltas(bindings.evaluated(spark, sf_dir))


def gen2_deltas(evaluated: DataFrame) -> DataFrame:
    wide = gen2_metrics(evaluated).groupBy("seed").agg(*[F.max(F.when(F.col("branch") == b, F.col(m))).alias(f"{m}_{k}") for m in metrics.METRICS for k, b in (("pure", PURE), ("dbr", DBR))], F.count("*").alias("n"))
    deltas = wide.filter("n = 2").select("seed", *[(F.col(f"{m}_dbr") - F.col(f"{m}_pure")).alias(f"delta_{m}") for m in metrics.METRICS])
    names = [f"delta_{m}" for m in metrics.METRICS]
    sums = deltas.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(k).alias("row"), *[F.col(f"{k}_{n}").cast("double").alias(n) for n in names]) for k in ("mean", "std", "n")])
    each = deltas.select(F.concat(F.lit("seed_"), "seed").alias("row"), *[F.col(n).cast("double").alias(n) for n in names])
    return each.unionByName(sums.select(F.inline(rows))).select("row", *[F.round(n, 9).alias(n) for n in names])


def h14_table_comparison(spark, sf_dir):
    """A stored table, of which one seed's accuracy is off, against its recomputation, to 1e-9."""
    computed = e14_gen2_metrics(spark, sf_dir)
    off = F.when((F.col("seed") == 211) & (F.col("branch") == DBR), 1e-6).otherwise(0.0)
    stored = computed.withColumn("accuracy_mean", F.col("accuracy_mean") + off)
    return checks.compared(stored, computed, ["seed", "branch"], metrics.METRICS, 1e-9).select("seed", "branch", "metric", "status")


def queries():
    return {name: f for name, f in globals().items() if re.match(r"[a-m]\d\d_", name)}


SECOND_SQL = """, dig2 AS (SELECT order_id, sha256('again: ' || question || chr(10) || answer_gold || chr(10) || raw_response) AS h FROM resp WHERE order_id % 11 <> 0),
  two AS (SELECT order_id, (d % 3 + (d - low % 4 + 255) % 3 + (d - low % 16 + 255) % 3 + (d - low % 64 + 255) % 3)::INT AS new_score, s % 7 = 0 AS new_silent FROM (
    SELECT order_id, list_sum(list_transform(range(1, 65), lambda i: ('0x' || substr(h, i, 1))::INT)) AS d, ('0x' || substr(h, 63, 2))::INT AS low,
      list_sum(list_transform(range(1, 65), lambda i: ('0x' || substr(h, i, 1))::INT * [1, 2, 4][((64 - i) % 3 + 1)::INT])) AS s FROM dig2)),
  cmp AS (SELECT order_id, seed, branch, generation, overall_pedagogical_score AS old_score, is_silent_error AS old_silent, new_score, new_silent,
    new_score - overall_pedagogical_score AS score_delta, abs(new_score - overall_pedagogical_score) AS abs_score_delta, is_silent_error = new_silent AS silent_agreement
    FROM ev JOIN two USING (order_id)),
  smp AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY (pick > q)::INT, sha256(concat_ws('|', 'fill-0', order_id::VARCHAR)), order_id) AS place FROM (
      SELECT *, 120 // 4 + (dense_rank() OVER (ORDER BY branch, generation) <= 120 % 4)::INT AS q FROM (
        SELECT *, row_number() OVER (PARTITION BY branch, generation ORDER BY i, list_position(['silent', 'low', 'high', 'ordinary'], bucket), order_id) AS pick FROM (
          SELECT *, row_number() OVER (PARTITION BY branch, generation, bucket ORDER BY sha256(concat_ws('|', 'bucket-0', branch, generation::VARCHAR, order_id::VARCHAR)), order_id) AS i
          FROM bucketed WHERE branch IN ('pure_recycling', 'anchor_20_append') AND generation IN (1, 2))))) WHERE place <= 120)"""

PAIR_SQL = """, psc AS (SELECT *, CASE WHEN coin THEN 'pure_recycling' ELSE 'dbr_medium' END AS branch_a, CASE WHEN coin THEN 'dbr_medium' ELSE 'pure_recycling' END AS branch_b,
    sha256('again: ' || pair_key || chr(10) || 'a' || chr(10) || CASE WHEN coin THEN pure_response ELSE dbr_response END) AS ha,
    sha256('again: ' || pair_key || chr(10) || 'b' || chr(10) || CASE WHEN coin THEN dbr_response ELSE pure_response END) AS hb FROM won),
  psn AS (SELECT *, {a} AS sa, {b} AS sb FROM psc),
  pw AS (SELECT *, CASE WHEN sa > sb THEN 'A' WHEN sb > sa THEN 'B' ELSE 'Tie' END AS new_winner,
    CASE WHEN sa > sb THEN branch_a WHEN sb > sa THEN branch_b ELSE 'Tie' END AS new_winner_branch FROM psn WHERE pair_key[-1:] <> '7')"""


def _score_sql(h: str) -> str:
    d, low = f"list_sum(list_transform(range(1, 65), lambda i: ('0x' || substr({h}, i, 1))::INT))", f"('0x' || substr({h}, 63, 2))::INT"
    return f"(({d}) % 3 + (({d}) - {low} % 4 + 255) % 3 + (({d}) - {low} % 16 + 255) % 3 + (({d}) - {low} % 64 + 255) % 3)::INT"


_FLIP = "({o} >= 0 AND {n} < 0) OR ({o} < 0 AND {n} >= 0)"
_FLIP_D = _FLIP.format(o="old_delta", n="new_delta")
_P, _A = "branch = 'pure_recycling'", "branch = 'anchor_20_append'"
_PAIRS = """count(*) AS n_pairs, avg((winner_branch = 'pure_recycling')::INT) AS old_control_rate, avg((winner_branch = 'dbr_medium')::INT) AS old_other_rate,
  avg((new_winner_branch = 'pure_recycling')::INT) AS new_control_rate, avg((new_winner_branch = 'dbr_medium')::INT) AS new_other_rate,
  avg((winner_branch = 'Tie')::INT) AS old_tie_rate, avg((new_winner_branch = 'Tie')::INT) AS new_tie_rate,
  avg((winner_branch = new_winner_branch)::INT) AS agree_branch_rate, avg((winner = new_winner)::INT) AS agree_raw_rate,
  old_other_rate - old_control_rate AS old_delta, new_other_rate - new_control_rate AS new_delta"""

SQL = {
    "g04_sensitivity_sample": "{second} SELECT order_id, branch, generation, bucket FROM smp",
    "i24_judge_comparison": "{second} SELECT c.order_id, c.branch, c.generation, old_score, old_silent, new_score, new_silent, score_delta, abs_score_delta, silent_agreement FROM cmp AS c JOIN smp USING (order_id)",
    "i15_failures": "{second} SELECT order_id, branch, generation FROM smp WHERE order_id % 11 = 0",
    "e09_sensitivity_summary": f"""{{second}} SELECT *, {_FLIP_D} AS conclusion_changed FROM (SELECT count(*) AS n_examples, avg(old_score) AS mean_old_score, avg(new_score) AS mean_new_score, avg(abs_score_delta) AS mean_abs_delta,
      round(corr(old_score, new_score), 9) AS correlation, avg(silent_agreement::INT) AS silent_agreement_rate,
      avg(old_score) FILTER (generation = 1 AND {_A}) - avg(old_score) FILTER (generation = 1 AND {_P}) AS old_delta,
      avg(new_score) FILTER (generation = 1 AND {_A}) - avg(new_score) FILTER (generation = 1 AND {_P}) AS new_delta FROM cmp)""",
    "e10_judge_branch_summary": "{second} SELECT branch, generation, count(*) AS n, avg(old_score) AS old_mean, avg(new_score) AS new_mean, avg(old_silent::INT) AS old_silent_rate, avg(new_silent::INT) AS new_silent_rate, avg(score_delta) AS mean_delta, avg(silent_agreement::INT) AS silent_agreement_rate FROM cmp GROUP BY ALL",
    "e11_seed_branch_summary": f"""{{second}} SELECT *, old_other_mean - old_control_mean AS old_delta, new_other_mean - new_control_mean AS new_delta, {_FLIP_D} AS conclusion_changed FROM (
      SELECT seed, count(*) AS n, avg(silent_agreement::INT) AS silent_agreement_rate, avg(score_delta) AS mean_delta, """ + ", ".join(f"avg({j}_score) FILTER ({w}) AS {j}_{k}_mean, avg({j}_silent::INT) FILTER ({w}) AS {j}_{k}_silent_rate" for k, w in (("control", _P), ("other", _A)) for j in ("old", "new")) + f""",
      count(*) FILTER ({_P}) AS n_control, count(*) FILTER ({_A}) AS n_other FROM cmp WHERE generation = 1 GROUP BY seed) WHERE n_control > 0 AND n_other > 0""",
    "d11_pair_candidates": "SELECT model_name, seed, example_id, pair_key, pure_score AS pure_overall_pedagogical_score, dbr_score AS dbr_overall_pedagogical_score FROM prs",
    "d23_pair_comparison": "{pairs} SELECT pair_id, seed, winner AS old_winner, new_winner, winner_branch AS old_winner_branch, new_winner_branch, winner_branch = new_winner_branch AS agree_branch, winner = new_winner AS agree_raw FROM pw",
    "d24_decoded_with_failures": "{pairs} SELECT pair_id, new_winner_branch AS winner_branch, new_winner_branch IS NULL AS failed FROM won LEFT JOIN (SELECT pair_id, new_winner_branch FROM pw) USING (pair_id)",
    "i16_pair_summary": f"{{pairs}} SELECT *, {_FLIP_D} AS conclusion_changed FROM (SELECT {_PAIRS} FROM pw)",
    "i16_pair_seed_summary": f"{{pairs}} SELECT *, {_FLIP_D} AS conclusion_changed FROM (SELECT seed, {_PAIRS} FROM pw GROUP BY seed)",
    "i17_margin_summary": """{pairs}, sc AS (SELECT seed, avg(overall_pedagogical_score) FILTER (branch = 'dbr_medium') - avg(overall_pedagogical_score) FILTER (branch = 'pure_recycling') AS delta FROM ev WHERE generation = 1 GROUP BY seed),
      r AS (SELECT seed, count(*) AS n_pairs, avg((new_winner_branch = 'pure_recycling')::INT) AS pure_rate, avg((new_winner_branch = 'dbr_medium')::INT) AS dbr_rate, avg((new_winner_branch = 'Tie')::INT) AS tie_rate FROM pw GROUP BY seed),
      v AS (SELECT *, dbr_rate - pure_rate AS margin, CASE WHEN dbr_rate > pure_rate THEN 'dbr_preferred' WHEN dbr_rate < pure_rate THEN 'pure_preferred' ELSE 'mixed_tie' END AS conclusion,
        CASE WHEN delta > 0 THEN 'dbr_preferred' WHEN delta < 0 THEN 'pure_preferred' WHEN delta = 0 THEN 'mixed_tie' ELSE 'unknown' END AS score_conclusion FROM r LEFT JOIN sc USING (seed))
      SELECT *, CASE WHEN delta IS NOT NULL THEN conclusion <> score_conclusion END AS changed FROM v""",
    "h10_analysis_sources": "{sources} SELECT * FROM src",
    "h11_pairwise_checks": "{pairs}{checks} SELECT * FROM chk",
    "i20_findings": """{stages}{pairs}{checks}{sources} SELECT 'manifest' AS category, severity, count(*) AS n FROM found GROUP BY severity
      UNION ALL SELECT 'row_counts', 'HIGH', count(*) FROM (SELECT 1 FROM resp GROUP BY model_name, branch, generation, seed HAVING count(*) FILTER (order_id % 37 = 0) > 0) HAVING count(*) > 0
      UNION ALL SELECT 'summary', CASE WHEN branch = 'dbr_medium' THEN 'CRITICAL' ELSE 'MEDIUM' END, CASE WHEN branch = 'dbr_medium' THEN count(*) ELSE 3 END FROM (SELECT DISTINCT branch, generation FROM ev) WHERE branch = 'dbr_medium' OR (branch = 'pure_recycling' AND generation = 2) GROUP BY branch
      UNION ALL SELECT 'sources', 'HIGH', count(*) FROM src WHERE status <> 'ok' HAVING count(*) > 0
      UNION ALL SELECT 'pairwise', 'CRITICAL', count(*) FROM chk WHERE status <> 'ok' HAVING count(*) > 0""",
    "e14_gen2_metrics": "SELECT seed, branch, count(*) AS sample_count, avg(is_correct::INT) AS accuracy_mean, avg(overall_pedagogical_score) AS pedagogical_score_mean, avg(is_silent_error::INT) AS silent_error_rate FROM ev WHERE generation = 2 AND branch IN ('pure_recycling', 'dbr_medium') GROUP BY ALL",
    "f11_gen2_deltas": """, g AS (SELECT seed, branch, avg(is_correct::INT) AS a, avg(overall_pedagogical_score) AS p, avg(is_silent_error::INT) AS s FROM ev WHERE generation = 2 GROUP BY ALL),
      d AS (SELECT l.seed, r.a - l.a AS a, r.p - l.p AS p, r.s - l.s AS s FROM g AS l JOIN g AS r ON l.seed = r.seed AND l.branch = 'pure_recycling' AND r.branch = 'dbr_medium')
      SELECT 'seed_' || seed AS row, round(a, 9) AS delta_accuracy_mean, round(p, 9) AS delta_pedagogical_score_mean, round(s, 9) AS delta_silent_error_rate FROM d
      UNION ALL SELECT 'mean', round(avg(a), 9), round(avg(p), 9), round(avg(s), 9) FROM d UNION ALL SELECT 'std', round(stddev_samp(a), 9), round(stddev_samp(p), 9), round(stddev_samp(s), 9) FROM d
      UNION ALL SELECT 'n', count(a)::DOUBLE, count(p)::DOUBLE, count(s)::DOUBLE FROM d""",
    "h14_table_comparison": """, c AS (SELECT seed, branch, avg(is_correct::INT) AS accuracy_mean, avg(overall_pedagogical_score) AS pedagogical_score_mean, avg(is_silent_error::INT) AS silent_error_rate FROM ev WHERE generation = 2 AND branch IN ('pure_recycling', 'dbr_medium') GROUP BY ALL),
      t AS (SELECT * REPLACE (accuracy_mean + CASE WHEN seed = 211 AND branch = 'dbr_medium' THEN 1e-6 ELSE 0 END AS accuracy_mean) FROM c),
      cl AS (UNPIVOT c ON accuracy_mean, pedagogical_score_mean, silent_error_rate INTO NAME metric VALUE v), tl AS (UNPIVOT t ON accuracy_mean, pedagogical_score_mean, silent_error_rate INTO NAME metric VALUE v)
      SELECT seed, branch, metric, CASE WHEN abs(cl.v - tl.v) <= 1e-9 THEN 'ok' ELSE 'mismatch' END AS status FROM cl JOIN tl USING (seed, branch, metric)""",
}


SOURCES_SQL = """, fr AS (SELECT customer, 'run_' || arg_min(branch, order_id) AS run FROM resp GROUP BY 1),
  rb AS (SELECT DISTINCT customer, branch, run, CASE branch WHEN 'pure_recycling' THEN 'pure' WHEN 'dbr_medium' THEN 'dbr' ELSE 'anchor' END AS token FROM resp JOIN fr USING (customer)),
  src AS (SELECT branch, count(*) AS n_runs, count(*) FILTER (contains(run, token)) AS n_expected, CASE WHEN count(*) = count(*) FILTER (contains(run, token)) THEN 'ok' ELSE 'mismatch' END AS status FROM rb GROUP BY branch)"""
CHECKS_SQL = """, chk AS (
    SELECT 'selected_vs_judged_pair_ids' AS check_name, CASE WHEN EXISTS (FROM won ANTI JOIN pw USING (pair_id)) THEN 'mismatch' ELSE 'ok' END AS status, (SELECT count(*) FROM won)::DOUBLE AS left_value, (SELECT count(*) FROM pw)::DOUBLE AS right_value
    UNION ALL SELECT b || '_rate', CASE WHEN abs(l - r) <= 1e-9 THEN 'ok' ELSE 'mismatch' END, round(l, 9), round(r, 9)
    FROM (SELECT b, (SELECT avg((winner_branch = b)::INT) FROM won) AS l, (SELECT avg((winner_branch = b)::INT) FROM pw) AS r FROM (VALUES ('pure_recycling'), ('dbr_medium')) AS t(b)))"""


def oracle_sql():
    from gyre.plans import oracles

    pairs = PAIR_SQL.replace("{a}", _score_sql("ha")).replace("{b}", _score_sql("hb"))
    fill = {"second": SECOND_SQL, "pairs": pairs, "stages": reports.STAGES_SQL, "sources": SOURCES_SQL, "checks": CHECKS_SQL}
    out = {}
    for name, sql in SQL.items():
        for key, text in fill.items():
            sql = sql.replace("{" + key + "}", text)
        out[name] = oracles.BASE + sql
    return out
