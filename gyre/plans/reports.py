"""More queries: text rules, samples by cell, audits of stages and row counts, and summaries over runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions import answers, hashing, quality, text_rules
from gyre.operators import dbr, metrics, policies, sampling
from gyre.plans import exports
from gyre.plans import queries as q
from gyre.sources import bindings
from gyre.sources.shared import written
from gyre.sources.tables import table

CTX = bindings.CONTEXT


def b02_clean_fragment(spark, sf_dir):
    return bindings.responses(spark, sf_dir).select("order_id", answers.clean(F.col("raw_response")).alias("cleaned"), answers.numeric_token(F.col("raw_response")).alias("token"))


def b11_legacy_equality(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir)

    def plain(c):
        return F.coalesce(F.replace(F.trim(c), F.lit(","), F.lit("")), F.lit(""))

    return rows.groupBy("branch", "generation").agg(F.avg((plain("raw_response") == plain("answer_gold")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def b13_random_state(spark, sf_dir):
    contexts = bindings.responses(spark, sf_dir).select(*CTX).distinct()
    text = F.format_string("%d|%s|%s|%d|ratio=%.8f|allow_reuse=False|mode=append|purpose=anchor_selection", "seed", "model_name", "branch", "generation", F.lit(0.2))
    return contexts.select(*CTX, F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long").alias("state"))


def b14_anchor_count(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir).groupBy(*CTX).agg(F.count("*").alias("n"))
    return rows.select(*CTX, policies.anchor_count(F.col("n"), 0.5).alias("k"))


def b24_prompt(spark, sf_dir):
    version = F.when(F.col("order_id") % 2 == 0, "v2").otherwise("v1")
    return bindings.responses(spark, sf_dir).select("order_id", F.sha2(text_rules.prompt(F.col("question"), version), 256).alias("prompt_sha256"))


def b36_repair_errors(spark, sf_dir):
    rows = bindings.accuracy(bindings.responses(spark, sf_dir))
    text = F.concat(F.when(F.col("order_id") % 4 == 0, F.lit("")).otherwise(F.lit("Steps.\n")), F.when(F.col("order_id") % 3 == 0, F.lit("Final answer: 42")).otherwise(F.lit("it is 42")))
    strict = text_rules.repair_error(text, F.col("normalized_gold"), F.col("answer_gold"))
    lite = text_rules.repair_error(text, F.col("normalized_predicted"), max_chars=20)
    return rows.select("order_id", strict.alias("pvr_error"), lite.alias("pair_lite_error"))


def b39_masked(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text_rules.masked(F.col("c_name")).alias("masked"), text_rules.masked(F.col("c_mktsegment").substr(1, 5)).alias("short"))


def b42_retry_sleep(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey")
    wait = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("double"))
    return rows.select("p_partkey", text_rules.retry_sleep(F.col("p_partkey") % 9, wait).alias("sleep"))


def b43_safe_name(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text_rules.safe_name(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("/x:1"))).alias("name"))


def b48_line_kinds(spark, sf_dir):
    """Lines of all documents by kind; lines are counted in place, a document at a time."""
    rows = table(spark, sf_dir, "documents").select(F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return rows.groupBy(text_rules.line_kind(F.col("line"), F.col("at") == 0).alias("kind")).agg(F.count("*").alias("n"))


def e18_collapse_summary(spark, sf_dir):
    return collapse_summary(q._policy_rows(spark, sf_dir))


def collapse_summary(rows: DataFrame) -> DataFrame:
    rows = dbr.flagged(rows)
    names = [f"rate_{n}" for n in quality.DEFECTS] + ["mean_severity"]
    by_seed = rows.groupBy("seed", "branch", "generation").agg(*[F.avg(F.col(f"defect_{n}").cast("int")).alias(f"rate_{n}") for n in quality.DEFECTS], F.avg("severity").alias("mean_severity"))
    out = metrics.spread(metrics.long_form(by_seed, ["seed", "branch", "generation"], names), ["branch", "generation", "metric"])
    return out.select("branch", "generation", "metric", "n_seeds", *[F.round(c, 9).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])


def e26_csr_quality(spark, sf_dir):
    rows = q.c06_csr_pairs(spark, sf_dir).filter("pair_status = 'paired'")
    return rows.groupBy("branch", "generation").agg(F.count("*").alias("n"), F.avg("best_score").alias("best_mean"), F.avg("worst_score").alias("worst_mean"), F.avg("quality_gap").alias("gap_mean"), F.avg(F.col("worst_is_silent_error").cast("int")).alias("worst_silent_rate"))


def e27_anchor_quality(spark, sf_dir):
    synthetic, pool = q._anchor_inputs(spark, sf_dir)
    rows = policies.anchored(synthetic, pool, CTX, 0.05)
    marker = F.lower("answer_for_training").contains("final answer:").cast("int")
    return rows.groupBy("branch", "generation", "source").agg(F.count("*").alias("n"), F.avg(F.length("question")).alias("question_length"), F.avg(F.length("answer_for_training")).alias("answer_length"), F.avg(marker).alias("marker_rate"))


SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def _stages(spark, sf_dir):
    """Stage records of each context: a few are pending or failed by the number of their rows."""
    contexts = bindings.responses(spark, sf_dir).groupBy(*CTX).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(s) for s in ("generation", "answer_extraction", "accuracy", "judge", "synthetic_build", "anchoring")])
    rows = contexts.select(*CTX, "n", F.posexplode(names).alias("at", "stage"))
    status = F.when((F.col("n") + F.col("at")) % 11 == 0, "failed").when((F.col("n") + F.col("at")) % 5 == 0, "pending").otherwise("completed")
    return rows.select(*CTX, "stage", status.alias("status"))


def h07_manifest_findings(spark, sf_dir):
    """Stages that are not completed; the last generation may leave its last two pending."""
    rows = _stages(spark, sf_dir)
    allowed = (F.col("status") == "pending") & (F.col("generation") == 2) & F.col("stage").isin("synthetic_build", "anchoring")
    severity = F.when(F.col("status") == "completed", None).when(allowed, None).when(F.col("status") == "failed", "CRITICAL").otherwise("HIGH")
    return rows.withColumn("severity", severity).filter("severity IS NOT NULL")


def h06_run_completed(spark, sf_dir):
    return _stages(spark, sf_dir).groupBy("seed", "model_name").agg(F.every(F.col("status") == "completed").alias("completed"), F.count(F.when(F.col("status") != "completed", 1)).alias("n_open"))


def e29_severity_counts(spark, sf_dir):
    """All levels, those without a finding too."""
    found = h07_manifest_findings(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])
    return found.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]).select(F.inline(rows))


def h08_row_counts(spark, sf_dir):
    """Rows of each artifact of each context, and whether they agree: one pass."""
    return row_counts(bindings.evaluated(spark, sf_dir, keep_missing=True))


def row_counts(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*CTX).agg(F.count("raw_response").alias("n_outputs"), F.count("accuracy_label").alias("n_accuracy"), F.count(F.when(F.col("has_judge"), 1)).alias("n_judged"))
    return out.withColumn("accuracy_mismatch", F.col("n_outputs") != F.col("n_accuracy")).withColumn("judged_mismatch", F.col("n_judged") != F.col("n_accuracy"))


def h12_policy_recheck(spark, sf_dir):
    """Keep rates in a report against those of its decisions, and whether reasons add up to the rows."""
    decided = policies.soft_pvf(q._policy_rows(spark, sf_dir))
    again = decided.groupBy("branch", "generation").agg(F.avg(F.col("kept").cast("int")).alias("actual"), F.count("*").alias("n_rows"), F.count("decision_reason").alias("n_reasons"))
    report = again.withColumn("keep_rate", F.col("actual") + F.when(F.col("generation") == 0, 0.5).otherwise(0.0))
    return report.select("branch", "generation", F.when(F.abs(F.col("keep_rate") - F.col("actual")) <= 1e-6, "ok").otherwise("mismatch").alias("keep_rate_status"), (F.col("n_rows") == F.col("n_reasons")).alias("reasons_complete"))


def f06_top_per_category(spark, sf_dir):
    rows = q.h15_diagnose(spark, sf_dir)
    place = Window.partitionBy("category").orderBy("branch", "generation", "order_id")
    return rows.withColumn("place", F.row_number().over(place)).filter("place <= 15")


def g03_pilot_splits(spark, sf_dir):
    """Three samples of their own seeds: held-out n, base at least 20, anchors at least twice that."""
    rows = bindings.responses(spark, sf_dir).select("example_id")
    n, out = 30, None
    for name, seed, size in (("heldout_test", 42, n), ("base_train", 43, max(n, 20)), ("anchor_pool", 44, max(2 * n, 40))):
        part = sampling.splits(rows, "example_id", {name: size}, seed)
        out = part if out is None else out.unionByName(part)
    return out


def g06_confirmatory_sample(spark, sf_dir):
    """The same number of rows of two branches for each seed that has both."""
    rows = bindings.evaluated(spark, sf_dir).filter("generation = 1 AND branch IN ('pure_recycling', 'anchor_20_append')")
    rows = rows.withColumn("bucket", quality.score_bucket(F.col("is_silent_error"), F.col("overall_pedagogical_score")))
    both = rows.groupBy("seed").agg(F.count_distinct("branch").alias("n")).filter("n = 2").select("seed")
    out = sampling.round_robin(rows.join(both, "seed"), ["seed", "branch"], "bucket", ["silent", "low", "high", "ordinary"], 8, "example_id", seed=42)
    return out.select("seed", "branch", "bucket", "example_id", "pick")


def g10_qualitative(spark, sf_dir):
    """The worst silent errors, the steepest declines, and pure rows behind their anchored twins, four or three of each."""
    keys = ["model_name", "seed", "example_id"]
    rows = written(bindings.evaluated(spark, sf_dir, shared_ids=True).select(*keys, "branch", "generation", "is_correct", "is_silent_error", "overall_pedagogical_score"), "evaluated")
    silent = rows.filter("is_correct AND is_silent_error AND generation >= 1").orderBy(F.desc("generation"), "overall_pedagogical_score", "branch", *keys).limit(4)
    silent = silent.select(F.lit("silent_error_candidate").alias("category"), *keys, "branch", "generation", F.col("overall_pedagogical_score").cast("int").alias("score"))
    decline = q.declines(rows).orderBy(F.desc("decline"), *keys, "branch").limit(3)
    decline = decline.select(F.lit("monotone_decline").alias("category"), *keys, "branch", F.lit(2).alias("generation"), F.col("score_2").alias("score"))

    def of(branch):
        return F.max(F.when(F.col("branch") == branch, F.col("overall_pedagogical_score")))

    twins = rows.groupBy(*keys, "generation").agg(of("pure_recycling").alias("p"), of("anchor_20_append").alias("a")).filter("a > p").orderBy(F.desc(F.col("a") - F.col("p")), *keys, "generation").limit(3)
    twins = twins.select(F.lit("anchor_better").alias("category"), *keys, F.lit("pure_recycling").alias("branch"), "generation", F.col("p").alias("score"))
    return silent.unionByName(decline).unionByName(twins)


def i02_run_comparison(spark, sf_dir):
    """Old against new run: means and differences of the two seeds where both have the context."""
    return q.d09_run_compare(spark, sf_dir).filter("merge_side = 'both'").drop("merge_side")


def j01_hash_pairs(spark, sf_dir):
    """Judge inputs that recur, by their key."""
    rows = bindings.responses(spark, sf_dir)
    key = F.sha2(F.concat_ws("\n", "question", "answer_gold", "raw_response"), 256)
    return rows.groupBy(key.alias("input_key")).agg(F.count("*").alias("n")).filter("n > 1")


def k03_failure_budget(spark, sf_dir):
    """Failed rows of each user against a budget of five."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("n_failed"))
    return rows.withColumn("over_budget", F.col("n_failed") > 5)


def m24_progress(spark, sf_dir):
    """Counts of a judging loop: rows, done, left, distinct inputs and calls saved."""
    rows = bindings.responses(spark, sf_dir)
    key = F.sha2(F.concat_ws("\n", "question", "answer_gold", "raw_response"), 256)
    done = F.col("order_id") % 37 != 0
    out = rows.agg(F.count("*").alias("n_total"), F.count(F.when(done, 1)).alias("n_done"), F.count(F.when(~done, 1)).alias("n_left"), F.count_distinct(key).alias("n_inputs"))
    return out.withColumn("n_saved", F.col("n_total") - F.col("n_inputs"))


def i06_pvf_stress(spark, sf_dir):
    return exports.pvf_report(*q.inputs(spark, sf_dir))["stress_summary"].select(*CTX, "sample_count", "accuracy_mean", "n_rows", "n_kept", "keep_rate")


def i08_soft_stress(spark, sf_dir):
    out = exports.soft_report(*q.inputs(spark, sf_dir))["stress_summary"]
    return out.select(*CTX, "sample_count", "keep_rate", F.round("mean_weight", 9).alias("mean_weight"))


def i10_dbr_stress(spark, sf_dir):
    return exports.dbr_report(*q.inputs(spark, sf_dir))["stress_summary"].select(*CTX, "sample_count", "n_rows", "n_selected", "selection_rate")


def i12_pvr_stress(spark, sf_dir):
    return exports.repair_report(*q.inputs(spark, sf_dir))["stress_summary"].select(*CTX, "sample_count", "n_attempted", "n_success", "success_rate")


def i14_csr_reasons(spark, sf_dir):
    return exports.csr_report(bindings.evaluated(spark, sf_dir), q._csr(spark, sf_dir), ["branch", "generation"])["no_pair_reasons"]


def i05_anchoring_ratios(spark, sf_dir):
    rows = bindings.evaluated(spark, sf_dir)
    ratios = spark.sql("SELECT * FROM VALUES ('dbr_medium', 10, 'append'), ('anchor_20_append', 20, 'append') AS t(branch, anchor_ratio, mixing_mode)")
    return exports.anchoring_ablation(rows, ratios)["ratio_deltas"].select("model_name", "generation", "seed", "mixing_mode", "low_anchor_ratio", "high_anchor_ratio", "delta_accuracy_mean")


def queries():
    return {name: f for name, f in globals().items() if re.match(r"[a-m]\d\d_", name)}


SQL = {
    "b02_clean_fragment": "SELECT order_id, {clean} AS cleaned, {token} AS token FROM resp",
    "b11_legacy_equality": "SELECT branch, generation, avg((replace(trim(raw_response), ',', '') = replace(trim(answer_gold), ',', ''))::INT) AS accuracy, count(*) AS n FROM resp GROUP BY ALL",
    "b13_random_state": "SELECT DISTINCT model_name, branch, generation, seed, ('0x' || substr(sha256(seed || '|' || model_name || '|' || branch || '|' || generation || '|ratio=0.20000000|allow_reuse=False|mode=append|purpose=anchor_selection'), 1, 8))::BIGINT AS state FROM resp",
    "b14_anchor_count": "SELECT model_name, branch, generation, seed, round_even(count(*) * 0.5::DOUBLE, 0)::BIGINT AS k FROM resp GROUP BY ALL",
    "b24_prompt": "SELECT order_id, sha256(CASE WHEN order_id % 2 = 0 THEN '{strict}' ELSE '{plain}' END || question) AS prompt_sha256 FROM resp",
    "b36_repair_errors": """, t AS (SELECT *, CASE WHEN order_id % 4 = 0 THEN '' ELSE 'Steps.' || chr(10) END || CASE WHEN order_id % 3 = 0 THEN 'Final answer: 42' ELSE 'it is 42' END AS fix FROM acc)
      SELECT order_id, CASE WHEN order_id % 3 <> 0 THEN 'no_final_line' WHEN normalized_gold IS NULL THEN 'expected_not_numeric' WHEN normalized_gold <> '42' THEN 'final_changed' END AS pvr_error,
        CASE WHEN length(fix) > 20 THEN 'too_long' WHEN order_id % 3 <> 0 THEN 'no_final_line' WHEN normalized_predicted IS NULL THEN 'expected_not_numeric'
          WHEN normalized_predicted <> '42' THEN 'final_changed' END AS pair_lite_error FROM t""",
    "b39_masked": "SELECT c_custkey, c_name[1:4] || '...' || c_name[-2:] AS masked, repeat('*', length(c_mktsegment[1:5])::INT) AS short FROM customer",
    "b42_retry_sleep": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN least(120.0, greatest(1.0, p_partkey))::DOUBLE ELSE least(45.0, 1.5 * pow(2.0, greatest(0, p_partkey % 9 - 1)))::DOUBLE END AS sleep FROM part",
    "b43_safe_name": "SELECT o_orderkey, replace(o_orderpriority, ' ', '_') || '_x:1' AS name FROM orders",
    "b48_line_kinds": r""", l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
      SELECT CASE WHEN pos = 0 THEN 'title' WHEN trim(line) = '' THEN 'blank' WHEN regexp_full_match(trim(line), '[|: -]+') AND contains(line, '|') AND contains(line, '-') THEN 'table_rule'
        WHEN starts_with(trim(line), '|') THEN 'table' WHEN starts_with(trim(line), '### ') THEN 'h3' WHEN regexp_matches(trim(line), '^(## |\d+\.\d+\s)') THEN 'h2'
        WHEN regexp_matches(trim(line), '^(# |\d+\.\s)') THEN 'h1' WHEN regexp_matches(trim(line), '^[-*] ') THEN 'bullet' ELSE 'body' END AS kind, count(*) AS n FROM l GROUP BY 1""",
    "e18_collapse_summary": """, g AS (SELECT seed, branch, generation, avg(defect_parse_failure::INT) AS rate_parse_failure, avg(defect_silent_error::INT) AS rate_silent_error,
        avg(defect_incorrect_answer::INT) AS rate_incorrect_answer, avg(defect_low_reasoning::INT) AS rate_low_reasoning, avg(defect_low_structure::INT) AS rate_low_structure,
        avg(severity) AS mean_severity FROM sev GROUP BY ALL),
      l AS (UNPIVOT g ON rate_parse_failure, rate_silent_error, rate_incorrect_answer, rate_low_reasoning, rate_low_structure, mean_severity INTO NAME metric VALUE v),
      t AS (SELECT branch, generation, metric, count(*) AS n, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM l GROUP BY ALL)
      SELECT branch, generation, metric, n AS n_seeds, round(m, 9) AS mean, round(s, 9) AS std, round(m - CASE WHEN n > 1 THEN 1.96 * s / sqrt(n) ELSE 0 END, 9) AS ci_low,
        round(m + CASE WHEN n > 1 THEN 1.96 * s / sqrt(n) ELSE 0 END, 9) AS ci_high FROM t""",
    "e26_csr_quality": "SELECT branch, generation, count(*) AS n, avg(best_score) AS best_mean, avg(worst_score) AS worst_mean, avg(quality_gap) AS gap_mean, avg(worst_is_silent_error::INT) AS worst_silent_rate FROM csr WHERE pair_status = 'paired' GROUP BY ALL",
    "e27_anchor_quality": "{anchors}, u AS (SELECT s.branch, s.generation, s.question, s.raw_response AS answer, 'synthetic' AS source FROM resp AS s UNION ALL SELECT branch, generation, question, answer, 'human_anchor' FROM chosen) SELECT branch, generation, source, count(*) AS n, avg(length(question)) AS question_length, avg(length(answer)) AS answer_length, avg(contains(lower(answer), 'final answer:')::INT) AS marker_rate FROM u GROUP BY ALL",
    "g10_qualitative": """, s AS (SELECT 'silent_error_candidate' AS category, model_name, seed, example_id, branch, generation, overall_pedagogical_score AS score FROM pev WHERE is_correct AND is_silent_error AND generation >= 1
        ORDER BY generation DESC, score, branch, model_name, seed, example_id LIMIT 4),
      w AS (SELECT model_name, branch, seed, example_id, max(overall_pedagogical_score) FILTER (generation = 0) AS s0, max(overall_pedagogical_score) FILTER (generation = 1) AS s1, max(overall_pedagogical_score) FILTER (generation = 2) AS s2 FROM pev GROUP BY ALL),
      d AS (SELECT 'monotone_decline' AS category, model_name, seed, example_id, branch, 2 AS generation, s2 AS score FROM w WHERE s0 > s1 AND s1 > s2 ORDER BY s0 - s2 DESC, model_name, seed, example_id, branch LIMIT 3),
      t AS (SELECT 'anchor_better' AS category, model_name, seed, example_id, 'pure_recycling' AS branch, generation, p AS score FROM (SELECT model_name, seed, example_id, generation, max(overall_pedagogical_score) FILTER (branch = 'pure_recycling') AS p,
        max(overall_pedagogical_score) FILTER (branch = 'anchor_20_append') AS a FROM pev GROUP BY ALL) WHERE a > p ORDER BY a - p DESC, model_name, seed, example_id, generation LIMIT 3)
      FROM s UNION ALL FROM d UNION ALL FROM t""",
    "e29_severity_counts": "{stages} SELECT s AS severity, count(severity) AS n FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS s) LEFT JOIN found ON severity = s GROUP BY s",
    "h06_run_completed": "{stages} SELECT seed, model_name, bool_and(status = 'completed') AS completed, count(*) FILTER (status <> 'completed') AS n_open FROM st GROUP BY ALL",
    "h07_manifest_findings": "{stages} SELECT model_name, branch, generation, seed, stage, status, severity FROM found",
    "h08_row_counts": "SELECT model_name, branch, generation, seed, count(*) AS n_outputs, count(*) AS n_accuracy, count(*) FILTER (order_id % 37 <> 0) AS n_judged, FALSE AS accuracy_mismatch, count(*) FILTER (order_id % 37 = 0) > 0 AS judged_mismatch FROM resp GROUP BY ALL",
    "h12_policy_recheck": "SELECT DISTINCT branch, generation, CASE WHEN generation = 0 THEN 'mismatch' ELSE 'ok' END AS keep_rate_status, TRUE AS reasons_complete FROM resp",
    "f06_top_per_category": "SELECT * FROM (SELECT order_id, branch, generation, {h15} AS category, row_number() OVER (PARTITION BY category ORDER BY branch, generation, order_id) AS place FROM acc) WHERE place <= 15",
    "g03_pilot_splits": " UNION ALL ".join(f"(SELECT example_id, '{n}' AS split FROM resp ORDER BY sha256('split-{s}|' || example_id), example_id LIMIT {k})" for n, s, k in (("heldout_test", 42, 30), ("base_train", 43, 30), ("anchor_pool", 44, 60))),
    "g06_confirmatory_sample": """, r AS (SELECT * FROM bucketed WHERE generation = 1 AND branch IN ('pure_recycling', 'anchor_20_append')
        AND seed IN (SELECT seed FROM bucketed WHERE generation = 1 AND branch IN ('pure_recycling', 'anchor_20_append') GROUP BY seed HAVING count(DISTINCT branch) = 2)),
      i AS (SELECT *, row_number() OVER (PARTITION BY seed, branch, bucket ORDER BY sha256(concat_ws('|', 'bucket-42', seed::VARCHAR, branch, example_id)), example_id) AS i,
        list_position(['silent', 'low', 'high', 'ordinary'], bucket) AS b FROM r)
      SELECT seed, branch, bucket, example_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY seed, branch ORDER BY i, b, example_id) AS pick FROM i) WHERE pick <= 8""",
    "i02_run_comparison": """, g AS (SELECT seed, model_name, branch, generation, count(*) AS n, avg(is_correct::INT) AS a, avg(overall_pedagogical_score) AS p, avg(is_silent_error::INT) AS s FROM ev GROUP BY ALL)
      SELECT o.model_name, o.branch, o.generation, w.n - o.n AS delta_sample_count, w.a - o.a AS delta_accuracy_mean, w.p - o.p AS delta_pedagogical_score_mean, w.s - o.s AS delta_silent_error_rate
      FROM g AS o JOIN g AS w ON (o.model_name, o.branch, o.generation) = (w.model_name, w.branch, w.generation) AND o.seed = 211 AND w.seed = 212 AND w.generation > 0""",
    "i05_anchoring_ratios": """SELECT l.model_name, l.generation, l.seed, 'append' AS mixing_mode, 10 AS low_anchor_ratio, 20 AS high_anchor_ratio, r.accuracy_mean - l.accuracy_mean AS delta_accuracy_mean
      FROM lvl AS l JOIN lvl AS r ON (l.model_name, l.generation, l.seed) = (r.model_name, r.generation, r.seed) AND l.branch = 'dbr_medium' AND r.branch = 'anchor_20_append'""",
    "i06_pvf_stress": "SELECT lvl.model_name, lvl.branch, lvl.generation, lvl.seed, sample_count, accuracy_mean, n_rows, n_kept, keep_rate FROM lvl LEFT JOIN (SELECT model_name, branch, generation, seed, count(*) AS n_rows, count(*) FILTER (kept) AS n_kept, avg(kept::INT) AS keep_rate FROM pvf GROUP BY ALL) USING (model_name, branch, generation, seed)",
    "i08_soft_stress": "SELECT model_name, branch, generation, seed, sample_count, keep_rate, round(mean_weight, 9) AS mean_weight FROM lvl LEFT JOIN (SELECT r.model_name, r.branch, r.generation, r.seed, avg(kept::INT) AS keep_rate, avg(assigned_weight) AS mean_weight FROM soft JOIN resp AS r USING (order_id) WHERE policy_name = 'soft_pvf_medium' GROUP BY ALL) USING (model_name, branch, generation, seed)",
    "i10_dbr_stress": "SELECT model_name, branch, generation, seed, sample_count, n_rows, n_selected, n_selected / n_rows AS selection_rate FROM lvl LEFT JOIN (SELECT model_name, branch, generation, seed, count(*) AS n_rows, count(*) FILTER (NOT defect_parse_failure) AS n_selected FROM sev GROUP BY ALL) USING (model_name, branch, generation, seed)",
    "i12_pvr_stress": "SELECT model_name, branch, generation, seed, sample_count, n_attempted, n_attempted AS n_success, CASE WHEN n_attempted > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS success_rate FROM lvl LEFT JOIN (SELECT model_name, branch, generation, seed, count(*) FILTER (state = 'weak') AS n_attempted FROM rep GROUP BY ALL) USING (model_name, branch, generation, seed)",
    "i14_csr_reasons": "SELECT branch, generation, no_pair_reason, count(*) AS n FROM csr WHERE no_pair_reason IS NOT NULL GROUP BY ALL",
    "j01_hash_pairs": "SELECT sha256(question || chr(10) || answer_gold || chr(10) || raw_response) AS input_key, count(*) AS n FROM resp GROUP BY 1 HAVING count(*) > 1",
    "k03_failure_budget": "SELECT user_id, count(*) FILTER (event_type = 'error') AS n_failed, count(*) FILTER (event_type = 'error') > 5 AS over_budget FROM events GROUP BY 1",
    "m24_progress": "SELECT count(*) AS n_total, count(*) FILTER (order_id % 37 <> 0) AS n_done, count(*) FILTER (order_id % 37 = 0) AS n_left, count(DISTINCT (question, answer_gold, raw_response)) AS n_inputs, count(*) - count(DISTINCT (question, answer_gold, raw_response)) AS n_saved FROM resp",
}

STAGES_SQL = """, c AS (SELECT model_name, branch, generation, seed, count(*) AS n FROM resp GROUP BY ALL),
  sp AS (SELECT *, unnest(['generation', 'answer_extraction', 'accuracy', 'judge', 'synthetic_build', 'anchoring']) AS stage, unnest(range(6)) AS pos FROM c),
  st AS (SELECT *, CASE WHEN (n + pos) % 11 = 0 THEN 'failed' WHEN (n + pos) % 5 = 0 THEN 'pending' ELSE 'completed' END AS status FROM sp),
  found AS (SELECT *, CASE status WHEN 'failed' THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM st WHERE status <> 'completed'
    AND NOT (status = 'pending' AND generation = 2 AND stage IN ('synthetic_build', 'anchoring')))"""


def oracle_sql():
    from gyre.plans import oracles

    anchors = """, n AS (SELECT model_name, branch, generation, seed, round_even(count(*) * 0.05::DOUBLE, 0)::BIGINT AS need FROM resp GROUP BY ALL),
      pool AS (SELECT 'model_' || (p_partkey % 2) AS model_name, ['pure_recycling', 'dbr_medium', 'anchor_20_append'][((p_partkey // 2) % 3 + 1)::INT] AS branch, ((p_partkey // 6) % 3)::INT AS generation,
        ((p_partkey // 18) % 3 + 211)::INT AS seed, 'a_' || p_partkey AS example_id, 'part ' || p_partkey AS question, '#### ' || p_partkey AS answer FROM part),
      chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, branch, generation, seed ORDER BY sha256(concat_ws('|', 'anchor', model_name, branch, generation::VARCHAR, seed::VARCHAR, example_id)), example_id) AS k FROM pool)
        JOIN n USING (model_name, branch, generation, seed) WHERE k <= need)"""
    quoted = {"strict": text_rules.PROMPT_STRICT, "plain": text_rules.PROMPT_PLAIN}
    fill = {"clean": oracles._clean("raw_response"), "token": oracles._token("raw_response"), "h15": oracles.H15, "stages": STAGES_SQL, "anchors": anchors} | {k: v.replace("'", "''") for k, v in quoted.items()}
    out = {}
    for name, sql in SQL.items():
        for key, text in fill.items():
            sql = sql.replace("{" + key + "}", text)
        out[name] = oracles.BASE + sql
    return out
