"""Queries over the derived tables, one or more for each operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.functions import answers, hashing, judge_json, quality
from gyre.operators import checks, dbr, metrics, policies, sampling
from gyre.sources import bindings
from gyre.sources.shared import written
from gyre.sources.tables import table
from gyre.streaming import resume

CTX = bindings.CONTEXT
SCORES = ["clarity", "structure", "terminology", "reasoning_soundness", "overall_pedagogical_score"]


def _policy_input(spark: SparkSession, sf_dir: str, partial: bool = True) -> DataFrame:
    """The three inputs of a policy, joined: some rows have no judgement."""
    rows = bindings.responses(spark, sf_dir)
    synthetic = rows.select("order_id", "example_id", *CTX, "question", F.col("raw_response").alias("answer_for_training"), F.lit("synthetic").alias("source"))
    return policies.policy_input(synthetic, bindings.accuracy(rows), bindings.judged(rows), ["order_id"], partial)


def _policy_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The rows of _policy_input(), from one pass: accuracy and judgement are functions of the row.  more: other columns of the responses."""
    rows = bindings.evaluated(spark, sf_dir, keep_missing=True)
    rows = rows.select("order_id", "example_id", *CTX, "question", F.col("raw_response").alias("answer_for_training"), F.lit("synthetic").alias("source"), *policies.ACCURACY, F.lit(True).alias("has_accuracy"), *policies.JUDGEMENT, "has_judge", "normalized_predicted", *more)
    return policies.with_states(rows)


def inputs(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Evaluated rows and policy inputs, which are one table: written once, so that no report derives answers or judgements again."""
    rows = written(_policy_rows(spark, sf_dir, *more).select("*", F.col("order_id").alias("place")), "inputs")
    return rows.filter("has_judge"), rows


def b01_stable_id(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir)
    return rows.select("order_id", hashing.stable_id(F.lit("gsm"), F.col("question"), F.col("answer_gold")).alias("stable_id"))


def b06_extract(spark, sf_dir):
    return bindings.accuracy(bindings.responses(spark, sf_dir)).select("order_id", "extracted_answer", "normalized_predicted", "pred_parse_success", "pred_parse_strategy", "pred_parse_failure_reason")


def b08_gold_normalize(spark, sf_dir):
    return bindings.responses(spark, sf_dir).select("order_id", answers.gold_token(F.col("answer_gold")).alias("normalized_gold"))


def b10_score(spark, sf_dir):
    return bindings.accuracy(bindings.responses(spark, sf_dir)).select("order_id", "accuracy_label", "is_correct")


def b12_unit_score(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir)
    parts = [F.col(c) for c in ("seed", "branch", "generation", "example_id")]
    return rows.select("order_id", hashing.unit_score(*parts, "dbr").alias("dbr_score"), hashing.unit_score(*parts, "soft_pvf").alias("soft_score"))


def b15_defect_flags(spark, sf_dir):
    return dbr.flagged(_policy_rows(spark, sf_dir)).select("order_id", *[f"defect_{n}" for n in quality.DEFECTS], "severity")


def b17_length_bin(spark, sf_dir):
    parts = [F.col(c) for c in ("seed", "branch", "generation", "example_id")]
    return bindings.responses(spark, sf_dir).select("order_id", quality.length_bin(F.col("question"), *parts).alias("length_bin"))


def b20_bucketize(spark, sf_dir):
    rows = bindings.evaluated(spark, sf_dir)
    return rows.select("order_id", quality.score_bucket(F.col("is_silent_error"), F.col("overall_pedagogical_score")).alias("bucket"))


def b33_rubric_ranges(spark, sf_dir):
    c = F.col
    rows = bindings.evaluated(spark, sf_dir)
    parts = [c(n) for n in SCORES[:4]]
    ok = (sum(parts[1:], parts[0]) == c("overall_pedagogical_score")) & c("overall_pedagogical_score").between(0, 8)
    for p in parts:
        ok = ok & p.between(0, 2)
    return rows.groupBy("generation").agg(F.count("*").alias("n_rows"), F.count(F.when(ok, 1)).alias("n_valid"))


def b45_response_fingerprint(spark, sf_dir):
    """A digest of each context's responses in the order of their ids: of 4,096 ids at a time, then of these digests."""
    rows = bindings.responses(spark, sf_dir).withColumn("block", F.expr("order_id div 4096"))

    def joined(order, text):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")

    blocks = rows.groupBy(*CTX, "block").agg(F.sha2(joined("order_id", "raw_response"), 256).alias("digest"))
    return blocks.groupBy(*CTX).agg(F.sha2(joined("block", "digest"), 256).alias("fingerprint"))


def a20_mock_judge(spark, sf_dir):
    return bindings.judged(bindings.responses(spark, sf_dir)).select("order_id", *SCORES, "is_silent_error")


def d03_eval_merged(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir)
    merged = bindings.accuracy(rows).join(bindings.judged(rows).select("order_id", "overall_pedagogical_score", "is_silent_error"), "order_id", "left")
    return merged.filter("overall_pedagogical_score IS NOT NULL").select("order_id", "example_id", *CTX, "is_correct", "accuracy_label", "overall_pedagogical_score", "is_silent_error")


def d25_pending_rows(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir).select("order_id", "example_id")
    return resume.pending(rows, bindings.judged(bindings.responses(spark, sf_dir)), ["order_id"])


def d09_run_compare(spark, sf_dir):
    """Two runs side by side, matched or not, by conditional aggregates in one pass."""
    rows = bindings.evaluated(spark, sf_dir)
    old, new = F.col("seed") == 211, (F.col("seed") == 212) & (F.col("generation") > 0)
    both = rows.filter(old | new).groupBy("model_name", "branch", "generation").agg(*metrics.measures(old, "old_"), *metrics.measures(new, "new_"), F.max(old).alias("_old"), F.max(new).alias("_new"))
    side = F.when(~F.col("_old"), "right_only").when(~F.col("_new"), "left_only").otherwise("both")
    names = ["sample_count", *metrics.METRICS]
    return both.select("model_name", "branch", "generation", side.alias("merge_side"), *[F.when(side == "both", F.col(f"new_{c}") - F.col(f"old_{c}")).alias(f"delta_{c}") for c in names])


def d12_matched_gen2(spark, sf_dir):
    """Examples that two branches share, by seed: one pass with conditional maxima in place of a self-join."""
    return matched_gen2(bindings.evaluated(spark, sf_dir, shared_ids=True))


def matched_gen2(shared: DataFrame) -> DataFrame:
    rows = shared.filter("generation = 2")
    two = ("pure_recycling", "dbr_medium")
    rows = rows.filter(F.col("branch").isin(*two))

    def of(branch: str, value: str):
        return F.max(F.when(F.col("branch") == branch, F.col(value).cast("int")))

    values = ("is_correct", "overall_pedagogical_score", "is_silent_error")
    wide = rows.groupBy("model_name", "seed", "example_id").agg(F.count("*").alias("n"), *[of(b, v).alias(f"{k}_{v}") for k, b in zip("pd", two) for v in values]).filter("n = 2")
    return wide.groupBy("seed").agg(F.count("*").alias("n_matched"), *[F.avg(F.col(f"d_{v}") - F.col(f"p_{v}")).alias(f"delta_{v}") for v in values])


def d15_decline_trajectory(spark, sf_dir):
    return declines(bindings.evaluated(spark, sf_dir, shared_ids=True))


def declines(shared: DataFrame) -> DataFrame:
    keys = ["model_name", "branch", "seed", "example_id"]
    wide = shared.groupBy(*keys).agg(*[F.max(F.when(F.col("generation") == g, F.col("overall_pedagogical_score"))).alias(f"score_{g}") for g in range(3)])
    return wide.filter("score_0 > score_1 AND score_1 > score_2").withColumn("decline", F.col("score_0") - F.col("score_2"))


def e01_metrics_by_generation(spark, sf_dir):
    rows = metrics.metrics(bindings.evaluated(spark, sf_dir), ["branch", "generation", "model_name"])
    return rows.select("branch", "generation", "model_name", F.col("accuracy_mean").alias("accuracy"), "pedagogical_score_mean", "silent_error_rate", F.col("sample_count").alias("n"))


def e03_feasibility_summary(spark, sf_dir):
    names = F.array_join(F.array_sort(F.collect_set("model_name")), "|").alias("model_names")
    return metrics.metrics(bindings.evaluated(spark, sf_dir), ["branch", "generation"], names)


def e04_parse_failure(spark, sf_dir):
    rows = bindings.accuracy(bindings.responses(spark, sf_dir))
    bad = (~F.col("pred_parse_success")).cast("int")
    return rows.groupBy(*CTX).agg(F.sum(bad).alias("n_failed"), F.avg(bad).alias("failure_rate"), F.count("*").alias("n_rows"))


def run_level(spark, sf_dir):
    return metrics.metrics(bindings.evaluated(spark, sf_dir), CTX)


def i01_run_level(spark, sf_dir):
    return run_level(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run_seed"), F.col("seed"))).withColumn("evaluation_mode", F.lit("inference"))


def _seed_values(spark, sf_dir):
    return metrics.long_form(run_level(spark, sf_dir), CTX, metrics.METRICS)


def e05_seed_stats(spark, sf_dir):
    out = metrics.spread(_seed_values(spark, sf_dir), ["model_name", "branch", "generation", "metric"])
    return out.select("model_name", "branch", "generation", "metric", "n_seeds", "n_values", *[F.round(c, 9).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])


def e06_bootstrap_ci(spark, sf_dir):
    out = metrics.bootstrap(_seed_values(spark, sf_dir), ["model_name", "branch", "generation", "metric"])
    return out.select("model_name", "branch", "generation", "metric", F.round("boot_low", 9).alias("boot_low"), F.round("boot_high", 9).alias("boot_high"))


def e08_judge_correlation(spark, sf_dir):
    rows = bindings.evaluated(spark, sf_dir)
    return rows.groupBy("branch", "generation").agg(F.round(metrics.correlation(F.col("overall_pedagogical_score"), F.col("clarity")), 9).alias("correlation"), F.count("*").alias("n"))


def e10_branch_summary(spark, sf_dir):
    """Two judgements of a row: the stored score and the sum of two of its parts, doubled."""
    rows = bindings.evaluated(spark, sf_dir).withColumn("new_score", (F.col("clarity") + F.col("structure")) * 2).withColumn("new_silent", F.col("terminology") == 0)
    delta = F.col("new_score") - F.col("overall_pedagogical_score")
    return rows.groupBy("branch", "generation").agg(F.count("*").alias("n"), F.avg(delta).alias("mean_delta"), F.avg(F.abs(delta)).alias("mean_abs_delta"), F.avg((F.col("new_silent") == F.col("is_silent_error")).cast("int")).alias("silent_agreement"))


def e12_pairwise_summary(spark, sf_dir):
    """Win rates overall and by seed, as one pass over grouping sets."""
    rows = _decoded(spark, sf_dir)
    out = rows.rollup("seed").agg(F.count("*").alias("n_pairs"), *[F.avg((F.col("winner_branch") == b).cast("int")).alias(f"{k}_rate") for k, b in (("pure", "pure_recycling"), ("dbr", "dbr_medium"), ("tie", "Tie"))])
    return out.withColumn("scope", F.when(F.col("seed").isNull(), "overall").otherwise("seed"))


def e17_severity_p90(spark, sf_dir):
    return severity_p90(_policy_rows(spark, sf_dir))


def severity_p90(rows: DataFrame) -> DataFrame:
    rows = dbr.flagged(rows)
    return rows.groupBy("branch", "generation").agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"), F.round(F.percentile("severity", 0.9), 9).alias("p90_severity"))


def e20_defect_rates(spark, sf_dir):
    return defect_rates(_policy_rows(spark, sf_dir))


def defect_rates(rows: DataFrame) -> DataFrame:
    rows = policies.pvf(dbr.flagged(rows))
    return dbr.defect_rates(rows, ["branch", "generation"], "kept")


def e20_bucket_coverage(spark, sf_dir):
    return bucket_coverage(_policy_rows(spark, sf_dir))


def bucket_coverage(rows: DataFrame) -> DataFrame:
    rows = policies.pvf(dbr.flagged(rows))
    out = rows.groupBy("branch", "generation", "length_bin").agg(F.count("*").alias("n_before"), F.count(F.when(F.col("kept"), 1)).alias("n_after"))
    total = F.sum("n_after").over(Window.partitionBy("branch", "generation"))
    return out.withColumn("share_after", F.col("n_after") / F.greatest(total, F.lit(1)))


def e21_reason_counts(spark, sf_dir):
    return metrics.reason_counts(policies.soft_pvf(_policy_rows(spark, sf_dir)), ["branch", "generation"], "decision_reason")


def e22_keep_vs_rejected(spark, sf_dir):
    return metrics.kept_and_rest(policies.soft_pvf(_policy_rows(spark, sf_dir)), ["branch"], "kept", ["overall_pedagogical_score", "correct", "silent"])


def e23_keep_repair_reject(spark, sf_dir):
    return metrics.kept_and_rest(policies.repair_actions(_policy_rows(spark, sf_dir)), ["branch"], "action", ["overall_pedagogical_score", "correct", "silent"])


def e24_repair_success(spark, sf_dir):
    rows = policies.repair_actions(_policy_rows(spark, sf_dir), max_chars=40)
    tried = F.col("decision_reason").isin("pedagogical_repair_needed", "repair_failed").cast("int")
    good = (F.col("action") == "repair").cast("int")
    return rows.groupBy("branch", "generation").agg(F.sum(tried).alias("n_attempted"), F.sum(good).alias("n_success"), (F.sum(tried) - F.sum(good)).alias("n_failed"), F.coalesce(F.try_divide(F.sum(good), F.sum(tried)), F.lit(0.0)).alias("success_rate"))


def e25_weight_distribution(spark, sf_dir):
    return policies.soft_pvf(_policy_rows(spark, sf_dir), "soft_pvf_lenient").groupBy("assigned_weight").agg(F.count("*").alias("n"))


def e28_failure_buckets(spark, sf_dir):
    return h15_diagnose(spark, sf_dir).groupBy("branch", "generation", "category").agg(F.count("*").alias("n"))


def e32_collapse_flags(spark, sf_dir):
    return collapse_flags(bindings.evaluated(spark, sf_dir))


def collapse_flags(evaluated: DataFrame) -> DataFrame:
    table_ = metrics.metrics(evaluated, ["seed", "branch", "generation"])
    out = metrics.collapse_flags(table_, ["branch"], {"accuracy_mean": True, "pedagogical_score_mean": True, "silent_error_rate": False})
    return out.select("branch", "metric", "step", "n_values", "flag", *[F.round(c, 9).alias(c) for c in ("mean", "ci_low", "ci_high")])


def e33_gen2_summary(spark, sf_dir):
    return gen2_summary(bindings.evaluated(spark, sf_dir))


def gen2_summary(evaluated: DataFrame) -> DataFrame:
    table_ = metrics.metrics(evaluated.filter("generation = 2"), ["seed", "branch"])
    deltas = metrics.control_deltas(table_, ["seed"], "branch", "pure_recycling", metrics.METRICS)
    rows = metrics.long_form(deltas, ["seed", "branch"], [f"delta_{m}" for m in metrics.METRICS])
    signs = [F.count(F.when(F.col("value") > 0, 1)).alias("n_positive"), F.count(F.when(F.col("value") < 0, 1)).alias("n_negative")]
    stats = metrics.spread(rows, ["branch", "metric"], *signs)
    return stats.select("branch", "metric", "n_positive", "n_negative", *[F.round(c, 9).alias(c) for c in ("mean", "ci_low", "ci_high")])


def _replies(spark, sf_dir):
    """A judge's reply for each judged order: clean, fenced, wrapped in prose, off in its sum, short of a key, or cut off."""
    rows = bindings.judged(bindings.responses(spark, sf_dir))
    body = F.to_json(F.struct(*SCORES[:4], (F.col("overall_pedagogical_score") + (F.col("order_id") % 3 == 0).cast("int")).alias("overall_pedagogical_score"), "is_silent_error", F.lit("ok {\"so\"}").alias("comment")))
    short = F.to_json(F.struct(*SCORES, F.lit("none").alias("comment")))
    kind = F.col("order_id") % 6
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I say "), body, F.lit(" so."))).when(kind == 3, short).when(kind == 4, F.expr("substring(b, 1, length(b) - 2)")).otherwise(F.lit("no object"))
    return rows.withColumn("b", body).withColumn("reply", reply)


def b27_json_extract(spark, sf_dir):
    found = judge_json.json_object(F.col("reply"))
    return _replies(spark, sf_dir).withColumn("_o", found).select("order_id", F.col("_o.found").alias("found"), F.length("_o.body").alias("n_body"))


def b32_judge_parse(spark, sf_dir):
    rows = _replies(spark, sf_dir).select("order_id", judge_json.json_object(F.col("reply")).alias("_o"))
    return rows.select("order_id", "_o.found", judge_json.judge_payload(F.col("_o.body")).alias("_p")).select("order_id", "found", "_p.error", "_p.overall_pedagogical_score", "_p.is_silent_error", "_p.repairs")


def c01_pvf_kept(spark, sf_dir):
    return policies.pvf(_policy_input(spark, sf_dir)).filter("kept").select("order_id", "example_id", "question", "answer_for_training", "source")


def c01_pvf_rejected(spark, sf_dir):
    return policies.pvf(_policy_rows(spark, sf_dir)).filter("NOT kept").select("order_id", "reject_reasons")


def c01_pvf_report(spark, sf_dir):
    return policies.pvf_report(policies.pvf(_policy_rows(spark, sf_dir)), ["branch", "generation"])


def _soft_decisions(spark, sf_dir):
    """All four policies over the same rows, which are read once."""
    rows = _policy_rows(spark, sf_dir)
    parts = [F.col("has_accuracy"), F.col("has_judge"), F.col("pred_parse_success"), F.col("silent"), F.col("correct"), F.col("overall_pedagogical_score")]
    said = F.array(*[F.struct(F.lit(p).alias("policy_name"), quality.soft_weight(p, *parts).alias("w")) for p in quality.SOFT_POLICIES])
    score = hashing.unit_score(F.col("seed"), F.col("branch"), F.col("generation"), F.col("example_id"), "soft_pvf")
    rows = rows.select("order_id", "correct", "overall_pedagogical_score", score.alias("deterministic_score"), F.inline(said))
    kept = quality.weighted_keep(F.col("w.weight"), F.col("deterministic_score"))
    return rows.select("*", F.col("w.weight").alias("assigned_weight"), F.col("w.reason").alias("decision_reason"), kept.alias("kept"))


def c02_soft_decisions(spark, sf_dir):
    return _soft_decisions(spark, sf_dir).select("order_id", "policy_name", "assigned_weight", "decision_reason", "deterministic_score", "kept")


def c02_soft_report(spark, sf_dir):
    rows = policies.soft_pvf(_policy_rows(spark, sf_dir), "soft_pvf_noisy_keep")
    return rows.groupBy("branch", "generation").agg(F.count("*").alias("n_rows"), F.avg(F.col("kept").cast("int")).alias("keep_rate"), F.round(F.avg("assigned_weight"), 9).alias("mean_weight"), F.avg(F.when(F.col("kept"), F.col("correct").cast("int"))).alias("kept_accuracy"))


def c03_dbr_set(spark, sf_dir):
    out = dbr.dbr(dbr.flagged(_policy_rows(spark, sf_dir)), CTX)
    return out.filter("selected").select(*CTX, "example_id")


def c03_dbr_ranked(spark, sf_dir):
    return dbr.dbr(dbr.flagged(_policy_rows(spark, sf_dir)), CTX, dbr.Budgets(ratio=0.6))


def c04_pvr_actions(spark, sf_dir):
    return policies.repair_actions(_policy_rows(spark, sf_dir)).select("order_id", "action", "decision_reason", "repaired_sha256")


def c05_pair_lite_actions(spark, sf_dir):
    rows = policies.repair_actions(_policy_rows(spark, sf_dir), weak="correct_but_pedagogically_weak", max_chars=40)
    return rows.select("order_id", "action", "decision_reason", "repaired_answer", F.when(F.col("action") == "reject", F.lit(None)).otherwise("pair_lite").alias("source_out"))


CSR_KEYS = ["model_name", "branch", "generation", "example_id"]


def _csr(spark, sf_dir):
    return csr_of(bindings.evaluated(spark, sf_dir))


def csr_of(evaluated: DataFrame) -> DataFrame:
    """All answers of a customer in a context are candidates of one example, in the order of their orders."""
    rows = evaluated.withColumn("example_id", F.col("customer"))
    rows = rows.withColumn("candidate_id", F.row_number().over(Window.partitionBy(*CSR_KEYS).orderBy("order_id")) - 1)
    rows = rows.withColumn("correct", F.col("is_correct")).withColumn("silent", F.col("is_silent_error")).withColumn("final_answer", F.col("normalized_predicted"))
    return policies.csr_pairs(rows, CSR_KEYS)


def c06_csr_pairs(spark, sf_dir):
    return _csr(spark, sf_dir).drop("better_response", "weak_response", "final_answer")


def c06_csr_report(spark, sf_dir):
    rows = _csr(spark, sf_dir)
    paired = F.col("pair_status") == "paired"
    return rows.groupBy("branch", "generation").agg(F.count("*").alias("n_examples"), F.count(F.when(paired, 1)).alias("n_pairs"), F.avg(paired.cast("int")).alias("pair_rate"), F.avg(F.when(paired, F.col("quality_gap"))).alias("mean_gap"))


def c06_csr_training(spark, sf_dir):
    rows = _csr(spark, sf_dir).filter("pair_status = 'paired'")
    text = policies.contrastive_text(F.col("example_id"), F.col("weak_response"), F.col("defect_tags"), F.col("better_response"), F.col("final_answer"))
    return rows.select(*CSR_KEYS, text.alias("answer_for_training"))


def _anchor_inputs(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir)
    synthetic = rows.select(*CTX, "example_id", "question", F.col("raw_response").alias("answer_for_training"), F.lit("synthetic").alias("source"))
    p = F.col("p_partkey")
    branch = F.get(F.array(F.lit("pure_recycling"), F.lit("dbr_medium"), F.lit("anchor_20_append")), (F.expr("p_partkey div 2") % 3).cast("int"))
    pool = table(spark, sf_dir, "part").select(
        F.concat(F.lit("model_"), p % 2).alias("model_name"), branch.alias("branch"), (F.expr("p_partkey div 6") % 3).cast("int").alias("generation"),
        (F.expr("p_partkey div 18") % 3 + 211).cast("int").alias("seed"), F.concat(F.lit("a_"), p).alias("example_id"),
        F.concat(F.lit("part "), p).alias("question"), F.concat(F.lit("#### "), p).alias("answer_gold"),
    )
    return synthetic, pool


def _anchored(spark, sf_dir, replace):
    synthetic, pool = _anchor_inputs(spark, sf_dir)
    return policies.anchored(synthetic, pool, CTX, 0.05, replace).select(*CTX, "example_id", "source")


def c07_anchor_append(spark, sf_dir):
    return _anchored(spark, sf_dir, False)


def c07_anchor_replace(spark, sf_dir):
    return _anchored(spark, sf_dir, True)


def c13_used_anchors(spark, sf_dir):
    """Examples that an earlier generation of the branch has used, for each generation."""
    rows = bindings.responses(spark, sf_dir, shared_ids=True).select("branch", "generation", "example_id")
    first = rows.groupBy("branch", "example_id").agg(F.min("generation").alias("first"))
    later = first.withColumn("generation", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter("generation > first")
    return later.groupBy("branch", "generation").agg(F.count("*").alias("n_used"))


def f01_policy_ranks(spark, sf_dir):
    rows = _soft_decisions(spark, sf_dir)
    out = rows.groupBy("policy_name").agg(F.avg(F.col("kept").cast("int")).alias("keep_rate"), F.avg(F.when(F.col("kept"), F.col("correct").cast("int"))).alias("kept_accuracy"), F.avg(F.when(F.col("kept"), F.col("overall_pedagogical_score"))).alias("kept_score"))
    return metrics.ranked(out, {"keep_rate": True, "kept_accuracy": True, "kept_score": True})


def f02_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return resume.latest(rows, ["user_id", "event_type"], ["event_id"])


def f04_duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def f07_generation_deltas(spark, sf_dir):
    return metrics.generation_deltas(run_level(spark, sf_dir), ["model_name", "branch", "seed"], metrics.METRICS)


def f08_branch_deltas(spark, sf_dir):
    return metrics.control_deltas(run_level(spark, sf_dir), ["model_name", "generation", "seed"], "branch", "pure_recycling", metrics.METRICS)


def f09_mode_deltas(spark, sf_dir):
    """The two models stand for training and inference."""
    return metrics.control_deltas(run_level(spark, sf_dir), ["branch", "generation", "seed"], "model_name", "model_0", metrics.METRICS)


def f10_ratio_deltas(spark, sf_dir):
    rows = run_level(spark, sf_dir).withColumn("ratio", F.when(F.col("branch") == "pure_recycling", 0).when(F.col("branch") == "dbr_medium", 10).otherwise(20))
    return metrics.ordered_pairs(rows, ["model_name", "generation", "seed"], ["ratio", "branch"], "ratio", metrics.METRICS)


def g02_splits(spark, sf_dir):
    return sampling.splits(bindings.responses(spark, sf_dir).select("example_id"), "example_id", {"base_train": 500, "anchor_pool": 300, "heldout_test": 200}, 42)


def g05_round_robin(spark, sf_dir):
    rows = bindings.evaluated(spark, sf_dir).withColumn("bucket", quality.score_bucket(F.col("is_silent_error"), F.col("overall_pedagogical_score")))
    out = sampling.round_robin(rows, ["branch", "generation"], "bucket", ["silent", "low", "high", "ordinary"], 10, "example_id")
    return out.select("branch", "generation", "bucket", "example_id", "pick")


def _pairs(spark, sf_dir):
    rows = bindings.evaluated(spark, sf_dir, shared_ids=True).filter("generation = 1 AND branch IN ('pure_recycling', 'dbr_medium')")
    keys = ["model_name", "seed", "example_id"]

    def of(branch, value):
        return F.max(F.when(F.col("branch") == branch, F.col(value)))

    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[of(b, v).alias(f"{k}_{v}") for k, b in (("pure", "pure_recycling"), ("dbr", "dbr_medium")) for v in ("raw_response", "overall_pedagogical_score")])
    return out.filter("n = 2").drop("n").withColumn("pair_key", F.concat_ws("/", *keys))


def g07_balanced_pairs(spark, sf_dir):
    return sampling.balanced(_pairs(spark, sf_dir), "seed", 40, "pair_key").select("seed", "pair_key")


def _blinded(spark, sf_dir):
    rows = sampling.balanced(written(_pairs(spark, sf_dir), "pairs"), "seed", 40, "pair_key")
    return sampling.blinded(rows, F.col("pure_raw_response"), F.col("dbr_raw_response"), "pure_recycling", "dbr_medium", "pair_key")


def g08_blinded_pairs(spark, sf_dir):
    return _blinded(spark, sf_dir).select("pair_id", "pair_key", "response_a", "response_b", "branch_a", "branch_b")


def _decoded(spark, sf_dir):
    score = {"pure_recycling": "pure_overall_pedagogical_score", "dbr_medium": "dbr_overall_pedagogical_score"}
    rows = _blinded(spark, sf_dir)
    a = F.when(F.col("branch_a") == "pure_recycling", F.col(score["pure_recycling"])).otherwise(F.col(score["dbr_medium"]))
    b = F.when(F.col("branch_b") == "pure_recycling", F.col(score["pure_recycling"])).otherwise(F.col(score["dbr_medium"]))
    rows = rows.withColumn("winner", F.when(a > b, "A").when(b > a, "B").otherwise("Tie"))
    return sampling.decoded(rows, "winner", ["pure_recycling", "dbr_medium"])


def g09_decode_winner(spark, sf_dir):
    return _decoded(spark, sf_dir).select("pair_id", "winner", "winner_branch", "pure_recycling_win", "dbr_medium_win")


def g12_silent_candidates(spark, sf_dir):
    rows = bindings.evaluated(spark, sf_dir).filter("is_correct AND is_silent_error AND overall_pedagogical_score <= 2")
    return rows.select(*CTX, "example_id", "overall_pedagogical_score")


def h02_disjoint(spark, sf_dir):
    """Customers that several branches share, for each two branches."""
    return checks.overlaps(bindings.responses(spark, sf_dir, shared_ids=True), "example_id", "branch")


def h03_set_equality(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir)
    return checks.set_differences(rows.select("order_id"), bindings.judged(rows).select("order_id"), ["order_id"])


def h09_summary_recompute(spark, sf_dir):
    """Stored values that are off by a hundredth in one branch, against a recomputation."""
    return summary_recomputed(bindings.evaluated(spark, sf_dir))


def summary_recomputed(evaluated: DataFrame) -> DataFrame:
    computed = metrics.metrics(evaluated, ["branch", "generation"])
    # What is not stored is null, so that both sides are one aggregate to the optimiser.
    missing = (F.col("branch") == "pure_recycling") & (F.col("generation") == 2)
    off = F.col("accuracy_mean") + F.when(F.col("branch") == "dbr_medium", 0.01).otherwise(0.0)
    stored = computed.withColumn("accuracy_mean", off).withColumns({m: F.when(~missing, F.col(m)) for m in metrics.METRICS})
    return checks.compared(stored, computed, ["branch", "generation"], metrics.METRICS).select("branch", "generation", "metric", "status")


def h15_diagnose(spark, sf_dir):
    rows = bindings.accuracy(bindings.responses(spark, sf_dir))
    shown = F.replace(F.coalesce(F.trim("raw_response"), F.lit("")), F.lit(","), F.lit("")) == F.trim("answer_gold")
    category = F.when(F.col("accuracy_label") == "gold_parse_failure", "parse_failure_gold").when(F.col("accuracy_label") == "prediction_parse_failure", "parse_failure_pred").when(F.col("is_correct") & ~shown & (F.col("normalized_predicted") != F.col("normalized_gold")), "normalization_mismatch").when(F.col("is_correct"), "correct").otherwise("model_is_wrong")
    return rows.select("order_id", "branch", "generation", category.alias("category"))


def k01_resume(spark, sf_dir):
    """What is left after a run that has done the even orders, then everything once more: nothing is done twice."""
    rows = bindings.responses(spark, sf_dir).select("order_id", "raw_response")
    first = rows.filter("order_id % 2 = 0").withColumn("attempt", F.lit(1))
    second = resume.pending(rows, first, ["order_id"]).withColumn("attempt", F.lit(2))
    return first.unionByName(second).groupBy("attempt").agg(F.count("*").alias("n"), F.count_distinct("order_id").alias("n_keys"))


def k02_judge_dedupe_fanout(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir).select("order_id", "question", "answer_gold", "raw_response")

    def score(df):
        return df.withColumn("_j", hashing.mock_judgement(F.col("question"), F.col("answer_gold"), F.col("raw_response"))).select("*", F.col("_j.overall_pedagogical_score").alias("score"))

    return resume.scored_once(rows, ["question", "answer_gold", "raw_response"], score, ["score"]).select("order_id", "score")


def k04_unresolved_failures(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return resume.unresolved(events.filter("event_type = 'error'"), events.filter("event_type = 'purchase'"), ["user_id"], ["event_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import re

    return {name: f for name, f in globals().items() if re.match(r"[a-k]\d\d_", name)}
