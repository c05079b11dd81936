"""Queries on training sets, modes, anchors, contracts and reports: what is left of the families, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions import answers, hashing, judge_json, quality, text_rules
from gyre.functions.binding import bound
from gyre.operators import dbr, metrics, policies
from gyre.plans import exports
from gyre.plans import queries as q
from gyre.sources import bindings, runs
from gyre.sources.shared import written
from gyre.sources.tables import table

CTX = bindings.CONTEXT
PURE, ANCHOR, DBR = "pure_recycling", "anchor_20_append", "dbr_medium"


def a02_canonical(spark, sf_dir):
    """Questions in one form: trimmed, the answer as answer_gold, with a stable id and whether the id is unique."""
    rows = bindings.responses(spark, sf_dir).select(F.trim("question").alias("question"), F.trim("answer_gold").alias("answer_gold"), "order_id")
    rows = rows.withColumn("example_id", hashing.stable_id(F.lit("q"), F.col("question"), F.concat("answer_gold", F.lit(":"), F.col("order_id"))))
    return rows.groupBy("example_id").agg(F.max("question").alias("question"), F.max("answer_gold").alias("answer_gold"), (F.count("*") == 1).alias("is_unique"))


def b26_cache_key(spark, sf_dir):
    """The key under which a judgement is kept: a digest of model, rubric version and input."""
    rows = bindings.responses(spark, sf_dir)
    return rows.select("order_id", F.sha2(F.concat_ws("|", "model_name", F.lit("rubric_v1"), F.sha2("question", 256), F.sha2("answer_gold", 256), F.sha2("raw_response", 256)), 256).alias("cache_key"))


def b35_expected_answer(spark, sf_dir):
    """The answer that a repair must keep: the parsed one, the normalised one, or what the text says; null is an error.

    Each of the three says something else here: even orders have the gold text as the parsed answer, those of generation 1 a normalised one that
    is the gold token, and the rest only their text.
    """
    rows = bindings.accuracy(bindings.responses(spark, sf_dir))
    parsed = F.when(F.col("order_id") % 2 == 0, F.col("answer_gold"))
    normalised = F.when(F.col("generation") == 1, F.col("normalized_gold"))
    return rows.select("order_id", F.coalesce(answers.numeric_token(parsed), answers.numeric_token(normalised), answers.extract(F.col("raw_response"))["token"]).alias("expected"))


def b44_seed_list(spark, sf_dir):
    """Seeds of a list as text, one row each, and whether a seed stands in it twice."""
    lists = bindings.responses(spark, sf_dir).groupBy("branch").agg(F.array_join(F.transform(F.array_sort(F.collect_set("seed")), lambda s: F.concat(F.lit(" "), s.cast("string"))), ",").alias("seeds"))
    lists = lists.withColumn("seeds", F.when(F.col("branch") == PURE, F.concat("seeds", F.lit(", 211"))).otherwise(F.col("seeds")))
    rows = lists.select("branch", F.explode(F.split("seeds", ",")).alias("seed")).select("branch", F.trim("seed").try_cast("int").alias("seed"))
    return rows.groupBy("branch", "seed").agg((F.count("*") > 1).alias("repeated"))


def b47_config_hash(spark, sf_dir):
    """A digest of a configuration with its keys in order, the same however they were written."""
    runs = bindings.responses(spark, sf_dir).select("model_name", "seed").distinct()
    config = F.create_map(F.lit("seed"), F.col("seed").cast("string"), F.lit("model"), F.col("model_name"), F.lit("mode"), F.lit("inference"))
    ordered = F.array_join(F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return runs.select("model_name", "seed", F.sha2(ordered, 256).alias("config_hash"))


def c08_legacy_train_set(spark, sf_dir):
    """Synthetic rows and a sample of the anchor pool, as many as the ratio asks or the pool has, over all contexts at once."""
    synthetic, pool = q._anchor_inputs(spark, sf_dir)
    one = lambda df: df.withColumn("run", F.lit("all"))
    out = policies.anchored(one(synthetic), one(pool), ["run"], 0.01)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.min("example_id").alias("first_id"), F.max("example_id").alias("last_id"))


def c09_anchor_safety(spark, sf_dir):
    """Ids that an anchor pool shares with the base and the held-out set, and ids that it repeats: one pass over tagged ids."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("id"), F.lit("pool").alias("side"))
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("base"))
    held = table(spark, sf_dir, "customer").filter("c_custkey > 400").select(F.col("c_custkey").alias("id"), F.lit("heldout"))
    sides = parts.union(base).union(held).groupBy("id").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("pool", "base", "heldout")])
    n = lambda condition: F.count(F.when(F.expr(condition), 1))
    return sides.agg(n("pool > 0 AND base > 0").alias("pool_and_base"), n("pool > 0 AND heldout > 0").alias("pool_and_heldout"), n("pool > 1").alias("pool_repeats"))


#: Branch types by the beginning of a name.
BRANCH_TYPES = (("soft_pvf_", "soft_pvf_medium"), ("dbr_", "dbr_medium"), ("pvr_", "pvr_repair_medium"), ("pair_lite_", "pair_lite_medium"), ("csr_", "csr_medium"), ("pvf_", "pvf_medium"))


def branch_type(declared, name, ratio):
    """The declared type, else by the beginning of the name, else human_anchoring with a ratio, else pure_recycling."""
    by_name = F.lit(None).cast("string")
    for start, kind in reversed(BRANCH_TYPES):
        by_name = F.when(name.startswith(start), kind).otherwise(by_name)
    return F.coalesce(declared, by_name, F.when(F.coalesce(ratio, F.lit(0.0)) > 0, "human_anchoring"), F.lit(PURE))


def c10_branch_type(spark, sf_dir):
    rows = bindings.responses(spark, sf_dir).select("branch", "generation").distinct()
    declared = F.when((F.col("generation") == 2) & (F.col("branch") == PURE), "csr_medium")
    return rows.select("branch", "generation", branch_type(declared, F.col("branch"), F.when(F.col("branch") == ANCHOR, 0.2)).alias("branch_type"))


def c11_csr_candidates(spark, sf_dir):
    """Candidate 0 is the response itself, the others are generated again, by a pure function of order and number."""
    rows = bindings.responses(spark, sf_dir).select("order_id", "raw_response")
    rows = rows.withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
    again = bindings._pick(bindings.RESPONSES, (F.expr("order_id div 5") + F.col("candidate_id") * 3) % len(bindings.RESPONSES))
    return rows.select("order_id", "candidate_id", F.when(F.col("candidate_id") == 0, F.col("raw_response")).otherwise(again).alias("raw_response"))


def c12_scored_candidates(spark, sf_dir):
    """Candidates with the gold answer of their customer's first order: each distinct pair of texts is scored once, then fanned out."""
    rows = bindings.responses(spark, sf_dir)
    gold = rows.groupBy("customer").agg(F.min_by("answer_gold", "order_id").alias("gold"))
    joined = rows.select("order_id", "customer", "raw_response").join(gold, "customer", "left")
    kinds = joined.select("raw_response", "gold").distinct()  # as many as there are different texts
    kinds = bound(kinds, said=answers.extract(F.col("raw_response"))["token"], wanted=answers.gold_token(F.col("gold")))
    kinds = bound(kinds, label=answers.label(F.col("said"), F.col("wanted")))
    return joined.join(kinds, ["raw_response", "gold"]).select("order_id", "label")


def c14_limited_rows(spark, sf_dir):
    """A sample of 25 training rows in hash order; the rows that are needed are chosen in each task first."""
    rows = bindings.responses(spark, sf_dir).select("example_id", "question")
    return rows.orderBy(hashing.hash_order("limit-0", F.col("example_id")), "example_id").limit(25).orderBy("example_id")


def d05_strict_join(spark, sf_dir):
    """Only rows that have accuracy and judgement, by branch and generation."""
    return q._policy_input(spark, sf_dir, partial=False).groupBy("branch", "generation").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("correct"), 1)).alias("n_correct"))


def d08_summary_with_diagnostics(spark, sf_dir):
    """A stored summary with the parse diagnostics of the same contexts, and how many contexts the join has lost."""
    rows = bindings.evaluated(spark, sf_dir, keep_missing=True)
    keys = ["model_name", "branch", "generation"]
    has, failed = F.col("has_judge"), ~F.col("pred_parse_success")
    # Both tables in one pass: a context is in the summary with a judged row, in the diagnostics with any.
    both = rows.groupBy(*keys).agg(F.count(F.when(has, 1)).alias("sample_count"), F.avg(F.when(has, F.col("is_correct").cast("int"))).alias("accuracy_mean"), F.count(F.when(failed, 1)).alias("n_failed"), F.count("*").alias("n_rows"))
    lost = F.sum((F.col("sample_count") == 0).cast("long")).over(Window.partitionBy())
    return both.withColumn("n_lost", lost).filter("sample_count > 0").withColumn("failure_rate", F.col("n_failed") / F.col("n_rows"))


def _mode_rows(spark, sf_dir):
    """Rows that both modes have: even orders stand for training, odd ones for inference; the first order of a key counts."""
    rows = bindings.evaluated(spark, sf_dir).withColumn("mode", F.when(F.col("order_id") % 2 == 0, "training").otherwise("inference"))
    keys = ["seed", "branch", "generation", "customer"]
    values = F.struct("is_correct", "overall_pedagogical_score", "is_silent_error")
    sides = rows.groupBy(*keys).agg(*[F.min_by(F.when(F.col("mode") == m, values), F.when(F.col("mode") == m, F.col("order_id"))).alias(m) for m in ("training", "inference")])
    return sides.filter("training IS NOT NULL AND inference IS NOT NULL")


def d14_mode_rows(spark, sf_dir):
    rows = _mode_rows(spark, sf_dir)
    delta = F.col("training.overall_pedagogical_score") - F.col("inference.overall_pedagogical_score")
    return rows.groupBy("branch", "generation").agg(F.count("*").alias("n_matched"), F.avg(delta).alias("mean_score_delta"), F.avg((F.col("training.is_correct").cast("int") - F.col("inference.is_correct").cast("int"))).alias("mean_correct_delta"))


def g11_mode_examples(spark, sf_dir):
    """Five examples for each way in which modes differ: later generations and better scores first."""
    rows = _mode_rows(spark, sf_dir)
    score = {m: F.col(f"{m}.overall_pedagogical_score") for m in ("training", "inference")}
    right, silent = (lambda m: F.col(f"{m}.is_correct")), (lambda m: F.col(f"{m}.is_silent_error"))
    better = lambda a, b: (score[a] - score[b] >= 1) | (right(a) & ~right(b))
    kinds = [
        ("training_better_than_inference", better("training", "inference") | (~silent("training") & silent("inference")), -score["training"]),
        ("inference_better_than_training", better("inference", "training"), -score["inference"]),
        ("silent_error_mode_disagreement", silent("training") != silent("inference"), F.lit(0)),
    ]
    said = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(name).alias("category"), order.alias("order"))) for name, holds, order in kinds]))
    rows = rows.select("seed", "branch", "generation", "customer", score["training"].alias("score_training"), score["inference"].alias("score_inference"), F.inline(said))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("generation"), "order", "seed", "branch", "customer"))
    return rows.withColumn("place", place).filter("place <= 5").drop("order")


def d16_anchor_gain(spark, sf_dir):
    """Rows of other branches beside the pure row of the same example: how much better they are.  One window, no self-join."""
    rows = bindings.evaluated(spark, sf_dir, shared_ids=True)
    place = Window.partitionBy("seed", "model_name", "generation", "example_id")
    pure = {v: F.max(F.when(F.col("branch") == PURE, F.col(v).cast("int"))).over(place) for v in ("overall_pedagogical_score", "is_correct", "is_silent_error")}
    rows = rows.withColumns({f"pure_{v}": c for v, c in pure.items()}).filter(F.col("pure_is_correct").isNotNull() & (F.col("branch") != PURE))
    gain = F.col("overall_pedagogical_score") - F.col("pure_overall_pedagogical_score")
    better = (gain >= 1) | (F.col("is_correct") & (F.col("pure_is_correct") == 0)) | (~F.col("is_silent_error") & (F.col("pure_is_silent_error") == 1))
    return rows.groupBy("branch", "generation").agg(F.count("*").alias("n_matched"), F.avg(gain).alias("mean_gain"), F.count(F.when(better, 1)).alias("n_better"))


def _ratios(spark):
    return spark.sql("SELECT * FROM VALUES ('dbr_medium', 20, 'replace'), ('anchor_20_append', 20, 'append') AS t(branch, anchor_ratio, mixing_mode)")


def d20_append_replace(spark, sf_dir):
    """Appended against replaced anchors at the same ratio."""
    out = exports.anchoring_ablation(bindings.evaluated(spark, sf_dir), _ratios(spark))["mode_deltas"]
    return out.select("model_name", "generation", "seed", "anchor_ratio", "mixing_mode", "delta_accuracy_mean", "delta_pedagogical_score_mean")


def d21_anchor_pairs_scored(spark, sf_dir):
    """Anchors with the scores of their context; contexts without rows stay, with nulls."""
    _, pool = q._anchor_inputs(spark, sf_dir)
    level = metrics.metrics(bindings.evaluated(spark, sf_dir), CTX)
    pairs = pool.groupBy(*CTX).agg(F.count("*").alias("n_anchors"))
    return pairs.join(level.select(*CTX, "sample_count", "accuracy_mean"), CTX, "left")


def d27_anchor_pairing(spark, sf_dir):
    """Anchors beside the synthetic rows whose place they take, by position in their context."""
    synthetic, pool = q._anchor_inputs(spark, sf_dir)
    at = lambda tag: F.row_number().over(Window.partitionBy(*CTX).orderBy(hashing.hash_order(tag, *[F.col(c) for c in CTX], F.col("example_id")), "example_id"))
    left = pool.select(*CTX, F.col("example_id").alias("anchor_id"), at("anchor").alias("place")).filter("place <= 20")
    right = synthetic.select(*CTX, F.col("example_id").alias("synthetic_id"), at("replace").alias("place")).filter("place <= 20")
    return left.join(right, [*CTX, "place"])


def d29_fingerprint_counts(spark, sf_dir):
    """Responses by branch with how many rows share the text: counted beside the rows, without a join back."""
    rows = bindings.responses(spark, sf_dir).groupBy("branch", F.sha2("raw_response", 256).alias("fingerprint")).agg(F.count("*").alias("n_rows"))
    return rows.withColumn("n_everywhere", F.sum("n_rows").over(Window.partitionBy("fingerprint")))


def d30_corrected_summary(spark, sf_dir):
    """Stored accuracy beside the accuracy by exact comparison, and where it comes from."""
    rows = bindings.evaluated(spark, sf_dir)
    raw = (F.trim("raw_response") == F.trim("answer_gold")).cast("int")
    out = rows.groupBy("model_name", "branch", "generation").agg(F.count("*").alias("sample_count"), F.avg(raw).alias("accuracy_mean"), F.avg(F.col("is_correct").cast("int")).alias("corrected"))
    has = F.col("generation") > 0
    return out.select("model_name", "branch", "generation", "sample_count", F.when(has, F.col("corrected")).otherwise(F.col("accuracy_mean")).alias("accuracy_mean_effective"), F.when(has, "corrected").otherwise("raw_summary").alias("accuracy_source"))


def e02_first_summary(spark, sf_dir):
    return metrics.metrics(bindings.evaluated(spark, sf_dir), ["model_name", "branch", "generation"]).drop("parse_failure_pred_count", "parse_failure_pred_rate")


def e16_collapse_metrics(spark, sf_dir):
    """Eight measures of collapse, and the rows that no judge has seen, which count as silent and low."""
    return collapse_metrics(q._policy_rows(spark, sf_dir))


def collapse_metrics(rows: DataFrame) -> DataFrame:
    rows = dbr.flagged(rows)
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return rows.groupBy("branch", "generation").agg(
        F.count("*").alias("sample_count"), rate("correct").alias("accuracy_mean"), F.avg("overall_pedagogical_score").alias("pedagogical_score_mean"), rate("silent").alias("silent_error_rate"),
        rate("defect_parse_failure").alias("parse_failure_pred_rate"), rate("defect_low_reasoning").alias("low_reasoning_rate"), rate("defect_low_structure").alias("low_structure_rate"),
        F.avg("severity").alias("defect_severity_mean"), F.count(F.when(~F.col("has_judge"), 1)).alias("missing_judge_rows"),
    )


def e34_mechanism_summary(spark, sf_dir):
    """Means over seeds and generations of what a selection does to the defects, for each model."""
    return mechanism_summary(q._policy_rows(spark, sf_dir))


def mechanism_summary(rows: DataFrame) -> DataFrame:
    by = ["model_name", "seed", "generation"]
    decided = written(policies.pvf(dbr.flagged(rows)).select(*by, "kept", *[f"defect_{n}" for n in quality.DEFECTS]), "decided")  # read twice
    deltas = dbr.defect_rates(decided, by, "kept").groupBy("model_name").pivot("defect", ["parse_failure", "silent_error", "incorrect_answer"]).agg(F.round(F.avg("delta"), 9))
    kept = decided.groupBy(*by).agg(F.avg(F.col("kept").cast("int")).alias("rate")).groupBy("model_name").agg(F.round(F.avg("rate"), 9).alias("selection_rate_mean"))
    return deltas.withColumnsRenamed({n: f"{n}_delta_mean" for n in ("parse_failure", "silent_error", "incorrect_answer")}).join(kept, "model_name")


def e35_pvf_seed_stress(spark, sf_dir):
    """Keep rates by context, spread over seeds."""
    report = policies.pvf_report(policies.pvf(q._policy_rows(spark, sf_dir)), CTX)
    long = metrics.long_form(report, CTX, ["keep_rate", "kept_score"])
    out = metrics.spread(long, ["branch", "generation", "metric"])
    return out.select("branch", "generation", "metric", "n_seeds", "n_values", *[F.round(c, 9).alias(c) for c in ("mean", "ci_low", "ci_high")])


def h04_split_integrity(spark, sf_dir):
    """Rows and distinct ids of each split, and how many of its ids stand in another split too."""
    rows = bindings.responses(spark, sf_dir).select("branch", "customer")
    ids = rows.groupBy("customer", "branch").agg(F.count("*").alias("n")).withColumn("splits", F.count("*").over(Window.partitionBy("customer")))
    return ids.groupBy("branch").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.count(F.when(F.col("splits") > 1, 1)).alias("n_shared"))


def h16_artifact_checks(spark, sf_dir):
    """Contexts that the run should have, against those that it has: a stated grid of few values."""
    rows = bindings.responses(spark, sf_dir)
    grid = rows.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in CTX])
    for c in CTX:
        grid = grid.withColumn(c, F.explode(c))
    found = rows.groupBy(*CTX).agg(F.count("*").alias("n_rows"))
    out = grid.join(found, CTX, "left").select(*CTX, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    return out.withColumn("status", F.when(F.col("n_rows") > 0, "ok").otherwise("missing_context"))


def h17_count_consistency(spark, sf_dir):
    """Whether the counts of a context agree; a count of -1 says that there is no such artifact and is left out."""
    rows = bindings.evaluated(spark, sf_dir, keep_missing=True).groupBy(*CTX).agg(F.count("*").alias("n_outputs"), F.count(F.when(F.col("has_judge"), 1)).alias("n_judged"))
    rows = rows.withColumn("n_synthetic", F.when(F.col("generation") == 2, -1).otherwise(F.col("n_outputs")))
    there = F.filter(F.array("n_outputs", "n_judged", "n_synthetic"), lambda n: n >= 0)
    return rows.withColumn("mismatch_flag", F.size(F.array_distinct(there)) > 1)


def i23_run_union(spark, sf_dir):
    """The levels of several families of runs under each other."""
    level = exports.run_level(bindings.evaluated(spark, sf_dir))
    family = F.when(F.col("branch") == DBR, "dbr").when(F.col("branch") == ANCHOR, "anchoring").otherwise("baseline")
    return level.withColumn("family", family).groupBy("family", "generation").agg(F.count("*").alias("n_runs"), F.round(F.avg("accuracy_mean"), 9).alias("accuracy_mean"))


def m02_mode_levels(spark, sf_dir):
    """Levels of two modes; the training mode lacks parse counts and gets defaults and a mark."""
    level = metrics.metrics(bindings.evaluated(spark, sf_dir), CTX)
    inference = level.filter("model_name = 'model_1'").withColumn("source", F.lit("inference"))
    training = level.filter("model_name = 'model_0'").drop("parse_failure_pred_count", "parse_failure_pred_rate").withColumn("source", F.lit("training_summary"))
    out = inference.unionByName(training, allowMissingColumns=True)
    return out.select(*CTX, "source", "sample_count", "accuracy_mean", F.coalesce("parse_failure_pred_count", F.lit(0)).alias("parse_failure_pred_count"), "parse_failure_pred_rate")


def m08_eval_with_questions(spark, sf_dir):
    """Evaluated rows with sub-scores and their question's length; rows without a judgement stay."""
    rows = bindings.evaluated(spark, sf_dir, keep_missing=True)
    return rows.select("order_id", "is_correct", "clarity", "structure", "has_judge", F.length("question").alias("question_length"))


def m27_plan_upsert(spark, sf_dir):
    """A plan with one entry a branch: later entries replace earlier ones."""
    old = bindings.responses(spark, sf_dir).groupBy("branch").agg(F.count("*").alias("n_rows")).withColumn("version", F.lit(1))
    new = old.filter(F.col("branch") != PURE).withColumn("n_rows", F.col("n_rows") * 2).withColumn("version", F.lit(2))
    added = new.limit(1).select(F.lit("csr_medium").alias("branch"), F.lit(0).cast("long").alias("n_rows"), F.lit(2).alias("version"))
    every = old.unionByName(new).unionByName(added)
    return every.groupBy("branch").agg(F.max_by("n_rows", "version").alias("n_rows"), F.max("version").alias("version"))


def _evaluated_and_rows(spark, sf_dir):
    return q.inputs(spark, sf_dir)


def i04_mode_deltas(spark, sf_dir):
    """Even orders as training runs, odd ones as inference runs."""
    rows = bindings.evaluated(spark, sf_dir)
    return exports.mode_comparison(rows.filter("order_id % 2 = 0"), rows.filter("order_id % 2 = 1"))["mode_deltas"].select("seed", "branch", "generation", *[F.round(f"delta_{m}", 9).alias(f"delta_{m}") for m in metrics.METRICS])


def i06_reject_reasons(spark, sf_dir):
    return exports.pvf_report(*_evaluated_and_rows(spark, sf_dir))["reject_reasons"]


def i06_keep_reject_quality(spark, sf_dir):
    return exports.pvf_report(*_evaluated_and_rows(spark, sf_dir))["keep_reject_quality"].select(*CTX, "kept", "n", "mean_correct")


def i08_policy_summary(spark, sf_dir):
    out = exports.soft_report(*_evaluated_and_rows(spark, sf_dir))["policy_summary"]
    return out.select(*CTX, F.round("mean_weight", 9).alias("mean_weight"), "keep_rate", "rank_keep_rate")


def i08_weight_distribution(spark, sf_dir):
    return exports.soft_report(*_evaluated_and_rows(spark, sf_dir))["weight_distribution"]


def i10_bucket_coverage(spark, sf_dir):
    return exports.dbr_report(*_evaluated_and_rows(spark, sf_dir))["bucket_coverage"]


def i10_decision_reasons(spark, sf_dir):
    out = exports.dbr_report(*_evaluated_and_rows(spark, sf_dir))["decision_reasons"]
    return out.groupBy(*CTX).agg(F.sum(F.when(F.col("decision_reason").startswith("selected"), F.col("n")).otherwise(0)).alias("n_selected"), F.sum("n").alias("n"))


def i12_decision_reasons(spark, sf_dir):
    return exports.repair_report(*_evaluated_and_rows(spark, sf_dir))["decision_reasons"]


def i13_pair_lite_success(spark, sf_dir):
    return exports.repair_report(*_evaluated_and_rows(spark, sf_dir), max_chars=40)["repair_success_summary"]


def i14_pair_summary(spark, sf_dir):
    return exports.csr_report(bindings.evaluated(spark, sf_dir), q._csr(spark, sf_dir), ["branch", "generation"])["pair_summary"]


def a05_split_metadata(spark, sf_dir):
    """What is kept beside splits: rows of each, and a digest of their ids in order, which tells one split from another."""
    rows = q.g02_splits(spark, sf_dir)  # at most a thousand ids
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("example_id")), "\n"), 256).alias("ids_sha256"))


def b25_judge_input_key(spark, sf_dir):
    """The key under which equal judge inputs meet: a digest of the trimmed parts, each with its length."""
    rows = bindings.responses(spark, sf_dir)
    parts = [F.concat(F.length(F.trim(c)).cast("string"), F.lit(":"), F.trim(c)) for c in ("question", "answer_gold", "raw_response")]
    return rows.groupBy(F.sha2(F.concat_ws("|", *parts), 256).alias("input_key")).agg(F.count("*").alias("n"))


def b34_pair_payload(spark, sf_dir):
    """Replies of a judge of pairs: good, with a winner in other letters, without a reason, with a bad winner, or no JSON."""
    n = F.col("c_custkey") % 5
    winner = F.when(n == 1, "tie").when(n == 3, "C").otherwise("A")
    reply = F.when(n == 4, F.lit("none")).otherwise(F.to_json(F.struct(winner.alias("winner"), (F.col("c_custkey") % 3).cast("string").alias("confidence"), F.when(n == 2, " ").otherwise("clear").alias("reason"))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", judge_json.json_object(reply).alias("_o"))
    return rows.select("c_custkey", judge_json.pair_payload(F.col("_o.body")).alias("_p")).select("c_custkey", "_p.error", "_p.winner", "_p.confidence")


def b40_retry_after(spark, sf_dir):
    """Waits that servers ask for: seconds, seconds below 0, a date a minute ahead, or nothing that can be read."""
    n = F.col("p_partkey") % 4
    asked = F.when(n == 0, F.lit(" 7 ")).when(n == 1, F.lit("-3")).when(n == 2, F.lit("Wed, 21 Oct 2015 07:28:00 GMT")).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "part").select("p_partkey", text_rules.retry_after(asked, F.to_timestamp(F.lit("2015-10-21 07:27:00"))).alias("wait"))


#: What calls fail with, one of each kind.
FAILURES = ("Read timed out", "HTTP 429 slow down", "status 503", "401 denied", "error 404", "connection refused", "invalid JSON", "odd")


def b41_error_class(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(text_rules.error_class(bindings._pick(FAILURES, F.col("p_partkey") % len(FAILURES))).alias("e"))
    return rows.groupBy("e.category", "e.retryable").agg(F.count("*").alias("n"))


def d01_outputs_with_gold(spark, sf_dir):
    """Outputs joined one to one with the gold answers of their orders; what matches nothing is counted, not dropped."""
    rows = bindings.responses(spark, sf_dir)
    gold = rows.filter("order_id % 13 <> 0").select("order_id", F.col("answer_gold").alias("gold"))
    both = rows.select("order_id", "branch").join(gold, "order_id", "left")
    return both.groupBy("branch").agg(F.count("*").alias("n_rows"), F.count("gold").alias("n_matched"), F.count(F.when(F.col("gold").isNull(), 1)).alias("n_unmatched"))


def d26_kept_ids(spark, sf_dir):
    """Rows whose id a selection has kept: a semi-join, so repeated ids in the selection repeat no row."""
    rows = bindings.responses(spark, sf_dir).select("order_id", "branch", "customer")
    kept = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("cust_"), "c_custkey").alias("customer"))
    return rows.join(kept.union(kept), "customer", "left_semi").groupBy("branch").agg(F.count("*").alias("n"))


def g01_shuffle(spark, sf_dir):
    """The first ten rows of each branch in a reproducible order, pruned in each task before the shuffle."""
    rows = bindings.responses(spark, sf_dir).select("branch", "example_id")
    place = F.row_number().over(Window.partitionBy("branch").orderBy(hashing.hash_order("shuffle-7", F.col("branch"), F.col("example_id")), "example_id"))
    return rows.withColumn("place", place).filter("place <= 10")


def h01_concat(spark, sf_dir):
    """Tables of two branches under each other by name; a column that one lacks is null there."""
    rows = bindings.responses(spark, sf_dir)
    left = rows.filter(F.col("branch") == PURE).select("branch", "seed", F.length("question").alias("size"))
    right = rows.filter(F.col("branch") == DBR).select("seed", "branch")
    return left.unionByName(right, allowMissingColumns=True).groupBy("branch").agg(F.count("*").alias("n"), F.count("size").alias("n_sizes"))


def _written_summaries(spark, sf_dir):
    """A tree of three runs: one with a corrected summary beside the plain one, one with a plain one, one with Parquet only."""
    root = runs.new_tree(spark)
    rows = metrics.metrics(bindings.evaluated(spark, sf_dir), CTX).drop("parse_failure_pred_count", "parse_failure_pred_rate")
    for seed, names in ((211, ("summary_corrected.csv", "summary.csv")), (212, ("summary.csv",)), (213, ("summary.parquet",))):
        one = rows.filter(F.col("seed") == seed).drop("seed").coalesce(1)
        for name in names:
            out = one.withColumn("accuracy_mean_corrected", F.col("accuracy_mean") + 0.25) if "corrected" in name else one
            place = f"{root}/run_seed{seed}/tables/{name}"
            out.write.parquet(place) if name.endswith("parquet") else out.write.option("header", True).csv(place)
    return root


def a13_summaries(spark, sf_dir):
    out = runs.summaries(spark, _written_summaries(spark, sf_dir))
    return out.select("run", "model_name", "branch", "generation", "sample_count", F.round("accuracy_mean_effective", 9).alias("accuracy_mean_effective"), "accuracy_source")


def _written_snapshots(spark, sf_dir):
    """Configurations of the runs in the table, one a seed: its commonest model, its branches with their shares as ratios.

    The seed of the run with the fewest orders stands in its name only, and only runs with more of one branch than of the other say their mode.
    """
    root = runs.new_tree(spark)
    rows = bindings.responses(spark, sf_dir)
    counts = rows.groupBy("seed", "branch").agg(F.count("*").alias("n")).withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("seed")), 6))
    branch = F.struct(F.col("branch").alias("name"), F.col("ratio").alias("anchor_ratio"), F.when(F.col("branch") == ANCHOR, "append").otherwise("none").alias("mixing_mode"))
    of = lambda b: F.coalesce(F.sum(F.when(F.col("branch") == b, F.col("n"))), F.lit(0))
    seeds = counts.groupBy("seed").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(branch)).alias("branches"), F.when(of(PURE) > of(DBR), "training").alias("mode"))
    models = rows.groupBy("seed", "model_name").agg(F.count("*").alias("m")).groupBy("seed").agg(F.max_by("model_name", F.struct("m", "model_name")).alias("base"))
    fewest = F.row_number().over(Window.orderBy("n", "seed")) == 1  # a row a seed
    config = seeds.join(models, "seed").withColumn("known", F.when(~fewest, F.col("seed")))
    config = config.select("seed", F.struct(F.col("known").alias("seed")).alias("project"), F.struct("base").alias("models"), F.struct("mode", "branches").alias("experiment"))
    config = written(config, "configurations")
    for seed in sorted(r["seed"] for r in config.select("seed").collect()):
        config.filter(F.col("seed") == seed).drop("seed").coalesce(1).write.json(f"{root}/run_x_seed{seed}/config.json")
    return root


def m03_snapshots(spark, sf_dir):
    """Seed, mode and base model of each run's configuration, read from the written tree."""
    return runs.snapshots(spark, _written_snapshots(spark, sf_dir)).select("run", "seed", "mode", "base_model")


def m17_branch_specs(spark, sf_dir):
    """Branches of each run's configuration, one row each, read from the written tree."""
    return runs.snapshots(spark, _written_snapshots(spark, sf_dir)).select("seed", F.inline("branches"))


def m26_contexts(spark, sf_dir):
    """Rows of each context, from the paths of the artifacts."""
    root = runs.new_tree(spark)
    rows = bindings.responses(spark, sf_dir).filter("model_name = 'model_0' AND seed = 211").select("branch", "generation", "order_id")
    for branch in (PURE, DBR):
        for generation in (0, 2):
            rows.filter((F.col("branch") == branch) & (F.col("generation") == generation)).coalesce(1).write.parquet(f"{root}/run_seed211/model_0/{branch}/gen_{generation}/outputs.parquet")
    return runs.contexts(spark, root, "outputs.parquet")


def queries():
    return {name: f for name, f in globals().items() if re.match(r"[a-m]\d\d_", name)}


_C = "model_name, branch, generation, seed"
_ORD = "sha256(concat_ws('|', '{}', model_name, branch, generation::VARCHAR, seed::VARCHAR, example_id)), example_id"
_POOL = """, pool AS (SELECT 'model_' || (p_partkey % 2) AS model_name, ['pure_recycling', 'dbr_medium', 'anchor_20_append'][((p_partkey // 2) % 3 + 1)::INT] AS branch,
  ((p_partkey // 6) % 3)::INT AS generation, ((p_partkey // 18) % 3 + 211)::INT AS seed, 'a_' || p_partkey AS example_id, 'part ' || p_partkey AS question, '#### ' || p_partkey AS answer FROM part)"""
_MODES = """, mr AS (SELECT seed, branch, generation, customer, order_id % 2 = 0 AS training, {'c': is_correct, 's': overall_pedagogical_score, 'e': is_silent_error} AS v,
    row_number() OVER (PARTITION BY seed, branch, generation, customer, order_id % 2 ORDER BY order_id) AS k FROM ev),
  mm AS (SELECT t.seed, t.branch, t.generation, t.customer, t.v AS t, i.v AS i FROM mr AS t JOIN mr AS i ON (t.seed, t.branch, t.generation, t.customer) = (i.seed, i.branch, i.generation, i.customer)
    WHERE t.k = 1 AND i.k = 1 AND t.training AND NOT i.training)"""

SQL = {
    "a02_canonical": "SELECT example_id, max(q) AS question, max(g) AS answer_gold, count(*) = 1 AS is_unique FROM (SELECT trim(question) AS q, trim(answer_gold) AS g, 'q_' || substr(sha256('q' || chr(10) || trim(question) || chr(10) || trim(trim(answer_gold) || ':' || order_id)), 1, 16) AS example_id FROM resp) GROUP BY 1",
    "b26_cache_key": "SELECT order_id, sha256(concat_ws('|', model_name, 'rubric_v1', sha256(question), sha256(answer_gold), sha256(raw_response))) AS cache_key FROM resp",
    "b35_expected_answer": "SELECT order_id, coalesce(CASE WHEN order_id % 2 = 0 THEN {gold} END, CASE WHEN generation = 1 THEN normalized_gold END, normalized_predicted) AS expected FROM ext",
    "b44_seed_list": "SELECT branch, seed, branch = 'pure_recycling' AND seed = 211 AS repeated FROM (SELECT DISTINCT branch, seed FROM resp)",
    "b47_config_hash": "SELECT DISTINCT model_name, seed, sha256('mode=inference;model=' || model_name || ';seed=' || seed) AS config_hash FROM resp",
    "c08_legacy_train_set": _POOL + """, k AS (SELECT round_even(count(*) * 0.01::DOUBLE, 0)::BIGINT AS need FROM resp),
      a AS (SELECT example_id, row_number() OVER (ORDER BY sha256('anchor|all|' || example_id), example_id) AS n FROM pool)
      SELECT 'synthetic' AS source, count(*) AS n, min(example_id) AS first_id, max(example_id) AS last_id FROM resp UNION ALL SELECT 'human_anchor', count(*), min(example_id), max(example_id) FROM a, k WHERE n <= need""",
    "c09_anchor_safety": """, p AS (SELECT p_partkey % 500 AS id, count(*) AS n FROM part GROUP BY 1)
      SELECT count(*) FILTER (id IN (SELECT s_suppkey FROM supplier)) AS pool_and_base, count(*) FILTER (id IN (SELECT c_custkey FROM customer WHERE c_custkey > 400)) AS pool_and_heldout, count(*) FILTER (n > 1) AS pool_repeats FROM p""",
    "c10_branch_type": """, r AS (SELECT * FROM (VALUES (1, 'soft_pvf_', 'soft_pvf_medium'), (2, 'dbr_', 'dbr_medium'), (3, 'pvr_', 'pvr_repair_medium'), (4, 'pair_lite_', 'pair_lite_medium'), (5, 'csr_', 'csr_medium'), (6, 'pvf_', 'pvf_medium')) AS t(n, start, kind)),
      b AS (SELECT DISTINCT branch, generation, CASE WHEN generation = 2 AND branch = 'pure_recycling' THEN 'csr_medium' END AS declared, regexp_extract(branch, '_(\\d+)_', 1) AS ratio FROM resp)
      SELECT branch, generation, coalesce(any_value(declared), arg_min(kind, n), CASE WHEN any_value(nullif(ratio, ''))::INT > 0 THEN 'human_anchoring' END, 'pure_recycling') AS branch_type FROM b LEFT JOIN r ON starts_with(branch, start) GROUP BY branch, generation""",
    "c11_csr_candidates": """, n AS (SELECT DISTINCT (order_id // 5) % 10 AS kind, raw_response FROM resp), c AS (SELECT order_id, unnest([0, 1, 2]) AS candidate_id FROM resp)
      SELECT c.order_id, candidate_id, n.raw_response FROM c JOIN n ON n.kind = (c.order_id // 5 + candidate_id * 3) % 10""",
    "c12_scored_candidates": """, f AS (SELECT customer, arg_min(normalized_gold, order_id) AS g, arg_min(order_id, order_id) AS o FROM ext GROUP BY 1),
      j AS (SELECT e.order_id, e.normalized_predicted AS p, x.normalized_gold AS g FROM ext AS e JOIN f USING (customer) JOIN ext AS x ON x.order_id = f.o)
      SELECT order_id, CASE WHEN g IS NULL THEN 'gold_parse_failure' WHEN p IS NULL THEN 'prediction_parse_failure' WHEN {same} THEN 'correct' ELSE 'incorrect' END AS label FROM j""",
    "c14_limited_rows": "SELECT example_id, question FROM resp ORDER BY sha256('limit-0|' || example_id), example_id LIMIT 25",
    "d05_strict_join": "SELECT branch, generation, count(*) AS n_rows, count(*) FILTER (is_correct) AS n_correct FROM ev GROUP BY ALL",
    "d08_summary_with_diagnostics": "SELECT model_name, branch, generation, count(*) FILTER (has_judge) AS sample_count, avg(is_correct::INT) FILTER (has_judge) AS accuracy_mean, count(*) FILTER (NOT pred_parse_success) AS n_failed, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT model_name, branch, generation FROM acc) AS a ANTI JOIN ev USING (model_name, branch, generation)) AS n_lost, avg((NOT pred_parse_success)::INT) AS failure_rate FROM part_ev GROUP BY 1, 2, 3",
    "d14_mode_rows": _MODES + " SELECT branch, generation, count(*) AS n_matched, avg(t.s - i.s) AS mean_score_delta, avg(t.c::INT - i.c::INT) AS mean_correct_delta FROM mm GROUP BY ALL",
    "g11_mode_examples": _MODES + """, k AS (
        SELECT *, 'training_better_than_inference' AS category, -t.s AS o FROM mm WHERE t.s - i.s >= 1 OR (t.c AND NOT i.c) OR (NOT t.e AND i.e)
        UNION ALL SELECT *, 'inference_better_than_training', -i.s FROM mm WHERE i.s - t.s >= 1 OR (i.c AND NOT t.c) UNION ALL SELECT *, 'silent_error_mode_disagreement', 0 FROM mm WHERE t.e <> i.e)
      SELECT seed, branch, generation, customer, t.s AS score_training, i.s AS score_inference, category, place FROM (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY generation DESC, o, seed, branch, customer) AS place FROM k) WHERE place <= 5""",
    "d16_anchor_gain": """SELECT a.branch, a.generation, count(*) AS n_matched, avg(a.overall_pedagogical_score - p.overall_pedagogical_score) AS mean_gain,
        count(*) FILTER (a.overall_pedagogical_score - p.overall_pedagogical_score >= 1 OR (a.is_correct AND NOT p.is_correct) OR (NOT a.is_silent_error AND p.is_silent_error)) AS n_better
      FROM pev AS a JOIN pev AS p ON (a.seed, a.model_name, a.generation, a.example_id) = (p.seed, p.model_name, p.generation, p.example_id) AND p.branch = 'pure_recycling' AND a.branch <> 'pure_recycling' GROUP BY 1, 2""",
    "d20_append_replace": """SELECT l.model_name, l.generation, l.seed, 20 AS anchor_ratio, 'append' AS mixing_mode, r.accuracy_mean - l.accuracy_mean AS delta_accuracy_mean, r.pedagogical_score_mean - l.pedagogical_score_mean AS delta_pedagogical_score_mean
      FROM lvl AS l JOIN lvl AS r ON (l.model_name, l.generation, l.seed) = (r.model_name, r.generation, r.seed) AND l.branch = 'dbr_medium' AND r.branch = 'anchor_20_append'""",
    "d21_anchor_pairs_scored": _POOL + f" SELECT {_C}, n_anchors, sample_count, accuracy_mean FROM (SELECT {_C}, count(*) AS n_anchors FROM pool GROUP BY ALL) LEFT JOIN (SELECT {_C}, sample_count, accuracy_mean FROM lvl) USING ({_C})",
    "d27_anchor_pairing": _POOL + f""" SELECT {_C}, place, anchor_id, synthetic_id FROM (SELECT {_C}, example_id AS anchor_id, row_number() OVER (PARTITION BY {_C} ORDER BY {_ORD.format("anchor")}) AS place FROM pool)
      JOIN (SELECT {_C}, example_id AS synthetic_id, row_number() OVER (PARTITION BY {_C} ORDER BY {_ORD.format("replace")}) AS place FROM resp) USING ({_C}, place) WHERE place <= 20""",
    "d29_fingerprint_counts": "SELECT branch, fingerprint, n_rows, sum(n_rows) OVER (PARTITION BY fingerprint)::BIGINT AS n_everywhere FROM (SELECT branch, sha256(raw_response) AS fingerprint, count(*) AS n_rows FROM resp GROUP BY ALL)",
    "d30_corrected_summary": "SELECT model_name, branch, generation, count(*) AS sample_count, CASE WHEN generation > 0 THEN avg(is_correct::INT) ELSE avg((trim(raw_response) = trim(answer_gold))::INT) END AS accuracy_mean_effective, CASE WHEN generation > 0 THEN 'corrected' ELSE 'raw_summary' END AS accuracy_source FROM ev GROUP BY 1, 2, 3",
    "e02_first_summary": "SELECT model_name, branch, generation, count(*) AS sample_count, avg(is_correct::INT) AS accuracy_mean, avg(overall_pedagogical_score) AS pedagogical_score_mean, avg(is_silent_error::INT) AS silent_error_rate FROM ev GROUP BY 1, 2, 3",
    "e16_collapse_metrics": "SELECT branch, generation, count(*) AS sample_count, avg(correct::INT) AS accuracy_mean, avg(overall_pedagogical_score) AS pedagogical_score_mean, avg(silent::INT) AS silent_error_rate, avg(defect_parse_failure::INT) AS parse_failure_pred_rate, avg(defect_low_reasoning::INT) AS low_reasoning_rate, avg(defect_low_structure::INT) AS low_structure_rate, avg(severity) AS defect_severity_mean, count(*) FILTER (NOT has_judge) AS missing_judge_rows FROM sev GROUP BY 1, 2",
    "e34_mechanism_summary": """, g AS (SELECT model_name, seed, generation, avg(kept::INT) AS rate, """ + ", ".join(f"coalesce(avg(defect_{n}::INT) FILTER (kept), 0) - avg(defect_{n}::INT) AS {n}" for n in ("parse_failure", "silent_error", "incorrect_answer")) + """ FROM pvf GROUP BY 1, 2, 3)
      SELECT model_name, round(avg(parse_failure), 9) AS parse_failure_delta_mean, round(avg(silent_error), 9) AS silent_error_delta_mean, round(avg(incorrect_answer), 9) AS incorrect_answer_delta_mean, round(avg(rate), 9) AS selection_rate_mean FROM g GROUP BY 1""",
    "e35_pvf_seed_stress": f""", g AS (SELECT {_C}, avg(kept::INT) AS keep_rate, avg(overall_pedagogical_score) FILTER (kept) AS kept_score FROM pvf GROUP BY ALL),
      l AS (SELECT branch, generation, seed, 'keep_rate' AS metric, keep_rate AS v FROM g UNION ALL SELECT branch, generation, seed, 'kept_score', kept_score FROM g),
      t AS (SELECT branch, generation, metric, count(DISTINCT seed) FILTER (v IS NOT NULL) AS n_seeds, count(v) AS n_values, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM l GROUP BY 1, 2, 3)
      SELECT branch, generation, metric, n_seeds, n_values, round(m, 9) AS mean, round(m - CASE WHEN n_values > 1 THEN 1.96 * s / sqrt(n_values) ELSE 0 END, 9) AS ci_low, round(m + CASE WHEN n_values > 1 THEN 1.96 * s / sqrt(n_values) ELSE 0 END, 9) AS ci_high FROM t""",
    "h04_split_integrity": "SELECT branch, sum(n)::BIGINT AS n_rows, count(*) AS n_ids, count(*) FILTER (k > 1) AS n_shared FROM (SELECT *, count(*) OVER (PARTITION BY customer) AS k FROM (SELECT customer, branch, count(*) AS n FROM resp GROUP BY ALL)) GROUP BY branch",
    "h16_artifact_checks": f"""SELECT {_C}, coalesce(n, 0)::BIGINT AS n_rows, CASE WHEN n > 0 THEN 'ok' ELSE 'missing_context' END AS status FROM (FROM (SELECT DISTINCT model_name FROM resp), (SELECT DISTINCT branch FROM resp), (SELECT DISTINCT generation FROM resp), (SELECT DISTINCT seed FROM resp))
      LEFT JOIN (SELECT {_C}, count(*) AS n FROM resp GROUP BY ALL) USING ({_C})""",
    "h17_count_consistency": f"SELECT {_C}, count(*) AS n_outputs, count(*) FILTER (has_judge) AS n_judged, CASE WHEN generation = 2 THEN -1 ELSE count(*) END AS n_synthetic, count(*) <> count(*) FILTER (has_judge) AS mismatch_flag FROM part_ev GROUP BY {_C}",
    "i23_run_union": "SELECT CASE branch WHEN 'dbr_medium' THEN 'dbr' WHEN 'anchor_20_append' THEN 'anchoring' ELSE 'baseline' END AS family, generation, count(*) AS n_runs, round(avg(accuracy_mean), 9) AS accuracy_mean FROM lvl GROUP BY 1, 2",
    "m02_mode_levels": f"SELECT {_C}, CASE model_name WHEN 'model_1' THEN 'inference' ELSE 'training_summary' END AS source, sample_count, accuracy_mean, CASE model_name WHEN 'model_1' THEN parse_failure_pred_count ELSE 0 END AS parse_failure_pred_count, CASE model_name WHEN 'model_1' THEN parse_failure_pred_rate END AS parse_failure_pred_rate FROM lvl",
    "m08_eval_with_questions": "SELECT order_id, is_correct, clarity, structure, has_judge, length(question) AS question_length FROM part_ev",
    "m27_plan_upsert": "SELECT branch, count(*) * CASE branch WHEN 'pure_recycling' THEN 1 ELSE 2 END AS n_rows, CASE branch WHEN 'pure_recycling' THEN 1 ELSE 2 END AS version FROM resp GROUP BY branch UNION ALL SELECT 'csr_medium', 0, 2",
    "i04_mode_deltas": """, g AS (SELECT model_name, seed, branch, generation, order_id % 2 = 0 AS t, avg(is_correct::INT) AS a, avg(overall_pedagogical_score) AS p, avg(is_silent_error::INT) AS s FROM ev GROUP BY ALL),
      h AS (SELECT seed, branch, generation, t, avg(a) AS a, avg(p) AS p, avg(s) AS s FROM g GROUP BY 1, 2, 3, 4)
      SELECT x.seed, x.branch, x.generation, round(x.a - y.a, 9) AS delta_accuracy_mean, round(x.p - y.p, 9) AS delta_pedagogical_score_mean, round(x.s - y.s, 9) AS delta_silent_error_rate
      FROM h AS x JOIN h AS y ON (x.seed, x.branch, x.generation) = (y.seed, y.branch, y.generation) AND x.t AND NOT y.t""",
    "i06_reject_reasons": f"SELECT {_C}, reason, count(*) AS n FROM (SELECT {_C}, unnest(string_split(reject_reasons, '|')) AS reason FROM pvf WHERE NOT kept) GROUP BY ALL",
    "i06_keep_reject_quality": f"SELECT {_C}, kept, count(*) AS n, avg(correct::INT) AS mean_correct FROM pvf GROUP BY ALL",
    "i08_policy_summary": f""", g AS (SELECT r.model_name, r.branch, r.generation, r.seed, avg(kept::INT) AS keep_rate, round(avg(assigned_weight), 9) AS mean_weight FROM soft JOIN resp AS r USING (order_id) WHERE policy_name = 'soft_pvf_medium' GROUP BY ALL)
      SELECT *, rank() OVER (PARTITION BY seed ORDER BY keep_rate DESC) AS rank_keep_rate FROM g WHERE generation = (SELECT max(generation) FROM g)""",
    "i08_weight_distribution": "SELECT r.model_name, r.branch, r.generation, r.seed, assigned_weight, count(*) AS n FROM soft JOIN resp AS r USING (order_id) WHERE policy_name = 'soft_pvf_medium' GROUP BY ALL",
    "i10_bucket_coverage": f"SELECT {_C}, length_bin, count(*) AS n_before, count(*) FILTER (NOT defect_parse_failure) AS n_after FROM sev GROUP BY ALL",
    "i10_decision_reasons": f"SELECT {_C}, count(*) FILTER (NOT defect_parse_failure) AS n_selected, count(*) AS n FROM sev GROUP BY ALL",
    "i12_decision_reasons": f"SELECT {_C}, CASE state WHEN 'weak' THEN 'pedagogical_repair_needed' ELSE state END AS decision_reason, count(*) AS n FROM rep GROUP BY ALL",
    "i13_pair_lite_success": f"SELECT {_C}, count(*) FILTER (state = 'weak') AS n_attempted, count(*) FILTER (state = 'weak' AND length(rewritten) <= 40) AS n_success, coalesce(count(*) FILTER (state = 'weak' AND length(rewritten) <= 40) / nullif(count(*) FILTER (state = 'weak'), 0), 0) AS success_rate FROM rep GROUP BY {_C}",
    "a05_split_metadata": "SELECT split, count(*) AS n_rows, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS ids_sha256 FROM (SELECT example_id, CASE WHEN k <= 500 THEN 'base_train' WHEN k <= 800 THEN 'anchor_pool' ELSE 'heldout_test' END AS split FROM (SELECT example_id, row_number() OVER (ORDER BY sha256('split-42|' || example_id), example_id) AS k FROM resp) WHERE k <= 1000) GROUP BY split",
    "b25_judge_input_key": "SELECT sha256(concat_ws('|', length(trim(question)) || ':' || trim(question), length(trim(answer_gold)) || ':' || trim(answer_gold), length(trim(raw_response)) || ':' || trim(raw_response))) AS input_key, count(*) AS n FROM resp GROUP BY 1",
    "b34_pair_payload": "SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN 'blank_reason' WHEN 3 THEN 'bad_winner' WHEN 4 THEN 'no_json_object' END AS error, CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'Tie' END AS winner, CASE WHEN c_custkey % 5 < 2 THEN (c_custkey % 3)::INT END AS confidence FROM customer",
    "b40_retry_after": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 7.0 WHEN 1 THEN 0.0 WHEN 2 THEN 60.0 END::DOUBLE AS wait FROM part",
    "b41_error_class": "SELECT category, category IN ('network_timeout', 'network_transport', 'quota_or_rate_limit', 'server_error') AS retryable, count(*) AS n FROM (SELECT ['network_timeout', 'quota_or_rate_limit', 'server_error', 'auth', 'request', 'network_transport', 'bad_payload', 'unknown'][(p_partkey % 8 + 1)::INT] AS category FROM part) GROUP BY 1",
    "d01_outputs_with_gold": "SELECT branch, count(*) AS n_rows, count(*) FILTER (order_id % 13 <> 0) AS n_matched, count(*) FILTER (order_id % 13 = 0) AS n_unmatched FROM resp GROUP BY 1",
    "d26_kept_ids": "SELECT branch, count(*) AS n FROM resp WHERE customer IN (SELECT 'cust_' || c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1",
    "g01_shuffle": "SELECT branch, example_id, place FROM (SELECT branch, example_id, row_number() OVER (PARTITION BY branch ORDER BY sha256('shuffle-7|' || branch || '|' || example_id), example_id) AS place FROM resp) WHERE place <= 10",
    "h01_concat": "SELECT branch, count(*) AS n, CASE branch WHEN 'pure_recycling' THEN count(*) ELSE 0 END AS n_sizes FROM resp WHERE branch IN ('pure_recycling', 'dbr_medium') GROUP BY 1",
    "a13_summaries": "SELECT 'run_seed' || seed AS run, model_name, branch, generation, sample_count, round(accuracy_mean + CASE WHEN seed = 211 THEN 0.25 ELSE 0 END, 9) AS accuracy_mean_effective, CASE WHEN seed = 211 THEN 'corrected' ELSE 'raw_summary' END AS accuracy_source FROM lvl",
    "m03_snapshots": """, m AS (SELECT seed, model_name, count(*) AS n FROM resp GROUP BY ALL)
      SELECT 'run_x_seed' || seed AS run, seed, CASE WHEN count(*) FILTER (branch = 'pure_recycling') > count(*) FILTER (branch = 'dbr_medium') THEN 'training' ELSE 'inference' END AS mode,
        (SELECT model_name FROM m WHERE m.seed = resp.seed ORDER BY n DESC, model_name DESC LIMIT 1) AS base_model FROM resp GROUP BY seed""",
    "m17_branch_specs": "SELECT seed, branch AS name, round(count(*) / sum(count(*)) OVER (PARTITION BY seed), 6) AS anchor_ratio, CASE branch WHEN 'anchor_20_append' THEN 'append' ELSE 'none' END AS mixing_mode FROM resp GROUP BY seed, branch",
    "m26_contexts": "SELECT 'run_seed211' AS run, model_name AS model_dir, branch, generation, count(*) AS n_rows FROM resp WHERE model_name = 'model_0' AND seed = 211 AND generation IN (0, 2) AND branch IN ('pure_recycling', 'dbr_medium') GROUP BY ALL",
    "i14_pair_summary": "SELECT branch, generation, count(*) AS n_examples, avg((pair_status = 'paired')::INT) AS pair_rate FROM csr GROUP BY ALL",
}


def oracle_sql():
    from gyre.plans import oracles

    return {name: oracles.BASE + sql.replace("{same}", oracles._same("p", "g")).replace("{gold}", oracles._token("answer_gold")) for name, sql in SQL.items()}
