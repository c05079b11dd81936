"""Row selection: threshold and weighted filters, repair, contrastive pairs, anchors.

Inputs are separate tables of training rows, accuracy and judgements.  policy_input() joins them once; all
decisions are then columns, so that a policy adds no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions import quality
from gyre.functions.hashing import hash_order, unit_score
from gyre.sources.shared import null_safe_join, running

ACCURACY = ["pred_parse_success", "is_correct", "accuracy_label"]
JUDGEMENT = ["overall_pedagogical_score", "is_silent_error", "reasoning_soundness", "structure", "clarity", "terminology"]


def policy_input(synthetic: DataFrame, accuracy: DataFrame, judge: DataFrame, keys: list[str], partial: bool = True) -> DataFrame:
    """Training rows with accuracy and judgement columns and has_accuracy, has_judge.  Not partial: only complete rows."""
    how = "left" if partial else "inner"
    rows = synthetic.join(accuracy.select(*keys, *ACCURACY, F.lit(True).alias("has_accuracy")), keys, how)
    rows = rows.join(judge.select(*keys, *JUDGEMENT, F.lit(True).alias("has_judge")), keys, how)
    return with_states(rows)


def with_states(rows: DataFrame) -> DataFrame:
    """rows with accuracy and judgement columns, where nulls say missing, with what decisions read: flags, correct and silent."""
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_accuracy", "has_judge", "pred_parse_success")})
    correct = quality.effectively_correct(F.col("is_correct"), F.col("accuracy_label"))
    return rows.withColumn("correct", correct).withColumn("silent", F.coalesce("is_silent_error", F.lit(True)))


def pvf_reasons(threshold: int = 5) -> list[tuple[Column, str]]:
    """Why a row may be rejected, in fixed order."""
    score = F.coalesce(F.col("overall_pedagogical_score") >= threshold, F.lit(False))
    return [
        (~F.col("has_accuracy"), "missing_accuracy_row"),
        (~F.col("has_judge"), "missing_judge_row"),
        (~F.col("pred_parse_success"), "pred_parse_failure"),
        (~F.col("correct"), "accuracy_incorrect"),
        (~score, "pedagogical_below_threshold"),
        (F.col("silent"), "silent_error_true"),
    ]


def pvf(rows: DataFrame, threshold: int = 5) -> DataFrame:
    """rows with kept and reject_reasons: those that hold, joined by bars."""
    text = F.concat_ws("|", *[F.when(failed, F.lit(reason)) for failed, reason in pvf_reasons(threshold)])
    return rows.withColumn("reject_reasons", text).withColumn("kept", F.col("reject_reasons") == "")


def pvf_reason_counts(rows: DataFrame, by: list[str], threshold: int = 5) -> DataFrame:
    """Rows that each reason rejects, counted side by side in one pass; reasons that reject none are left out."""
    reasons = pvf_reasons(threshold)
    counts = rows.groupBy(*by).agg(*[F.count(F.when(failed, 1)).alias(name) for failed, name in reasons])
    out = F.array(*[F.struct(F.lit(name).alias("reason"), F.col(name).alias("n")) for _, name in reasons])
    return counts.select(*by, F.inline(out)).filter("n > 0")


def pvf_report(decided: DataFrame, by: list[str]) -> DataFrame:
    """Counts, the keep rate, and the mean score and accuracy of kept and rejected rows."""

    def mean(value: Column, kept: bool) -> Column:
        return F.avg(F.when(F.col("kept") == kept, value.cast("double")))

    score, right = F.col("overall_pedagogical_score"), F.coalesce(F.col("is_correct"), F.lit(False)).cast("int")
    return decided.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.col("kept"), 1)).alias("n_kept"),
        F.avg(F.col("kept").cast("int")).alias("keep_rate"),
        mean(score, True).alias("kept_score"), mean(score, False).alias("rejected_score"),
        mean(right, True).alias("kept_accuracy"), mean(right, False).alias("rejected_accuracy"),
    )


def soft_pvf(rows: DataFrame, policy: str = "soft_pvf_medium", score: Column | None = None) -> DataFrame:
    """rows with assigned_weight, decision_reason, deterministic_score and kept."""
    said = quality.soft_weight(policy, F.col("has_accuracy"), F.col("has_judge"), F.col("pred_parse_success"), F.col("silent"), F.col("correct"), F.col("overall_pedagogical_score"))
    score = unit_score(F.col("seed"), F.col("branch"), F.col("generation"), F.col("example_id"), "soft_pvf") if score is None else score
    out = rows.withColumn("_w", said).withColumn("assigned_weight", F.col("_w.weight")).withColumn("decision_reason", F.col("_w.reason")).drop("_w")
    return out.withColumn("deterministic_score", score).withColumn("kept", quality.weighted_keep(F.col("assigned_weight"), score)).withColumn("policy_name", F.lit(policy))


def repaired_text(row_text: Column, token: Column) -> Column:
    """A deterministic rewriter that stands in for a model: the response, then its final answer on a line of its own."""
    return F.concat(row_text, F.lit("\nFinal answer: "), token)


def repair_actions(rows: DataFrame, threshold: int = 6, weak: str = "pedagogical_repair_needed", has_gold: Column | None = None, repaired: Column | None = None, repair_ok: Column | None = None, max_chars: int | None = None) -> DataFrame:
    """rows with action (keep_original, repair or reject), decision_reason and repaired text.

    Rejections go in the order of the reasons; a good score keeps; all else, a null score too, is repaired, and
    rejected if the repair fails.
    """
    gold = F.lit(True) if has_gold is None else has_gold
    text = repaired_text(F.col("answer_for_training"), F.col("normalized_predicted")) if repaired is None else repaired
    fine = F.coalesce(F.length(text) > 0, F.lit(False)) if repair_ok is None else repair_ok
    if max_chars is not None:
        fine = fine & (F.length(text) <= max_chars)
    reason = (
        F.when(~F.col("has_accuracy"), "missing_accuracy_row").when(~F.col("has_judge"), "missing_judge_row").when(~gold, "missing_gold_row")
        .when(~F.col("pred_parse_success"), "pred_parse_failure").when(F.col("silent"), "silent_error_true").when(~F.col("correct"), "accuracy_incorrect")
        .when(F.coalesce(F.col("overall_pedagogical_score") >= threshold, F.lit(False)), "high_quality").when(fine, weak).otherwise("repair_failed")
    )
    out = rows.withColumn("decision_reason", reason)
    out = out.withColumn("action", F.when(F.col("decision_reason") == "high_quality", "keep_original").when(F.col("decision_reason") == weak, "repair").otherwise("reject"))
    return out.withColumn("repaired_answer", F.when(F.col("action") == "repair", text)).withColumn("repaired_sha256", F.sha2("repaired_answer", 256))


def csr_pairs(candidates: DataFrame, keys: list[str], gap: float = 2.0, best_correct: bool = True, best_not_silent: bool = True, worst_incorrect: bool = True, worst_silent: bool = True) -> DataFrame:
    """The best and the worst candidate of each example, and why they make no pair, if so.

    Both are maxima of structs, so one pre-aggregated pass finds them.  If they coincide and there are others, the
    second worst counts: the worst of those that are not the best, as a maximum of the two largest structs.
    """
    c = F.col
    score = c("overall_pedagogical_score").cast("double")
    carried = F.struct("candidate_id", "correct", "silent", "pred_parse_success", "overall_pedagogical_score", "reasoning_soundness", "structure", "clarity", "terminology", "final_answer", "raw_response")
    best = F.struct(c("pred_parse_success").cast("int"), c("correct").cast("int"), (~c("silent")).cast("int"), F.coalesce(score, F.lit(-1.0)), F.coalesce(c("reasoning_soundness").cast("double"), F.lit(-1.0)), F.coalesce(c("structure").cast("double"), F.lit(-1.0)), -c("candidate_id"))
    worst = F.struct(c("silent").cast("int"), (~c("correct")).cast("int"), (~c("pred_parse_success")).cast("int"), -F.coalesce(score, F.lit(99.0)), -F.coalesce(c("reasoning_soundness").cast("double"), F.lit(99.0)), -F.coalesce(c("structure").cast("double"), F.lit(99.0)), c("candidate_id"))
    rows = candidates.withColumn("_best", best).withColumn("_worst", worst).withColumn("_row", carried)
    place = Window.partitionBy(*keys)
    rows = rows.withColumn("_bad", F.row_number().over(place.orderBy(F.col("_worst").desc())))
    out = rows.groupBy(*keys).agg(
        F.max_by("_row", "_best").alias("best"),
        F.max(F.when(c("_bad") == 1, c("_row"))).alias("worst1"), F.max(F.when(c("_bad") == 2, c("_row"))).alias("worst2"),
    )
    same = c("best.candidate_id") == c("worst1.candidate_id")
    out = out.withColumn("worst", F.when(same, F.coalesce("worst2", "worst1")).otherwise(c("worst1")))
    b, w = (lambda n: c(f"best.{n}")), (lambda n: c(f"worst.{n}"))
    out = out.withColumn("best_score", F.coalesce(b("overall_pedagogical_score").cast("double"), F.lit(-1.0))).withColumn("worst_score", F.coalesce(w("overall_pedagogical_score").cast("double"), F.lit(-1.0)))
    out = out.withColumn("quality_gap", c("best_score") - c("worst_score"))
    contrast = b("correct") & ~b("silent") & (~w("correct") | w("silent") | ~w("pred_parse_success"))
    reason = (
        F.when(b("candidate_id") == w("candidate_id"), "best_equals_worst").when(F.lit(best_correct) & ~b("correct"), "best_not_correct")
        .when(F.lit(best_not_silent) & b("silent"), "best_silent_error").when((c("quality_gap") < gap) & ~contrast, "quality_gap_below_threshold")
        .when(F.lit(not worst_incorrect) & ~w("correct"), "worst_incorrect_not_allowed").when(F.lit(not worst_silent) & w("silent"), "worst_silent_not_allowed")
        .when(F.coalesce(F.trim(b("final_answer")), F.lit("")) == "", "best_final_answer_missing")
    )
    tags = [
        (~w("correct"), "incorrect_answer"), (~w("pred_parse_success"), "parse_failure"), (w("silent"), "silent_error"),
        *[(F.coalesce(w(n), F.lit(-1)) <= 0, f"low_{t}") for n, t in (("clarity", "clarity"), ("structure", "structure"), ("reasoning_soundness", "reasoning"), ("terminology", "terminology"))],
    ]
    return out.withColumn("no_pair_reason", reason).select(
        *keys, b("candidate_id").alias("best_candidate_id"), w("candidate_id").alias("worst_candidate_id"), "best_score", "worst_score", "quality_gap",
        b("correct").alias("best_is_correct"), w("correct").alias("worst_is_correct"), b("silent").alias("best_is_silent_error"), w("silent").alias("worst_is_silent_error"),
        F.concat_ws("|", *[F.when(holds, F.lit(tag)) for holds, tag in tags]).alias("defect_tags"),
        F.when(c("no_pair_reason").isNull(), "paired").otherwise("no_pair").alias("pair_status"), "no_pair_reason",
        b("raw_response").alias("better_response"), w("raw_response").alias("weak_response"), b("final_answer").alias("final_answer"),
    )


def contrastive_text(question: Column, weak: Column, tags: Column, better: Column, final: Column) -> Column:
    """The training text of a pair; tags are joined by bars."""
    lines = F.when(tags == "", F.lit("- none_detected")).otherwise(F.concat(F.lit("- "), F.replace(tags, F.lit("|"), F.lit("\n- "))))
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nWeak explanation:\n"), weak, F.lit("\n\nDetected pedagogical problems:\n"), lines, F.lit("\n\nBetter explanation:\n"), better, F.lit("\n\nFinal answer:\n"), final)


def anchor_count(n: Column, ratio: float) -> Column:
    """n times ratio, halves to even."""
    return F.rint(n * F.lit(ratio)).cast("long")


def anchored(synthetic: DataFrame, pool: DataFrame, by: list[str], ratio: float, replace: bool = False, used: DataFrame | None = None, key: str = "example_id") -> DataFrame:
    """Training rows of each context with human anchors appended, or put in the place of as many synthetic rows.

    Anchors and the rows that go are the first in hash order within their context; anchors in `used` (by and key) are
    not taken again.  Columns: by, key, question, answer_for_training, source.
    """
    columns = [*by, key, "question", "answer_for_training", "source"]
    sizes = synthetic.groupBy(*by).agg(anchor_count(F.count("*"), ratio).alias("_k"))
    free = pool if used is None else pool.join(used.select(*by, key).distinct(), [*by, key], "left_anti")
    parts = [F.col(c) for c in (*by, key)]
    chosen = _placed(free, by, hash_order("anchor", *parts), key).join(sizes, by).filter("_n <= _k")
    chosen = chosen.withColumn("source", F.lit("human_anchor")).withColumn("answer_for_training", F.col("answer_gold")).select(*columns)
    kept = synthetic
    if replace:
        kept = _placed(synthetic, by, hash_order("replace", *parts), key).join(sizes, by).filter("_n > _k")
    return kept.select(*columns).unionByName(chosen)


def _placed(rows: DataFrame, by: list[str], order: Column, key: str) -> DataFrame:
    """rows with their place _n, from 1, in the order of a hexadecimal hash and the key, within `by`.

    Places are counted within parts of the hash, of which each context has 4,096, and on from the counts of the parts before: no task sorts a context.
    """
    rows = rows.withColumn("_hash", order).withColumn("_part", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("long"))
    before = running(rows.groupBy(*by, "_part").agg(F.count("*").alias("_rows")), by, "_part", "_rows").select(*by, "_part", "before")
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_hash", key))
    return null_safe_join(rows.withColumn("_n", inside), before, [*by, "_part"]).withColumn("_n", F.col("_n") + F.col("before"))
