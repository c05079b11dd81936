"""Row-level judgements that the policies share: defects, severity, length bins, weights.

Missing judgements count differently by use; `missing_is_low` and the like say which rule holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gyre.functions.answers import strip
from gyre.functions.hashing import unit_score

DEFECTS = ("parse_failure", "silent_error", "incorrect_answer", "low_reasoning", "low_structure")
SEVERITY = {"parse_failure": 4, "silent_error": 4, "incorrect_answer": 2, "low_reasoning": 2, "low_structure": 1}


def effectively_correct(is_correct: Column, label: Column) -> Column:
    return F.coalesce(is_correct, F.lit(False)) | F.coalesce(F.lower(F.trim(label)) == "correct", F.lit(False))


def defects(parse_ok: Column, silent: Column, correct: Column, reasoning: Column, structure: Column, missing_is_low: bool = True) -> dict[str, Column]:
    """Five flags; a missing parse result or silent flag is a defect, a missing sub-score one if missing_is_low."""
    low = F.lit(missing_is_low)
    return {
        "parse_failure": ~F.coalesce(parse_ok, F.lit(False)),
        "silent_error": F.coalesce(silent, F.lit(True)),
        "incorrect_answer": ~F.coalesce(correct, F.lit(False)),
        "low_reasoning": F.coalesce(reasoning <= 0, low),
        "low_structure": F.coalesce(structure <= 0, low),
    }


def severity(flags: dict[str, Column]) -> Column:
    parts = [flags[name].cast("int") * SEVERITY[name] for name in DEFECTS]
    return sum(parts[1:], parts[0])


def length_bin(question: Column, seed: Column, branch: Column, generation: Column, example: Column, short: int = 80, medium: int = 180, tag: str = "dbr") -> Column:
    """short, medium or long by the stripped question's characters; a blank one falls in a third by its hash."""
    text = F.coalesce(strip(question), F.lit(""))
    score = unit_score(seed, branch, generation, example, tag)
    by_hash = F.when(score < 1.0 / 3.0, "short").when(score < 2.0 / 3.0, "medium").otherwise("long")
    return F.when(text == "", by_hash).when(F.length(text) <= short, "short").when(F.length(text) <= medium, "medium").otherwise("long")


def score_bucket(silent: Column, score: Column) -> Column:
    return F.when(F.coalesce(silent, F.lit(False)), "silent").when(score <= 3, "low").when(score >= 6, "high").otherwise("ordinary")


# Fixed values: (least score if correct, weight, reason), then those for incorrect rows, by policy.
SOFT_POLICIES = {
    "soft_pvf_medium": ([(6, 1.0, "high_quality"), (4, 0.5, "medium_quality"), (None, 0.25, "low_pedagogy_correct")], [(None, 0.1, "incorrect_low_weight")]),
    "soft_pvf_lenient": ([(6, 1.0, "high_quality"), (4, 0.75, "medium_high_quality"), (2, 0.5, "medium_low_quality"), (None, 0.25, "low_pedagogy_correct")], [(5, 0.25, "pedagogical_but_incorrect"), (None, 0.1, "incorrect_low_weight")]),
    "soft_pvf_noisy_keep": ([(5, 1.0, "correct_high_pedagogy"), (3, 0.75, "correct_medium_pedagogy"), (None, 0.5, "correct_low_pedagogy")], [(5, 0.25, "incorrect_but_high_pedagogy"), (None, 0.1, "incorrect_low_weight")]),
    "soft_pvf_silent_only": ([(None, 1.0, "non_silent_parsed_keep")], [(None, 1.0, "non_silent_parsed_keep")]),
}


def soft_weight(policy: str, has_accuracy: Column, has_judge: Column, parse_ok: Column, silent: Column, correct: Column, score: Column) -> Column:
    """(weight, reason): four reasons to reject outright, then the policy's table."""

    def said(weight: float, reason: str) -> Column:
        return F.struct(F.lit(weight).alias("weight"), F.lit(reason).alias("reason"))

    good, bad = SOFT_POLICIES[policy]
    out = F.when(~has_accuracy, said(0.0, "missing_accuracy_row")).when(~has_judge, said(0.0, "missing_judge_row")).when(~parse_ok, said(0.0, "pred_parse_failure")).when(silent, said(0.0, "silent_error_true"))
    for steps, holds in ((good, correct), (bad, ~correct)):
        for least, weight, reason in steps:
            out = out.when(holds if least is None else holds & F.coalesce(score >= least, F.lit(False)), said(weight, reason))
    return out


def weighted_keep(weight: Column, score: Column) -> Column:
    return F.when(weight <= 0, False).when(weight >= 1, True).otherwise(score < weight)
