"""Two judges of the same rows or pairs: comparison, and whether they come to the same conclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.operators import metrics


def compared_scores(first: DataFrame, second: DataFrame, keys: list[str], score: str, silent: str) -> DataFrame:
    """Rows that both judges scored, by an inner join on keys: old_ and new_ score and flag, their difference and agreement."""
    both = first.join(second.select(*keys, F.col(score).alias("new_score"), F.col(silent).alias("new_silent")), keys)
    both = both.withColumnsRenamed({score: "old_score", silent: "old_silent"})
    delta = F.col("new_score") - F.col("old_score")
    return both.withColumns({"score_delta": delta, "abs_score_delta": F.abs(delta), "silent_agreement": F.col("old_silent") == F.col("new_silent")})


def _rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def _flipped(old: Column, new: Column) -> Column:
    """Whether one difference is 0 or more and the other is not; null if one of them is."""
    return ((old >= 0) & (new < 0)) | ((old < 0) & (new >= 0))


def _sides(control: str, other: str, when: Column | None = None) -> list[Column]:
    """Means of both judges' scores for two branches, over rows where `when` holds."""
    out = []
    for name, branch in (("control", control), ("other", other)):
        side = F.col("branch") == branch if when is None else (F.col("branch") == branch) & when
        out += [F.avg(F.when(side, F.col(f"{judge}_score"))).alias(f"{judge}_{name}_mean") for judge in ("old", "new")]
        out += [F.avg(F.when(side, F.col(f"{judge}_silent").cast("int"))).alias(f"{judge}_{name}_silent_rate") for judge in ("old", "new")]
        out.append(F.count(F.when(side, 1)).alias(f"n_{name}"))
    return out


def _with_deltas(df: DataFrame) -> DataFrame:
    df = df.withColumns({f"{judge}_delta": F.col(f"{judge}_other_mean") - F.col(f"{judge}_control_mean") for judge in ("old", "new")})
    return df.withColumn("conclusion_changed", _flipped(F.col("old_delta"), F.col("new_delta")))


def sensitivity_summary(compared: DataFrame, control: str, other: str, generation: int = 1) -> DataFrame:
    """One row over all compared rows, with both judges' difference of two branches in one generation and whether its sign flips."""
    every = [
        F.count("*").alias("n_examples"), F.avg("old_score").alias("mean_old_score"), F.avg("new_score").alias("mean_new_score"),
        F.avg("abs_score_delta").alias("mean_abs_delta"), metrics.correlation(F.col("old_score"), F.col("new_score")).alias("correlation"),
        _rate(F.col("silent_agreement")).alias("silent_agreement_rate"),
    ]
    out = _with_deltas(compared.agg(*every, *_sides(control, other, F.col("generation") == generation)))
    return out.select("n_examples", "mean_old_score", "mean_new_score", "mean_abs_delta", "correlation", "silent_agreement_rate", "old_delta", "new_delta", "conclusion_changed")


def branch_summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("branch", "generation").agg(
        F.count("*").alias("n"), F.avg("old_score").alias("old_mean"), F.avg("new_score").alias("new_mean"),
        _rate(F.col("old_silent")).alias("old_silent_rate"), _rate(F.col("new_silent")).alias("new_silent_rate"),
        F.avg("score_delta").alias("mean_delta"), _rate(F.col("silent_agreement")).alias("silent_agreement_rate"),
    )


def seed_summary(compared: DataFrame, control: str, other: str, generation: int = 1) -> DataFrame:
    """Each seed's difference of two branches under both judges; seeds that lack a branch are left out."""
    rows = compared.filter(F.col("generation") == generation).groupBy("seed").agg(F.count("*").alias("n"), _rate(F.col("silent_agreement")).alias("silent_agreement_rate"), F.avg("score_delta").alias("mean_delta"), *_sides(control, other))
    return _with_deltas(rows.filter("n_control > 0 AND n_other > 0"))


def compared_pairs(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Decoded pairs (winner, winner_branch, flags) of two judges side by side, with their agreement."""
    flags = [c for c in first.columns if c.startswith("winner") or c.endswith("_win")]
    left = first.select(*keys, *[F.col(c).alias(f"old_{c}") for c in flags])
    both = left.join(second.select(*keys, *[F.col(c).alias(f"new_{c}") for c in flags]), keys)
    return both.withColumn("agree_branch", F.col("old_winner_branch") == F.col("new_winner_branch")).withColumn("agree_raw", F.col("old_winner") == F.col("new_winner"))


def pair_summary(compared: DataFrame, control: str, other: str, by: list[str]) -> DataFrame:
    """Win rates of two branches under both judges, their agreement, and whether the sign of the margin flips."""
    rates = [_rate(F.col(f"{judge}_{branch}_win")).alias(f"{judge}_{name}_rate") for judge in ("old", "new") for name, branch in (("control", control), ("other", other))]
    ties = [_rate(F.col(f"{judge}_winner_branch") == "Tie").alias(f"{judge}_tie_rate") for judge in ("old", "new")]
    out = compared.groupBy(*by).agg(F.count("*").alias("n_pairs"), *rates, *ties, _rate(F.col("agree_branch")).alias("agree_branch_rate"), _rate(F.col("agree_raw")).alias("agree_raw_rate"))
    out = out.withColumns({f"{judge}_delta": F.col(f"{judge}_other_rate") - F.col(f"{judge}_control_rate") for judge in ("old", "new")})
    return out.withColumn("conclusion_changed", _flipped(F.col("old_delta"), F.col("new_delta")))


def conclusion(margin: Column, control: str, other: str) -> Column:
    """Which branch a margin (other minus control) prefers; `unknown` for null."""
    return F.when(margin > 0, f"{other}_preferred").when(margin < 0, f"{control}_preferred").when(margin == 0, "mixed_tie").otherwise("unknown")


def margin_summary(decoded: DataFrame, scores: DataFrame, control: str, other: str, names: tuple[str, str], by: list[str]) -> DataFrame:
    """Win rates of decoded pairs and the conclusion from their margin, beside that from another judge's mean scores.

    scores: (by, delta): the other judge's mean difference; a missing or null one is `unknown` and says nothing of a change.
    """
    rates = [_rate(F.col(f"{branch}_win")).alias(f"{name}_rate") for name, branch in zip(names, (control, other))]
    out = decoded.groupBy(*by).agg(F.count("*").alias("n_pairs"), *rates, _rate(F.col("winner_branch") == "Tie").alias("tie_rate"))
    out = out.withColumn("margin", F.col(f"{names[1]}_rate") - F.col(f"{names[0]}_rate")).withColumn("conclusion", conclusion(F.col("margin"), *names))
    out = out.join(scores, by, "left") if by else out.join(F.broadcast(scores))  # one row a seed, or one row
    out = out.withColumn("score_conclusion", conclusion(F.col("delta"), *names))
    return out.withColumn("changed", F.when(F.col("delta").isNotNull(), F.col("conclusion") != F.col("score_conclusion")))
