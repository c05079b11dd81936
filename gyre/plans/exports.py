"""Whole reports: each is a fixed set of tables over evaluated rows and decisions, as DataFrames that share their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.operators import dbr, metrics, policies
from gyre.sources import sinks
from gyre.sources.bindings import CONTEXT
from gyre.sources.shared import written

GROUP = ["model_name", "branch", "generation"]


def run_level(evaluated: DataFrame) -> DataFrame:
    """The metrics of each context, with its run's name."""
    return metrics.metrics(evaluated, CONTEXT).withColumn("run_id", F.concat(F.lit("run_seed"), F.col("seed")))


def series(evaluated: DataFrame, control: str = "pure_recycling") -> dict[str, DataFrame]:
    """Tables that every report over several seeds has: levels, spread, and differences by generation and branch."""
    level = written(run_level(evaluated), "level")
    long = metrics.long_form(level, CONTEXT, metrics.METRICS)
    return {
        "run_level": level,
        "seed_stats": metrics.spread(long, [*GROUP, "metric"]),
        "generation_deltas": metrics.generation_deltas(level, ["model_name", "branch", "seed"], metrics.METRICS),
        "branch_deltas": metrics.control_deltas(level, ["model_name", "generation", "seed"], "branch", control, metrics.METRICS),
    }


def stress(level: DataFrame, report: DataFrame) -> DataFrame:
    """Levels with the report of their context; null where a context has none.  The model is part of the key."""
    return level.join(report, CONTEXT, "left")


def mode_comparison(training: DataFrame, inference: DataFrame) -> dict[str, DataFrame]:
    """Both modes' series, and training minus inference for each seed, branch and generation that both have."""
    both = written(run_level(training).withColumn("mode", F.lit("training")).unionByName(run_level(inference).withColumn("mode", F.lit("inference"))), "level")
    by = ["seed", "branch", "generation"]
    deltas = metrics.control_deltas(both.groupBy(*by, "mode").agg(*[F.avg(m).alias(m) for m in metrics.METRICS]), by, "mode", "inference", metrics.METRICS)
    return {"run_level": both, "mode_deltas": deltas}


def anchoring_ablation(evaluated: DataFrame, ratios: DataFrame, control: str = "pure_recycling") -> dict[str, DataFrame]:
    """Series by anchor ratio and mixing mode.  ratios: (branch, anchor_ratio decimal, mixing_mode)."""
    level = written(run_level(evaluated), "level").join(ratios, "branch", "left").withColumn("mixing_mode", F.coalesce("mixing_mode", F.lit("none")))
    anchored = level.filter(F.col("branch") != control)
    return {
        "run_level": level,
        "branch_deltas": metrics.control_deltas(level, ["model_name", "generation", "seed"], "branch", control, metrics.METRICS),
        "mode_deltas": metrics.control_deltas(anchored, ["model_name", "generation", "seed", "anchor_ratio"], "mixing_mode", "replace", metrics.METRICS),
        "ratio_deltas": metrics.ordered_pairs(anchored, ["model_name", "generation", "seed", "mixing_mode"], ["anchor_ratio", "branch"], "anchor_ratio", metrics.METRICS),
    }


def pvf_report(evaluated: DataFrame, rows: DataFrame, threshold: int = 5, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """tables: the series of the evaluated rows, if it is there already."""
    decided = policies.pvf(rows, threshold)
    tables = tables or series(evaluated)
    return tables | {
        "reject_reasons": policies.pvf_reason_counts(rows, CONTEXT, threshold),
        "keep_reject_quality": metrics.kept_and_rest(decided, CONTEXT, "kept", ["overall_pedagogical_score", "correct", "silent"]),
        "stress_summary": stress(tables["run_level"], policies.pvf_report(decided, CONTEXT)),
    }


def soft_report(evaluated: DataFrame, rows: DataFrame, policy: str = "soft_pvf_medium", tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    decided = policies.soft_pvf(rows, policy)
    report = decided.groupBy(*CONTEXT).agg(F.avg(F.col("kept").cast("int")).alias("keep_rate"), F.avg("assigned_weight").alias("mean_weight"))
    tables = tables or series(evaluated)
    last = report.withColumn("latest", F.max("generation").over(metrics.Window.partitionBy())).filter("generation = latest").drop("latest")
    return tables | {
        "decision_reasons": metrics.reason_counts(decided, CONTEXT, "decision_reason"),
        "keep_rejected_quality": metrics.kept_and_rest(decided, CONTEXT, "kept", ["overall_pedagogical_score", "correct", "silent"]),
        "weight_distribution": decided.groupBy(*CONTEXT, "assigned_weight").agg(F.count("*").alias("n")),
        "policy_summary": metrics.ranked(last, {"keep_rate": True, "mean_weight": True}, ["seed"]),
        "stress_summary": stress(tables["run_level"], report),
    }


def dbr_report(evaluated: DataFrame, rows: DataFrame, budgets: dbr.Budgets = dbr.Budgets()) -> dict[str, DataFrame]:
    decided = written(dbr.decided(dbr.flagged(rows), CONTEXT, budgets).drop("example_id", "selection_rank"), "decided")
    report = decided.groupBy(*CONTEXT).agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("selected"), 1)).alias("n_selected"), F.avg(F.col("selected").cast("int")).alias("selection_rate"))
    tables = series(evaluated)
    return tables | {
        "budget_summary": report,
        "defect_rates_before_after": dbr.defect_rates(decided, CONTEXT),
        "bucket_coverage": decided.groupBy(*CONTEXT, "length_bin").agg(F.count("*").alias("n_before"), F.count(F.when(F.col("selected"), 1)).alias("n_after")),
        "decision_reasons": metrics.reason_counts(decided, CONTEXT, "decision_reason"),
        "stress_summary": stress(tables["run_level"], report),
    }


def repair_report(evaluated: DataFrame, rows: DataFrame, max_chars: int | None = None, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """PVR, or PAIR-lite with a limit on the repaired text."""
    decided = policies.repair_actions(rows, max_chars=max_chars)
    tried, good = F.col("decision_reason").isin("pedagogical_repair_needed", "repair_failed").cast("int"), (F.col("action") == "repair").cast("int")
    success = decided.groupBy(*CONTEXT).agg(F.sum(tried).alias("n_attempted"), F.sum(good).alias("n_success"), F.coalesce(F.try_divide(F.sum(good), F.sum(tried)), F.lit(0.0)).alias("success_rate"))
    tables = tables or series(evaluated)
    return tables | {
        "decision_reasons": metrics.reason_counts(decided, CONTEXT, "decision_reason"),
        "repair_success_summary": success,
        "keep_repair_reject_quality": metrics.kept_and_rest(decided, CONTEXT, "action", ["overall_pedagogical_score", "correct", "silent"]),
        "stress_summary": stress(tables["run_level"], success),
    }


def csr_report(evaluated: DataFrame, pairs: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    paired = F.col("pair_status") == "paired"
    tables = series(evaluated)
    return tables | {
        "pair_summary": pairs.groupBy(*by).agg(F.count("*").alias("n_examples"), F.avg(paired.cast("int")).alias("pair_rate")),
        "no_pair_reasons": metrics.reason_counts(pairs, by, "no_pair_reason"),
        "best_vs_worst_quality": pairs.filter(paired).groupBy(*by).agg(F.count("*").alias("n"), F.avg("best_score").alias("best_mean"), F.avg("worst_score").alias("worst_mean"), F.avg("quality_gap").alias("gap_mean")),
    }


def export(tables: dict[str, DataFrame], place: str) -> None:
    """Every table of a report as CSV and Parquet under its name."""
    for name, df in tables.items():
        sinks.save_tabular(df, f"{place}/{name}")
