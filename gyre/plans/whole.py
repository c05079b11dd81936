"""Whole reports: every table of each, from inputs that are derived once, written, and read by all of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.plans import exports, judging, oracles, reports, studies
from gyre.plans import queries as q
from gyre.plans.queries import inputs
from gyre.sources import bindings
from gyre.sources.shared import written

CTX = bindings.CONTEXT
VALUES = ("double", "bigint", "decimal")


def long(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables of a report under each other: (tbl, key, metric, value), the key being the columns that are no measures, by name."""
    out = None
    for name, df in tables.items():
        values = [c for c, kind in df.dtypes if kind.startswith(VALUES)]
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in sorted(set(df.columns) - set(values))]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), (F.round(F.col(c).cast("double"), 9) + 0.0).alias("value")) for c in values])
        part = df.select(F.lit(name).alias("tbl"), F.concat_ws("|", *keys).alias("key"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out


def i03_baseline_series(spark, sf_dir):
    return long(exports.series(inputs(spark, sf_dir)[0]))


def i04_mode_comparison(spark, sf_dir):
    """Even orders as training runs, odd ones as inference runs."""
    rows = inputs(spark, sf_dir)[0]
    return long(exports.mode_comparison(rows.filter("place % 2 = 0"), rows.filter("place % 2 = 1")))


def i05_anchoring_ablation(spark, sf_dir):
    ratios = spark.sql("SELECT * FROM VALUES ('dbr_medium', 10, 'append'), ('anchor_20_append', 20, 'append') AS t(branch, anchor_ratio, mixing_mode)")
    return long(exports.anchoring_ablation(inputs(spark, sf_dir)[0], ratios))


def i07_pvf_confirmatory(spark, sf_dir):
    return long(exports.pvf_report(*inputs(spark, sf_dir)))


def i09_soft_confirmatory(spark, sf_dir):
    return long(exports.soft_report(*inputs(spark, sf_dir)))


def i11_dbr_confirmatory(spark, sf_dir):
    """The reasons of selected rows are taken together, as which relaxation let a row in is not for SQL."""
    tables = exports.dbr_report(*inputs(spark, sf_dir))
    reason = F.when(F.col("decision_reason").startswith("selected"), "selected").otherwise(F.col("decision_reason"))
    tables["decision_reasons"] = tables["decision_reasons"].groupBy(*CTX, reason.alias("decision_reason")).agg(F.sum("n").alias("n"))
    return long(tables)


def i12_pvr_report(spark, sf_dir):
    return long(exports.repair_report(*inputs(spark, sf_dir)))


def i13_pair_lite_report(spark, sf_dir):
    return long(exports.repair_report(*inputs(spark, sf_dir), max_chars=40))


def i14_csr_report(spark, sf_dir):
    evaluated = inputs(spark, sf_dir, "customer")[0]
    pairs = q.csr_of(evaluated.withColumn("raw_response", F.col("answer_for_training")))
    pairs = pairs.select("branch", "generation", "pair_status", "no_pair_reason", "best_score", "worst_score", "quality_gap")
    return long(exports.csr_report(evaluated, written(pairs, "pairs"), ["branch", "generation"]))


def i21_bundle(spark, sf_dir):
    """What a bundle of all reports holds: the cells of every table, all from one derivation of the inputs."""
    evaluated, rows = inputs(spark, sf_dir)
    series = exports.series(evaluated)
    parts = {
        "baseline": series, "pvf": exports.pvf_report(evaluated, rows, tables=series), "soft_pvf": exports.soft_report(evaluated, rows, tables=series),
        "pvr": exports.repair_report(evaluated, rows, tables=series), "pair_lite": exports.repair_report(evaluated, rows, max_chars=40, tables=series),
    }
    out = None
    for report, tables in parts.items():
        part = long(tables).groupBy(F.lit(report).alias("report"), "tbl").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_values"), F.count_distinct("key").alias("n_keys"))
        out = part if out is None else out.unionByName(part)
    return out


#: Tables of the article's evidence: the query of each, its keys, and its measures.
EVIDENCE = {
    "severity": ("e17_severity_p90", ["branch", "generation"], ["n", "mean_severity", "p90_severity"]),
    "collapse_summary": ("e18_collapse_summary", ["branch", "generation", "metric"], ["n_seeds", "mean", "std", "ci_low", "ci_high"]),
    "defect_rates": ("e20_defect_rates", ["branch", "generation", "defect"], ["rate_before", "rate_after", "delta"]),
    "bucket_coverage": ("e20_bucket_coverage", ["branch", "generation", "length_bin"], ["n_before", "n_after", "share_after"]),
    "collapse_flags": ("e32_collapse_flags", ["branch", "metric", "step", "flag"], ["n_values", "mean", "ci_low", "ci_high"]),
    "gen2_summary": ("e33_gen2_summary", ["branch", "metric"], ["n_positive", "n_negative", "mean", "ci_low", "ci_high"]),
    "mechanism": ("e34_mechanism_summary", ["model_name"], ["parse_failure_delta_mean", "silent_error_delta_mean", "incorrect_answer_delta_mean", "selection_rate_mean"]),
    "generation_curves": ("e16_collapse_metrics", ["branch", "generation"], ["sample_count", "accuracy_mean", "pedagogical_score_mean", "silent_error_rate", "parse_failure_pred_rate", "low_reasoning_rate", "low_structure_rate", "defect_severity_mean", "missing_judge_rows"]),
    "matched_gen2": ("d12_matched_gen2", ["seed"], ["n_matched", "delta_is_correct", "delta_overall_pedagogical_score", "delta_is_silent_error"]),
    "gen2_deltas": ("f11_gen2_deltas", ["row"], ["delta_accuracy_mean", "delta_pedagogical_score_mean", "delta_silent_error_rate"]),
}


def i19_article_evidence(spark, sf_dir):
    """Every table of the evidence that an article rests on, all from one derivation of the inputs: each is written, and read from there."""
    evaluated, rows = inputs(spark, sf_dir, "customer")
    shared = bindings.first_of_customer(rows.withColumn("example_id", F.col("customer"))).filter("has_judge")
    tables = {
        "severity": q.severity_p90(rows), "collapse_summary": reports.collapse_summary(rows), "defect_rates": q.defect_rates(rows), "bucket_coverage": q.bucket_coverage(rows),
        "collapse_flags": q.collapse_flags(evaluated), "gen2_summary": q.gen2_summary(evaluated), "mechanism": studies.mechanism_summary(rows),
        "generation_curves": studies.collapse_metrics(rows), "matched_gen2": q.matched_gen2(shared), "gen2_deltas": judging.gen2_deltas(evaluated),
    }
    return long({name: written(tables[name], name) for name in EVIDENCE})


def queries():
    return {name: f for name, f in globals().items() if re.match(r"[a-m]\d\d_", name)}


_C = "model_name, branch, generation, seed"
_K = _C.split(", ")
_M = ["accuracy_mean", "pedagogical_score_mean", "silent_error_rate"]
_LEVEL = ["sample_count", *_M, "parse_failure_pred_count", "parse_failure_pred_rate"]
_DELTAS = [f"delta_{m}" for m in _M]


def _sql(name: str, keys: list[str], values: list[str], source: str) -> str:
    key = ", ".join(f"coalesce(\"{k}\"::VARCHAR, 'null')" for k in sorted(keys))
    cells = ", ".join(f"round({v}::DOUBLE, 9) + 0.0" for v in values)
    return f"SELECT '{name}' AS tbl, concat_ws('|', {key}) AS key, unnest([{', '.join(repr(v) for v in values)}]) AS metric, unnest([{cells}]) AS value FROM ({source})"


def _delta(by: str, on: str, extra: str, m: str = "lvl", n: str = "lvl") -> str:
    deltas = ", ".join(f"r.{x} - l.{x} AS delta_{x}" for x in _M)
    return f"SELECT {by}, {extra}, {deltas} FROM {m} AS l JOIN {n} AS r ON {on}"


_NAMED = "SELECT *, 'run_seed' || seed AS run_id FROM lvl"
_BRANCHES = _sql("branch_deltas", _K, _DELTAS, oracles.SQL["f08_branch_deltas"])
_SERIES = [
    _sql("run_level", [*_K, "run_id"], _LEVEL, _NAMED),
    _sql("seed_stats", ["model_name", "branch", "generation", "metric"], ["mean", "std", "n_seeds", "n_values", "ci_low", "ci_high"], oracles.SQL["e05_seed_stats"]),
    _sql("generation_deltas", ["model_name", "branch", "seed", "from_generation", "to_generation"], _DELTAS, oracles.SQL["f07_generation_deltas"]),
    _BRANCHES,
]
_QUALITY = ["n", "mean_overall_pedagogical_score", "mean_correct", "mean_silent"]


def _quality(state: str, source: str) -> str:
    return f"SELECT {_C}, {state}, count(*) AS n, avg(overall_pedagogical_score) AS mean_overall_pedagogical_score, avg(correct::INT) AS mean_correct, avg(silent::INT) AS mean_silent FROM {source} GROUP BY ALL"


def _stress(values: list[str], report: str) -> str:
    return _sql("stress_summary", [*_K, "run_id"], [*_LEVEL, *values], f"SELECT * FROM ({_NAMED}) LEFT JOIN ({report}) USING ({_C})")


_MEDIUM = f"SELECT {', '.join('r.' + c for c in _K)}, s.assigned_weight, s.decision_reason, s.kept, s.correct, s.silent, s.overall_pedagogical_score FROM soft AS s JOIN resp AS r USING (order_id) WHERE policy_name = 'soft_pvf_medium'"
_SOFT = f"SELECT {_C}, avg(kept::INT) AS keep_rate, avg(assigned_weight) AS mean_weight FROM med GROUP BY ALL"
_PVF = f"SELECT {_C}, count(*) AS n_rows, count(*) FILTER (kept) AS n_kept, avg(kept::INT) AS keep_rate, avg(overall_pedagogical_score) FILTER (kept) AS kept_score, avg(overall_pedagogical_score) FILTER (NOT kept) AS rejected_score, avg(is_correct::INT) FILTER (kept) AS kept_accuracy, avg(is_correct::INT) FILTER (NOT kept) AS rejected_accuracy FROM pvf GROUP BY ALL"
_CHOSEN = f"SELECT {_C}, count(*) AS n_rows, count(*) FILTER (NOT defect_parse_failure) AS n_selected, avg((NOT defect_parse_failure)::INT) AS selection_rate FROM sev GROUP BY ALL"
_RATES = " UNION ALL ".join(f"SELECT {_C}, '{n}' AS defect, avg(defect_{n}::INT) AS rate_before, coalesce(avg(defect_{n}::INT) FILTER (NOT defect_parse_failure), 0) AS rate_after, coalesce(avg(defect_{n}::INT) FILTER (NOT defect_parse_failure), 0) - avg(defect_{n}::INT) AS delta FROM sev GROUP BY {_C}" for n in ("parse_failure", "silent_error", "incorrect_answer", "low_reasoning", "low_structure"))
_REASONS = f"SELECT {_C}, CASE WHEN NOT defect_parse_failure THEN 'selected' WHEN met THEN 'rejected_target_reached' ELSE 'rejected_parse_forbidden' END AS decision_reason, count(*) AS n FROM (SELECT *, NOT bool_or(defect_parse_failure) OVER (PARTITION BY {_C}) AS met FROM sev) GROUP BY ALL"


def _repairs(limit: str) -> list[str]:
    ok = f"state = 'weak' AND {limit}"
    action = f"CASE WHEN state = 'high_quality' THEN 'keep_original' WHEN {ok} THEN 'repair' ELSE 'reject' END AS action"
    reason = f"CASE WHEN state <> 'weak' THEN state WHEN {limit} THEN 'pedagogical_repair_needed' ELSE 'repair_failed' END AS decision_reason"
    success = f"SELECT {_C}, count(*) FILTER (state = 'weak') AS n_attempted, count(*) FILTER ({ok}) AS n_success, coalesce(count(*) FILTER ({ok}) / nullif(count(*) FILTER (state = 'weak'), 0), 0) AS success_rate FROM rep GROUP BY ALL"
    values = ["n_attempted", "n_success", "success_rate"]
    return [
        _sql("decision_reasons", [*_K, "decision_reason"], ["n"], f"SELECT {_C}, {reason}, count(*) AS n FROM rep GROUP BY ALL"),
        _sql("repair_success_summary", _K, values, success),
        _sql("keep_repair_reject_quality", [*_K, "action"], _QUALITY, _quality(action, "rep")),
        _stress(values, success),
    ]


def _level(where: str) -> str:
    rates = "avg(is_correct::INT) AS accuracy_mean, avg(overall_pedagogical_score) AS pedagogical_score_mean, avg(is_silent_error::INT) AS silent_error_rate"
    return f"SELECT {_C}, count(*) AS sample_count, {rates}, count(*) FILTER (NOT pred_parse_success) AS parse_failure_pred_count, avg((NOT pred_parse_success)::INT) AS parse_failure_pred_rate FROM ev WHERE {where} GROUP BY ALL"


_BY_MODE = ", ".join(f"avg({m}) AS {m}" for m in _M)
_RATIOS = "SELECT lvl.*, 'run_seed' || seed AS run_id, CASE branch WHEN 'dbr_medium' THEN 10 WHEN 'anchor_20_append' THEN 20 END AS anchor_ratio, CASE branch WHEN 'pure_recycling' THEN 'none' ELSE 'append' END AS mixing_mode FROM lvl"


def _all(*parts: str) -> str:
    return " UNION ALL ".join(parts)


SQL = {
    "i03_baseline_series": _all(*_SERIES),
    "i04_mode_comparison": f", mo AS (SELECT *, 'training' AS mode, 'run_seed' || seed AS run_id FROM ({_level('order_id % 2 = 0')}) UNION ALL SELECT *, 'inference', 'run_seed' || seed FROM ({_level('order_id % 2 = 1')})), ms AS (SELECT seed, branch, generation, mode, {_BY_MODE} FROM mo GROUP BY 1, 2, 3, 4) "
    + _all(_sql("run_level", [*_K, "mode", "run_id"], _LEVEL, "SELECT * FROM mo"), _sql("mode_deltas", ["seed", "branch", "generation", "mode"], _DELTAS, _delta("l.seed, l.branch, l.generation", "(l.seed, l.branch, l.generation) = (r.seed, r.branch, r.generation) AND l.mode = 'inference' AND r.mode = 'training'", "r.mode", "ms", "ms"))),
    "i05_anchoring_ablation": f", ra AS ({_RATIOS}) " + _all(
        _sql("run_level", [*_K, "run_id", "anchor_ratio", "mixing_mode"], _LEVEL, "SELECT * FROM ra"), _BRANCHES,
        _sql("ratio_deltas", ["model_name", "generation", "seed", "mixing_mode", "low_anchor_ratio", "high_anchor_ratio"], _DELTAS, _delta("l.model_name, l.generation, l.seed, l.mixing_mode", "(l.model_name, l.generation, l.seed, l.mixing_mode) = (r.model_name, r.generation, r.seed, r.mixing_mode) AND l.anchor_ratio < r.anchor_ratio", "l.anchor_ratio AS low_anchor_ratio, r.anchor_ratio AS high_anchor_ratio", "ra", "ra")),
    ),
    "i07_pvf_confirmatory": _all(
        *_SERIES,
        _sql("reject_reasons", [*_K, "reason"], ["n"], f"SELECT {_C}, reason, count(*) AS n FROM (SELECT {_C}, unnest(string_split(reject_reasons, '|')) AS reason FROM pvf WHERE NOT kept) GROUP BY ALL"),
        _sql("keep_reject_quality", [*_K, "kept"], _QUALITY, _quality("kept", "pvf")),
        _stress(["n_rows", "n_kept", "keep_rate", "kept_score", "rejected_score", "kept_accuracy", "rejected_accuracy"], _PVF),
    ),
    "i09_soft_confirmatory": f", med AS ({_MEDIUM}), sr AS ({_SOFT}) " + _all(
        *_SERIES,
        _sql("decision_reasons", [*_K, "decision_reason"], ["n"], f"SELECT {_C}, decision_reason, count(*) AS n FROM med GROUP BY ALL"),
        _sql("keep_rejected_quality", [*_K, "kept"], _QUALITY, _quality("kept", "med")),
        _sql("weight_distribution", _K, ["assigned_weight", "n"], f"SELECT {_C}, assigned_weight, count(*) AS n FROM med GROUP BY ALL"),
        _sql("policy_summary", [*_K, "rank_keep_rate", "rank_mean_weight"], ["keep_rate", "mean_weight"], "SELECT *, rank() OVER (PARTITION BY seed ORDER BY keep_rate DESC) AS rank_keep_rate, rank() OVER (PARTITION BY seed ORDER BY mean_weight DESC) AS rank_mean_weight FROM sr WHERE generation = (SELECT max(generation) FROM sr)"),
        _stress(["keep_rate", "mean_weight"], "SELECT * FROM sr"),
    ),
    "i11_dbr_confirmatory": _all(
        *_SERIES,
        _sql("budget_summary", _K, ["n_rows", "n_selected", "selection_rate"], _CHOSEN),
        _sql("defect_rates_before_after", [*_K, "defect"], ["rate_before", "rate_after", "delta"], _RATES),
        _sql("bucket_coverage", [*_K, "length_bin"], ["n_before", "n_after"], f"SELECT {_C}, length_bin, count(*) AS n_before, count(*) FILTER (NOT defect_parse_failure) AS n_after FROM sev GROUP BY ALL"),
        _sql("decision_reasons", [*_K, "decision_reason"], ["n"], _REASONS),
        _stress(["n_rows", "n_selected", "selection_rate"], _CHOSEN),
    ),
    "i12_pvr_report": _all(*_SERIES, *_repairs("TRUE")),
    "i13_pair_lite_report": _all(*_SERIES, *_repairs("length(rewritten) <= 40")),
    "i14_csr_report": _all(
        *_SERIES,
        _sql("pair_summary", ["branch", "generation"], ["n_examples", "pair_rate"], "SELECT branch, generation, count(*) AS n_examples, avg((pair_status = 'paired')::INT) AS pair_rate FROM csr GROUP BY ALL"),
        _sql("no_pair_reasons", ["branch", "generation", "no_pair_reason"], ["n"], "SELECT branch, generation, no_pair_reason, count(*) AS n FROM csr WHERE no_pair_reason IS NOT NULL GROUP BY ALL"),
        _sql("best_vs_worst_quality", ["branch", "generation"], ["n", "best_mean", "worst_mean", "gap_mean"], "SELECT branch, generation, count(*) AS n, avg(best_score) AS best_mean, avg(worst_score) AS worst_mean, avg(quality_gap) AS gap_mean FROM csr WHERE pair_status = 'paired' GROUP BY ALL"),
    ),
}


_BUNDLE = {"baseline": "i03_baseline_series", "pvf": "i07_pvf_confirmatory", "soft_pvf": "i09_soft_confirmatory", "pvr": "i12_pvr_report", "pair_lite": "i13_pair_lite_report"}
_MORE = f", med AS ({_MEDIUM}), sr AS ({_SOFT}) "
SQL["i21_bundle"] = _MORE + _all(*[f"SELECT '{report}' AS report, tbl, count(*) AS n_cells, count(value) AS n_values, count(DISTINCT key) AS n_keys FROM ({SQL[name].removeprefix(_MORE)}) GROUP BY tbl" for report, name in _BUNDLE.items()])


def _evidence() -> str:
    """The SQL of each table, its own steps within it."""
    every = oracles.oracle_sql() | reports.oracle_sql() | judging.oracle_sql() | studies.oracle_sql()
    parts = []
    for name, (query, keys, values) in EVIDENCE.items():
        own = every[query].removeprefix(oracles.BASE).strip()
        parts.append(_sql(name, keys, values, "WITH " + own[1:] if own.startswith(",") else own))
    return _all(*parts)


def oracle_sql():
    return {name: oracles.BASE + sql for name, sql in (SQL | {"i19_article_evidence": _evidence()}).items()}
