"""SQL for DuckDB that says what the queries should return, written from the definitions, not from the plans."""

from __future__ import annotations


def _clean(x: str) -> str:
    """Strips white space, quotes, closing marks, opening brackets and white space, in that order."""
    for marks in (r"\s", r"`''\" ", r".,;:!?)\]}>", r"(\[<{", r"\s"):
        x = f"regexp_replace({x}, '^[{marks}]+|[{marks}]+$', '', 'g')"
    return x


def _token(x: str) -> str:
    return rf"nullif(regexp_replace(regexp_extract({_clean(x)}, '[-+]?\d+(?:\.\d+)?(?:\s*/\s*[-+]?\d+)?'), '\s+', '', 'g'), '')"


def _found(strategy: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all(raw_response, '{pattern}', 1, 'i'), lambda x: {{'strategy': '{strategy}', 'raw': {_clean('x')}, 'token': {_token('x')}}})"


def _number(x: str) -> tuple[str, str]:
    num = f"CASE WHEN contains({x}, '/') THEN split_part({x}, '/', 1) ELSE replace({x}, '.', '') END::HUGEINT"
    den = f"CASE WHEN contains({x}, '/') THEN split_part({x}, '/', 2)::HUGEINT WHEN contains({x}, '.') THEN (10::HUGEINT ** length(split_part({x}, '.', 2)))::HUGEINT ELSE 1::HUGEINT END"
    return num, den


def _same(a: str, b: str) -> str:
    (n, d), (m, e) = _number(a), _number(b)
    return f"({n}) * ({e}) = ({m}) * ({d})"


def _unit(tag: str) -> str:
    return f"('0x' || substr(sha256(concat_ws('|', seed::VARCHAR, branch, generation::VARCHAR, example_id, '{tag}')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


_DIGIT = "('0x' || substr(h, i, 1))::INT"

BASE = rf"""
WITH resp AS (
  SELECT o_orderkey AS order_id, 'ord_' || o_orderkey AS example_id, 'cust_' || o_custkey AS customer, 'model_' || (o_custkey % 2) AS model_name,
    CASE o_orderstatus WHEN 'F' THEN 'pure_recycling' WHEN 'O' THEN 'dbr_medium' ELSE 'anchor_20_append' END AS branch,
    ((o_orderkey // 7) % 3)::INT AS generation, (o_custkey % 3 + 211)::INT AS seed,
    repeat(o_orderpriority || ' ', (o_orderkey % 25)::INT) AS question,
    ['We add 16 and 26. #### 42', '42', '3/4', 'unknown', 'half of seven' || chr(10) || '#### 3.50'][(o_orderkey % 5 + 1)::INT] AS answer_gold,
    ['Reasoning.' || chr(10) || 'Final answer: 42', 'We get \boxed{{42}}.', 'Steps' || chr(10) || 'Answer: 3/4' || chr(10) || 'Thanks for reading',
     'The answer is 3.50', 'so we have 42.0', 'Final answer: 41' || chr(10) || 'Actually, Final answer: 42', 'The total is 1,234', '   ',
     'I cannot tell', 'Work' || chr(10) || chr(10) || 'Final Answer - (0.75).'][((o_orderkey // 5) % 10 + 1)::INT] AS raw_response
  FROM orders),
cand AS (
  SELECT *, list_filter(list_concat(
      {_found("boxed", r"\\boxed\s*\{([^{}]+)\}")},
      {_found("final_answer_marker", r"(?:^|\n)\s*final\s+answer\s*[:\-]\s*(.+?)(?:\n|$)")},
      {_found("answer_marker", r"(?:^|\n)\s*answer\s*[:\-]\s*(.+?)(?:\n|$)")},
      {_found("the_answer_is", r"(?:^|\n)\s*the\s+answer\s+is\s+(.+?)(?:\n|$)")},
      list_transform(list_filter(string_split(raw_response, chr(10)), lambda l: trim(l) <> '')[-1:],
        lambda x: {{'strategy': 'trailing_numeric', 'raw': {_clean("x")}, 'token': {_token("x")}}})
    ), lambda c: c.token IS NOT NULL) AS found,
    coalesce({_token(r"nullif(regexp_extract(answer_gold, '####\s*([^\n\r]+)', 1), '')")}, {_token("answer_gold")}) AS normalized_gold
  FROM resp),
kinds AS (SELECT *, len(list_distinct(list_transform(found, lambda c: c.token))) AS n_tokens, trim(raw_response) = '' AS blank FROM cand),
ext AS (
  SELECT *, NOT blank AND n_tokens = 1 AS pred_parse_success,
    CASE WHEN NOT blank AND n_tokens = 1 THEN found[-1].raw END AS extracted_answer,
    CASE WHEN NOT blank AND n_tokens = 1 THEN found[-1].token END AS normalized_predicted,
    CASE WHEN blank OR n_tokens = 0 THEN 'none' WHEN n_tokens > 1 THEN 'ambiguous' ELSE found[-1].strategy END AS pred_parse_strategy,
    CASE WHEN blank THEN 'empty_output' WHEN n_tokens = 0 THEN 'no_numeric_candidate' WHEN n_tokens > 1 THEN 'multiple_candidate_answers' END
      AS pred_parse_failure_reason
  FROM kinds),
acc AS (
  SELECT *, accuracy_label = 'correct' AS is_correct FROM (
    SELECT *, CASE WHEN normalized_gold IS NULL THEN 'gold_parse_failure' WHEN normalized_predicted IS NULL THEN 'prediction_parse_failure'
      WHEN {_same("normalized_predicted", "normalized_gold")} THEN 'correct' ELSE 'incorrect' END AS accuracy_label FROM ext)),
dig AS (SELECT order_id, sha256(question || chr(10) || answer_gold || chr(10) || raw_response) AS h FROM resp WHERE order_id % 37 <> 0),
sums AS (
  SELECT order_id, list_sum(list_transform(range(1, 65), lambda i: {_DIGIT})) AS d, ('0x' || substr(h, 63, 2))::INT AS low,
    list_sum(list_transform(range(1, 65), lambda i: {_DIGIT} * [1, 2, 4][((64 - i) % 3 + 1)::INT])) AS s FROM dig),
parts AS (
  SELECT order_id, (d % 3)::INT AS clarity, ((d - low % 4 + 255) % 3)::INT AS structure, ((d - low % 16 + 255) % 3)::INT AS terminology,
    ((d - low % 64 + 255) % 3)::INT AS reasoning_soundness, s % 7 = 0 AS is_silent_error FROM sums),
jud AS (SELECT *, clarity + structure + terminology + reasoning_soundness AS overall_pedagogical_score FROM parts),
part_ev AS (SELECT acc.*, jud.* EXCLUDE (order_id), jud.order_id IS NOT NULL AS has_judge FROM acc LEFT JOIN jud USING (order_id)),
ev AS (SELECT * FROM part_ev WHERE has_judge),
pol AS (
  SELECT *, is_correct AS correct, coalesce(is_silent_error, TRUE) AS silent, NOT pred_parse_success AS defect_parse_failure,
    coalesce(is_silent_error, TRUE) AS defect_silent_error, NOT is_correct AS defect_incorrect_answer,
    coalesce(reasoning_soundness <= 0, TRUE) AS defect_low_reasoning, coalesce(structure <= 0, TRUE) AS defect_low_structure,
    CASE WHEN trim(question) = '' THEN CASE WHEN {_unit("dbr")} < 1.0 / 3 THEN 'short' WHEN {_unit("dbr")} < 2.0 / 3 THEN 'medium' ELSE 'long' END
      WHEN length(trim(question)) <= 80 THEN 'short' WHEN length(trim(question)) <= 180 THEN 'medium' ELSE 'long' END AS length_bin,
    {_unit("soft_pvf")} AS soft_score, {_unit("dbr")} AS dbr_score
  FROM part_ev),
sev AS (
  SELECT *, 4 * defect_parse_failure::INT + 4 * defect_silent_error::INT + 2 * defect_incorrect_answer::INT + 2 * defect_low_reasoning::INT
    + defect_low_structure::INT AS severity FROM pol),
pvf AS (
  SELECT *, reject_reasons = '' AS kept FROM (SELECT *, concat_ws('|', CASE WHEN NOT has_judge THEN 'missing_judge_row' END,
    CASE WHEN NOT pred_parse_success THEN 'pred_parse_failure' END, CASE WHEN NOT correct THEN 'accuracy_incorrect' END,
    CASE WHEN NOT coalesce(overall_pedagogical_score >= 5, FALSE) THEN 'pedagogical_below_threshold' END,
    CASE WHEN silent THEN 'silent_error_true' END) AS reject_reasons FROM sev)),
paired AS (
  SELECT * REPLACE (customer AS example_id) FROM (
    SELECT *, row_number() OVER (PARTITION BY model_name, branch, generation, seed, customer ORDER BY order_id) AS k FROM resp) WHERE k = 1),
pev AS (SELECT ev.* REPLACE (ev.customer AS example_id) FROM ev JOIN paired USING (order_id)),
soft AS (
  SELECT order_id, branch, generation, correct, silent, overall_pedagogical_score, soft_score AS deterministic_score, policy_name,
    w[1]::DOUBLE AS assigned_weight, w[2] AS decision_reason,
    w[1]::DOUBLE >= 1 OR (w[1]::DOUBLE > 0 AND soft_score < w[1]::DOUBLE) AS kept
  FROM (
    SELECT *, CASE WHEN NOT has_judge THEN ['0', 'missing_judge_row'] WHEN NOT pred_parse_success THEN ['0', 'pred_parse_failure']
      WHEN silent THEN ['0', 'silent_error_true']
      WHEN policy_name = 'soft_pvf_silent_only' THEN ['1', 'non_silent_parsed_keep']
      WHEN policy_name = 'soft_pvf_medium' THEN CASE WHEN NOT correct THEN ['0.1', 'incorrect_low_weight']
        WHEN q >= 6 THEN ['1', 'high_quality'] WHEN q >= 4 THEN ['0.5', 'medium_quality'] ELSE ['0.25', 'low_pedagogy_correct'] END
      WHEN policy_name = 'soft_pvf_lenient' THEN CASE WHEN correct AND q >= 6 THEN ['1', 'high_quality']
        WHEN correct AND q >= 4 THEN ['0.75', 'medium_high_quality'] WHEN correct AND q >= 2 THEN ['0.5', 'medium_low_quality']
        WHEN correct THEN ['0.25', 'low_pedagogy_correct'] WHEN q >= 5 THEN ['0.25', 'pedagogical_but_incorrect'] ELSE ['0.1', 'incorrect_low_weight'] END
      ELSE CASE WHEN correct AND q >= 5 THEN ['1', 'correct_high_pedagogy'] WHEN correct AND q >= 3 THEN ['0.75', 'correct_medium_pedagogy']
        WHEN correct THEN ['0.5', 'correct_low_pedagogy'] WHEN q >= 5 THEN ['0.25', 'incorrect_but_high_pedagogy'] ELSE ['0.1', 'incorrect_low_weight'] END
      END AS w
    FROM (SELECT *, overall_pedagogical_score AS q FROM sev)
    CROSS JOIN (SELECT unnest(['soft_pvf_medium', 'soft_pvf_lenient', 'soft_pvf_noisy_keep', 'soft_pvf_silent_only']) AS policy_name))),
rep AS (
  SELECT *, raw_response || chr(10) || 'Final answer: ' || normalized_predicted AS rewritten,
    CASE WHEN NOT has_judge THEN 'missing_judge_row' WHEN NOT pred_parse_success THEN 'pred_parse_failure' WHEN silent THEN 'silent_error_true'
      WHEN NOT correct THEN 'accuracy_incorrect' WHEN overall_pedagogical_score >= 6 THEN 'high_quality' ELSE 'weak' END AS state FROM sev),
lvl AS (
  SELECT model_name, branch, generation, seed, count(*) AS sample_count, avg(is_correct::INT) AS accuracy_mean,
    avg(overall_pedagogical_score) AS pedagogical_score_mean, avg(is_silent_error::INT) AS silent_error_rate,
    sum((NOT pred_parse_success)::INT)::BIGINT AS parse_failure_pred_count, avg((NOT pred_parse_success)::INT) AS parse_failure_pred_rate
  FROM ev GROUP BY ALL),
longer AS (UNPIVOT (SELECT model_name, branch, generation, seed, accuracy_mean, pedagogical_score_mean, silent_error_rate FROM lvl)
  ON accuracy_mean, pedagogical_score_mean, silent_error_rate INTO NAME metric VALUE value),
bucketed AS (SELECT *, CASE WHEN is_silent_error THEN 'silent' WHEN overall_pedagogical_score <= 3 THEN 'low'
    WHEN overall_pedagogical_score >= 6 THEN 'high' ELSE 'ordinary' END AS bucket FROM ev),
csrc AS (
  SELECT * REPLACE (customer AS example_id), row_number() OVER (PARTITION BY model_name, branch, generation, customer ORDER BY order_id) - 1
    AS candidate_id FROM ev),
csro AS (
  SELECT *, row_number() OVER (g ORDER BY pred_parse_success DESC, is_correct DESC, is_silent_error, overall_pedagogical_score DESC,
      reasoning_soundness DESC, structure DESC, candidate_id) AS best_rank,
    row_number() OVER (g ORDER BY is_silent_error DESC, is_correct, pred_parse_success, overall_pedagogical_score, reasoning_soundness, structure,
      candidate_id DESC) AS worst_rank, count(*) OVER g AS n
  FROM csrc WINDOW g AS (PARTITION BY model_name, branch, generation, example_id)),
csrb AS (
  SELECT b.model_name, b.branch, b.generation, b.example_id, b.candidate_id AS best_candidate_id, w.candidate_id AS worst_candidate_id,
    b.overall_pedagogical_score::DOUBLE AS best_score, w.overall_pedagogical_score::DOUBLE AS worst_score,
    (b.overall_pedagogical_score - w.overall_pedagogical_score)::DOUBLE AS quality_gap, b.is_correct AS best_is_correct, w.is_correct AS worst_is_correct,
    b.is_silent_error AS best_is_silent_error, w.is_silent_error AS worst_is_silent_error,
    concat_ws('|', CASE WHEN NOT w.is_correct THEN 'incorrect_answer' END, CASE WHEN NOT w.pred_parse_success THEN 'parse_failure' END,
      CASE WHEN w.is_silent_error THEN 'silent_error' END, CASE WHEN w.clarity = 0 THEN 'low_clarity' END, CASE WHEN w.structure = 0 THEN 'low_structure' END,
      CASE WHEN w.reasoning_soundness = 0 THEN 'low_reasoning' END, CASE WHEN w.terminology = 0 THEN 'low_terminology' END) AS defect_tags,
    CASE WHEN b.candidate_id = w.candidate_id THEN 'best_equals_worst' WHEN NOT b.is_correct THEN 'best_not_correct'
      WHEN b.is_silent_error THEN 'best_silent_error' WHEN b.overall_pedagogical_score - w.overall_pedagogical_score < 2
        AND w.is_correct AND NOT w.is_silent_error AND w.pred_parse_success THEN 'quality_gap_below_threshold' END AS no_pair_reason,
    b.raw_response AS better, w.raw_response AS weak, b.normalized_predicted AS final
  FROM csro AS b JOIN csro AS w ON (b.model_name, b.branch, b.generation, b.example_id) = (w.model_name, w.branch, w.generation, w.example_id)
    AND b.best_rank = 1 AND w.worst_rank = (SELECT CASE WHEN x.worst_rank = 1 AND x.n > 1 THEN 2 ELSE 1 END FROM (SELECT b.worst_rank, b.n) AS x)),
csr AS (SELECT *, CASE WHEN no_pair_reason IS NULL THEN 'paired' ELSE 'no_pair' END AS pair_status FROM csrb),
prs AS (
  SELECT model_name, seed, example_id, concat_ws('/', model_name, seed::VARCHAR, example_id) AS pair_key,
    max(raw_response) FILTER (branch = 'pure_recycling') AS pure_response, max(raw_response) FILTER (branch = 'dbr_medium') AS dbr_response,
    max(overall_pedagogical_score) FILTER (branch = 'pure_recycling') AS pure_score, max(overall_pedagogical_score) FILTER (branch = 'dbr_medium') AS dbr_score
  FROM pev WHERE generation = 1 AND branch IN ('pure_recycling', 'dbr_medium') GROUP BY ALL HAVING count(*) = 2),
quota AS (
  SELECT seed, 40 // count(*) OVER () + (row_number() OVER (ORDER BY seed) <= 40 % count(*) OVER ())::INT AS q FROM (SELECT DISTINCT seed FROM prs)),
bal AS (
  SELECT * FROM (SELECT prs.*, q, row_number() OVER (PARTITION BY seed ORDER BY sha256(concat_ws('|', 'pair-0', seed::VARCHAR, pair_key)), pair_key) AS k
    FROM prs JOIN quota USING (seed)) WHERE k <= q),
blind AS (
  SELECT *, 'pair_' || lpad((row_number() OVER (ORDER BY pair_key))::VARCHAR, 4, '0') AS pair_id,
    ('0x' || substr(sha256('coin-0|' || pair_key), 1, 1))::INT % 2 = 0 AS coin FROM bal),
won AS (
  SELECT *, CASE WHEN pure_score = dbr_score THEN 'Tie' WHEN (pure_score > dbr_score) = coin THEN 'A' ELSE 'B' END AS winner,
    CASE WHEN pure_score = dbr_score THEN 'Tie' WHEN pure_score > dbr_score THEN 'pure_recycling' ELSE 'dbr_medium' END AS winner_branch FROM blind)
"""

CTX = "model_name, branch, generation, seed"


def _delta(m: str, by: str, on: str, extra: str) -> str:
    return f"SELECT {by}, {extra}, r.accuracy_mean - l.accuracy_mean AS delta_accuracy_mean, r.pedagogical_score_mean - l.pedagogical_score_mean AS delta_pedagogical_score_mean, r.silent_error_rate - l.silent_error_rate AS delta_silent_error_rate FROM {m} AS l JOIN {m} AS r ON {on}"


def _stats(source: str, by: str) -> str:
    """Mean, deviation and normal interval of value, by seed."""
    return f"""
      SELECT {by}, count(DISTINCT seed) AS n_seeds, count(value) AS n_values, round(m, 9) AS mean, round(s, 9) AS std,
        round(m - CASE WHEN n > 1 THEN 1.96 * s / sqrt(n) ELSE 0 END, 9) AS ci_low, round(m + CASE WHEN n > 1 THEN 1.96 * s / sqrt(n) ELSE 0 END, 9) AS ci_high
      FROM (SELECT *, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS s, count(value) OVER w AS n FROM {source} WINDOW w AS (PARTITION BY {by}))
      GROUP BY {by}, m, s, n"""


SQL = {
    "b01_stable_id": "SELECT order_id, 'gsm_' || substr(sha256('gsm' || chr(10) || trim(question) || chr(10) || trim(answer_gold)), 1, 16) AS stable_id FROM resp",
    "b06_extract": "SELECT order_id, extracted_answer, normalized_predicted, pred_parse_success, pred_parse_strategy, pred_parse_failure_reason FROM ext",
    "b08_gold_normalize": "SELECT order_id, normalized_gold FROM ext",
    "b10_score": "SELECT order_id, accuracy_label, is_correct FROM acc",
    "b12_unit_score": "SELECT order_id, dbr_score, soft_score FROM pol",
    "b15_defect_flags": "SELECT order_id, defect_parse_failure, defect_silent_error, defect_incorrect_answer, defect_low_reasoning, defect_low_structure, severity FROM sev",
    "b17_length_bin": "SELECT order_id, length_bin FROM pol",
    "b20_bucketize": "SELECT order_id, bucket FROM bucketed",
    "b33_rubric_ranges": "SELECT generation, count(*) AS n_rows, count(*) FILTER (overall_pedagogical_score BETWEEN 0 AND 8 AND least(clarity, structure, terminology, reasoning_soundness) >= 0 AND greatest(clarity, structure, terminology, reasoning_soundness) <= 2) AS n_valid FROM ev GROUP BY 1",
    "b45_response_fingerprint": f"SELECT {CTX}, sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint FROM (SELECT {CTX}, order_id // 4096 AS b, sha256(string_agg(raw_response, chr(10) ORDER BY order_id)) AS h FROM resp GROUP BY ALL) GROUP BY {CTX}",
    "a20_mock_judge": "SELECT order_id, clarity, structure, terminology, reasoning_soundness, overall_pedagogical_score, is_silent_error FROM jud",
    "d03_eval_merged": f"SELECT order_id, example_id, {CTX}, is_correct, accuracy_label, overall_pedagogical_score, is_silent_error FROM ev",
    "d25_pending_rows": "SELECT order_id, example_id FROM resp WHERE order_id NOT IN (SELECT order_id FROM jud)",
    "d09_run_compare": """, g AS (SELECT seed, model_name, branch, generation, count(*) AS n, avg(is_correct::INT) AS a, avg(overall_pedagogical_score) AS p,
        avg(is_silent_error::INT) AS s FROM ev GROUP BY ALL)
      SELECT coalesce(o.model_name, w.model_name) AS model_name, coalesce(o.branch, w.branch) AS branch, coalesce(o.generation, w.generation) AS generation,
        CASE WHEN o.n IS NULL THEN 'right_only' WHEN w.n IS NULL THEN 'left_only' ELSE 'both' END AS merge_side, w.n - o.n AS delta_sample_count,
        w.a - o.a AS delta_accuracy_mean, w.p - o.p AS delta_pedagogical_score_mean, w.s - o.s AS delta_silent_error_rate
      FROM (FROM g WHERE seed = 211) AS o FULL JOIN (FROM g WHERE seed = 212 AND generation > 0) AS w
        ON (o.model_name, o.branch, o.generation) = (w.model_name, w.branch, w.generation)""",
    "d12_matched_gen2": """SELECT p.seed, count(*) AS n_matched, avg(d.is_correct::INT - p.is_correct::INT) AS delta_is_correct,
        avg(d.overall_pedagogical_score - p.overall_pedagogical_score) AS delta_overall_pedagogical_score,
        avg(d.is_silent_error::INT - p.is_silent_error::INT) AS delta_is_silent_error
      FROM pev AS p JOIN pev AS d ON (p.model_name, p.seed, p.example_id) = (d.model_name, d.seed, d.example_id)
      WHERE p.generation = 2 AND d.generation = 2 AND p.branch = 'pure_recycling' AND d.branch = 'dbr_medium' GROUP BY 1""",
    "d15_decline_trajectory": """SELECT a.model_name, a.branch, a.seed, a.example_id, a.overall_pedagogical_score AS score_0, b.overall_pedagogical_score AS score_1,
        c.overall_pedagogical_score AS score_2, a.overall_pedagogical_score - c.overall_pedagogical_score AS decline
      FROM pev AS a JOIN pev AS b ON (a.model_name, a.branch, a.seed, a.example_id) = (b.model_name, b.branch, b.seed, b.example_id)
      JOIN pev AS c ON (a.model_name, a.branch, a.seed, a.example_id) = (c.model_name, c.branch, c.seed, c.example_id)
      WHERE a.generation = 0 AND b.generation = 1 AND c.generation = 2 AND score_0 > score_1 AND score_1 > score_2""",
    "e01_metrics_by_generation": "SELECT branch, generation, model_name, avg(is_correct::INT) AS accuracy, avg(overall_pedagogical_score) AS pedagogical_score_mean, avg(is_silent_error::INT) AS silent_error_rate, count(*) AS n FROM ev GROUP BY ALL",
    "e03_feasibility_summary": "SELECT branch, generation, count(*) AS sample_count, avg(is_correct::INT) AS accuracy_mean, avg(overall_pedagogical_score) AS pedagogical_score_mean, avg(is_silent_error::INT) AS silent_error_rate, sum((NOT pred_parse_success)::INT)::BIGINT AS parse_failure_pred_count, avg((NOT pred_parse_success)::INT) AS parse_failure_pred_rate, string_agg(DISTINCT model_name, '|' ORDER BY model_name) AS model_names FROM ev GROUP BY ALL",
    "e04_parse_failure": f"SELECT {CTX}, count(*) FILTER (NOT pred_parse_success) AS n_failed, avg((NOT pred_parse_success)::INT) AS failure_rate, count(*) AS n_rows FROM acc GROUP BY ALL",
    "i01_run_level": "SELECT *, 'run_seed' || seed AS run_id, 'inference' AS evaluation_mode FROM lvl",
    "e05_seed_stats": _stats("longer", "model_name, branch, generation, metric"),
    "e06_bootstrap_ci": """, v AS (SELECT model_name, branch, generation, metric, list(value ORDER BY seed) AS v FROM longer GROUP BY ALL),
      d AS (SELECT *, unnest(range(len(v))) AS pos FROM (SELECT *, unnest(range(2000)) AS rep FROM v)),
      m AS (SELECT model_name, branch, generation, metric, rep, avg(v[(('0x' || substr(sha256(concat_ws('|', '7', model_name, branch, generation::VARCHAR, metric,
        rep::VARCHAR, pos::VARCHAR)), 1, 8))::BIGINT % len(v) + 1)::INT]) AS m FROM d GROUP BY ALL)
      SELECT model_name, branch, generation, metric, round(list_sort(list(m))[50], 9) AS boot_low, round(list_sort(list(m))[1950], 9) AS boot_high FROM m GROUP BY ALL""",
    "e08_judge_correlation": "SELECT branch, generation, round(corr(overall_pedagogical_score, clarity), 9) AS correlation, count(*) AS n FROM ev GROUP BY ALL",
    "e10_branch_summary": """SELECT branch, generation, count(*) AS n, avg((clarity + structure) * 2 - overall_pedagogical_score) AS mean_delta,
      avg(abs((clarity + structure) * 2 - overall_pedagogical_score)) AS mean_abs_delta, avg(((terminology = 0) = is_silent_error)::INT) AS silent_agreement
      FROM ev GROUP BY ALL""",
    "e12_pairwise_summary": """SELECT seed, count(*) AS n_pairs, avg((winner_branch = 'pure_recycling')::INT) AS pure_rate, avg((winner_branch = 'dbr_medium')::INT) AS dbr_rate,
      avg((winner_branch = 'Tie')::INT) AS tie_rate, CASE WHEN seed IS NULL THEN 'overall' ELSE 'seed' END AS scope FROM won GROUP BY GROUPING SETS ((seed), ())""",
    "e17_severity_p90": "SELECT branch, generation, count(*) AS n, avg(severity) AS mean_severity, round(quantile_cont(severity, 0.9), 9) AS p90_severity FROM sev GROUP BY ALL",
    "e20_defect_rates": " UNION ALL ".join(f"SELECT branch, generation, '{n}' AS defect, avg(defect_{n}::INT) AS rate_before, coalesce(avg(defect_{n}::INT) FILTER (kept), 0) AS rate_after, coalesce(avg(defect_{n}::INT) FILTER (kept), 0) - avg(defect_{n}::INT) AS delta FROM pvf GROUP BY branch, generation" for n in ("parse_failure", "silent_error", "incorrect_answer", "low_reasoning", "low_structure")),
    "e20_bucket_coverage": "SELECT branch, generation, length_bin, count(*) AS n_before, count(*) FILTER (kept) AS n_after, count(*) FILTER (kept) / greatest(sum(count(*) FILTER (kept)) OVER (PARTITION BY branch, generation), 1) AS share_after FROM pvf GROUP BY branch, generation, length_bin",
    "e21_reason_counts": "SELECT branch, generation, decision_reason, count(*) AS n FROM soft WHERE policy_name = 'soft_pvf_medium' GROUP BY ALL",
    "e22_keep_vs_rejected": "SELECT branch, kept, count(*) AS n, avg(overall_pedagogical_score) AS mean_overall_pedagogical_score, avg(correct::INT) AS mean_correct, avg(silent::INT) AS mean_silent FROM soft WHERE policy_name = 'soft_pvf_medium' GROUP BY ALL",
    "e23_keep_repair_reject": "SELECT branch, CASE state WHEN 'high_quality' THEN 'keep_original' WHEN 'weak' THEN 'repair' ELSE 'reject' END AS action, count(*) AS n, avg(overall_pedagogical_score) AS mean_overall_pedagogical_score, avg(correct::INT) AS mean_correct, avg(silent::INT) AS mean_silent FROM rep GROUP BY ALL",
    "e24_repair_success": """SELECT branch, generation, count(*) FILTER (state = 'weak') AS n_attempted, count(*) FILTER (state = 'weak' AND length(rewritten) <= 40) AS n_success,
      count(*) FILTER (state = 'weak' AND length(rewritten) > 40) AS n_failed,
      coalesce(count(*) FILTER (state = 'weak' AND length(rewritten) <= 40) / nullif(count(*) FILTER (state = 'weak'), 0), 0) AS success_rate FROM rep GROUP BY ALL""",
    "e25_weight_distribution": "SELECT assigned_weight, count(*) AS n FROM soft WHERE policy_name = 'soft_pvf_lenient' GROUP BY ALL",
    "e28_failure_buckets": "SELECT branch, generation, category, count(*) AS n FROM (SELECT *, {h15} AS category FROM acc) GROUP BY ALL",
    "e32_collapse_flags": """, g AS (SELECT seed, branch, generation, avg(is_correct::INT) AS accuracy_mean, avg(overall_pedagogical_score) AS pedagogical_score_mean,
        avg(is_silent_error::INT) AS silent_error_rate FROM ev GROUP BY ALL),
      l AS (UNPIVOT g ON accuracy_mean, pedagogical_score_mean, silent_error_rate INTO NAME metric VALUE v),
      s AS (SELECT a.branch, a.metric, a.seed, 'g' || b.generation || '-g' || a.generation AS step, b.v - a.v AS value FROM l AS a JOIN l AS b
        ON (a.seed, a.branch, a.metric) = (b.seed, b.branch, b.metric) AND a.generation < b.generation),
      t AS (""" + _stats("s", "branch, metric, step") + """)
      SELECT branch, metric, step, n_values, mean, ci_low, ci_high, CASE WHEN n_values < 2 THEN 'inconclusive'
        WHEN (metric <> 'silent_error_rate' AND ci_low > 0) OR (metric = 'silent_error_rate' AND ci_high < 0) THEN 'improvement'
        WHEN (metric <> 'silent_error_rate' AND ci_high < 0) OR (metric = 'silent_error_rate' AND ci_low > 0) THEN 'deterioration' ELSE 'mixed' END AS flag FROM t""",
    "e33_gen2_summary": """, g AS (SELECT seed, branch, avg(is_correct::INT) AS accuracy_mean, avg(overall_pedagogical_score) AS pedagogical_score_mean,
        avg(is_silent_error::INT) AS silent_error_rate FROM ev WHERE generation = 2 GROUP BY ALL),
      l AS (UNPIVOT g ON accuracy_mean, pedagogical_score_mean, silent_error_rate INTO NAME metric VALUE v),
      s AS (SELECT a.branch, 'delta_' || a.metric AS metric, a.seed, a.v - p.v AS value FROM l AS a JOIN l AS p ON (a.seed, a.metric) = (p.seed, p.metric)
        WHERE p.branch = 'pure_recycling' AND a.branch <> 'pure_recycling'),
      t AS (""" + _stats("s", "branch, metric") + """)
      SELECT t.branch, t.metric, n_positive, n_negative, mean, ci_low, ci_high FROM t JOIN (SELECT branch, metric, count(*) FILTER (value > 0) AS n_positive,
        count(*) FILTER (value < 0) AS n_negative FROM s GROUP BY ALL) AS u ON (t.branch, t.metric) = (u.branch, u.metric)""",
    "b27_json_extract": """, b AS (SELECT *, '{"clarity":' || clarity || ',"structure":' || structure || ',"terminology":' || terminology || ',"reasoning_soundness":' || reasoning_soundness || ',"overall_pedagogical_score":' AS head FROM jud)
      SELECT order_id, CASE order_id % 6 WHEN 0 THEN 'direct' WHEN 1 THEN 'embedded' WHEN 2 THEN 'embedded' WHEN 3 THEN 'direct' WHEN 4 THEN 'truncated' END AS found,
        CASE order_id % 6 WHEN 3 THEN length(head || overall_pedagogical_score || ',"comment":"none"}') WHEN 5 THEN NULL
          ELSE length(head || (overall_pedagogical_score + (order_id % 3 = 0)::INT) || ',"is_silent_error":' || is_silent_error || ',"comment":"ok {\\"so\\"}"}') END AS n_body FROM b""",
    "b32_judge_parse": """SELECT order_id, CASE order_id % 6 WHEN 0 THEN 'direct' WHEN 1 THEN 'embedded' WHEN 2 THEN 'embedded' WHEN 3 THEN 'direct' WHEN 4 THEN 'truncated' END AS found,
      CASE order_id % 6 WHEN 3 THEN 'missing_keys' WHEN 5 THEN 'no_json_object' END AS error,
      CASE WHEN order_id % 6 NOT IN (3, 5) THEN overall_pedagogical_score END AS overall_pedagogical_score, CASE WHEN order_id % 6 NOT IN (3, 5) THEN is_silent_error END AS is_silent_error,
      CASE WHEN order_id % 6 NOT IN (3, 5) THEN CASE WHEN order_id % 3 = 0 THEN 'recomputed_overall' ELSE '' END END AS repairs FROM jud""",
    "c01_pvf_kept": "SELECT order_id, example_id, question, raw_response AS answer_for_training, 'synthetic' AS source FROM pvf WHERE kept",
    "c01_pvf_rejected": "SELECT order_id, reject_reasons FROM pvf WHERE NOT kept",
    "c01_pvf_report": """SELECT branch, generation, count(*) AS n_rows, count(*) FILTER (kept) AS n_kept, avg(kept::INT) AS keep_rate,
      avg(overall_pedagogical_score) FILTER (kept) AS kept_score, avg(overall_pedagogical_score) FILTER (NOT kept) AS rejected_score,
      avg(is_correct::INT) FILTER (kept) AS kept_accuracy, avg(is_correct::INT) FILTER (NOT kept) AS rejected_accuracy FROM pvf GROUP BY ALL""",
    "c02_soft_decisions": "SELECT order_id, policy_name, assigned_weight, decision_reason, deterministic_score, kept FROM soft",
    "c02_soft_report": "SELECT branch, generation, count(*) AS n_rows, avg(kept::INT) AS keep_rate, round(avg(assigned_weight), 9) AS mean_weight, avg(correct::INT) FILTER (kept) AS kept_accuracy FROM soft WHERE policy_name = 'soft_pvf_noisy_keep' GROUP BY ALL",
    "c03_dbr_set": f"SELECT {CTX}, example_id FROM sev WHERE NOT defect_parse_failure",
    "c04_pvr_actions": """SELECT order_id, CASE state WHEN 'high_quality' THEN 'keep_original' WHEN 'weak' THEN 'repair' ELSE 'reject' END AS action,
      CASE state WHEN 'weak' THEN 'pedagogical_repair_needed' ELSE state END AS decision_reason, CASE WHEN state = 'weak' THEN sha256(rewritten) END AS repaired_sha256 FROM rep""",
    "c05_pair_lite_actions": """SELECT order_id, CASE WHEN state = 'high_quality' THEN 'keep_original' WHEN state = 'weak' AND length(rewritten) <= 40 THEN 'repair' ELSE 'reject' END AS action,
      CASE WHEN state <> 'weak' THEN state WHEN length(rewritten) <= 40 THEN 'correct_but_pedagogically_weak' ELSE 'repair_failed' END AS decision_reason,
      CASE WHEN state = 'weak' AND length(rewritten) <= 40 THEN rewritten END AS repaired_answer,
      CASE WHEN state = 'high_quality' OR (state = 'weak' AND length(rewritten) <= 40) THEN 'pair_lite' END AS source_out FROM rep""",
    "c06_csr_pairs": "SELECT * EXCLUDE (better, weak, final) FROM csr",
    "c06_csr_report": "SELECT branch, generation, count(*) AS n_examples, count(*) FILTER (pair_status = 'paired') AS n_pairs, avg((pair_status = 'paired')::INT) AS pair_rate, avg(quality_gap) FILTER (pair_status = 'paired') AS mean_gap FROM csr GROUP BY ALL",
    "c06_csr_training": """SELECT model_name, branch, generation, example_id, array_to_string(['Question:', example_id, '', 'Weak explanation:', weak, '',
      'Detected pedagogical problems:', CASE WHEN defect_tags = '' THEN '- none_detected' ELSE '- ' || replace(defect_tags, '|', chr(10) || '- ') END, '',
      'Better explanation:', better, '', 'Final answer:', final], chr(10)) AS answer_for_training FROM csr WHERE pair_status = 'paired'""",
    "c13_used_anchors": "SELECT g.branch, g.generation, count(*) AS n_used FROM (SELECT DISTINCT branch, unnest([0, 1, 2]) AS generation FROM resp) AS g JOIN (SELECT branch, customer, min(generation) AS first FROM resp GROUP BY ALL) AS f ON f.branch = g.branch AND f.first < g.generation GROUP BY ALL",
    "f01_policy_ranks": """, r AS (SELECT policy_name, avg(kept::INT) AS keep_rate, avg(correct::INT) FILTER (kept) AS kept_accuracy,
        avg(overall_pedagogical_score) FILTER (kept) AS kept_score FROM soft GROUP BY ALL)
      SELECT *, rank() OVER (ORDER BY keep_rate DESC) AS rank_keep_rate, rank() OVER (ORDER BY kept_accuracy DESC) AS rank_kept_accuracy,
        rank() OVER (ORDER BY kept_score DESC) AS rank_kept_score FROM r""",
    "f02_latest": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "f04_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "f07_generation_deltas": _delta("lvl", "l.model_name, l.branch, l.seed", "(l.model_name, l.branch, l.seed) = (r.model_name, r.branch, r.seed) AND l.generation < r.generation", "l.generation AS from_generation, r.generation AS to_generation"),
    "f08_branch_deltas": _delta("lvl", "l.model_name, l.generation, l.seed", "(l.model_name, l.generation, l.seed) = (r.model_name, r.generation, r.seed) AND l.branch = 'pure_recycling' AND r.branch <> 'pure_recycling'", "r.branch"),
    "f09_mode_deltas": _delta("lvl", "l.branch, l.generation, l.seed", "(l.branch, l.generation, l.seed) = (r.branch, r.generation, r.seed) AND l.model_name = 'model_0' AND r.model_name <> 'model_0'", "r.model_name"),
    "f10_ratio_deltas": ", q AS (SELECT *, CASE branch WHEN 'pure_recycling' THEN 0 WHEN 'dbr_medium' THEN 10 ELSE 20 END AS ratio FROM lvl) " + _delta("q", "l.model_name, l.generation, l.seed", "(l.model_name, l.generation, l.seed) = (r.model_name, r.generation, r.seed) AND l.ratio < r.ratio", "l.ratio AS low_ratio, r.ratio AS high_ratio"),
    "g02_splits": "SELECT example_id, CASE WHEN k <= 500 THEN 'base_train' WHEN k <= 800 THEN 'anchor_pool' ELSE 'heldout_test' END AS split FROM (SELECT example_id, row_number() OVER (ORDER BY sha256('split-42|' || example_id), example_id) AS k FROM resp) WHERE k <= 1000",
    "g05_round_robin": """, i AS (SELECT *, row_number() OVER (PARTITION BY branch, generation, bucket ORDER BY sha256(concat_ws('|', 'bucket-0', branch, generation::VARCHAR, example_id)),
        example_id) AS i, list_position(['silent', 'low', 'high', 'ordinary'], bucket) AS b FROM bucketed)
      SELECT branch, generation, bucket, example_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY branch, generation ORDER BY i, b, example_id) AS pick FROM i) WHERE pick <= 10""",
    "g07_balanced_pairs": "SELECT seed, pair_key FROM bal",
    "g08_blinded_pairs": """SELECT pair_id, pair_key, CASE WHEN coin THEN pure_response ELSE dbr_response END AS response_a, CASE WHEN coin THEN dbr_response ELSE pure_response END AS response_b,
      CASE WHEN coin THEN 'pure_recycling' ELSE 'dbr_medium' END AS branch_a, CASE WHEN coin THEN 'dbr_medium' ELSE 'pure_recycling' END AS branch_b FROM blind""",
    "g09_decode_winner": "SELECT pair_id, winner, winner_branch, winner_branch = 'pure_recycling' AS pure_recycling_win, winner_branch = 'dbr_medium' AS dbr_medium_win FROM won",
    "g12_silent_candidates": f"SELECT {CTX}, example_id, overall_pedagogical_score FROM ev WHERE is_correct AND is_silent_error AND overall_pedagogical_score <= 2",
    "h02_disjoint": "SELECT a.branch AS left_split, b.branch AS right_split, count(DISTINCT a.customer) AS n_shared FROM resp AS a JOIN resp AS b ON a.customer = b.customer AND a.branch < b.branch GROUP BY ALL",
    "h03_set_equality": "SELECT count(*) FILTER (jud.order_id IS NULL) AS only_left, count(*) FILTER (resp.order_id IS NULL) AS only_right, count(*) FILTER (resp.order_id IS NOT NULL AND jud.order_id IS NOT NULL) AS in_both FROM resp FULL JOIN jud ON resp.order_id = jud.order_id",
    "h09_summary_recompute": """SELECT branch, generation, metric, CASE WHEN branch = 'pure_recycling' AND generation = 2 THEN 'missing_value'
      WHEN branch = 'dbr_medium' AND metric = 'accuracy_mean' THEN 'mismatch' ELSE 'ok' END AS status
      FROM (SELECT DISTINCT branch, generation FROM ev) CROSS JOIN (SELECT unnest(['accuracy_mean', 'pedagogical_score_mean', 'silent_error_rate']) AS metric)""",
    "h15_diagnose": "SELECT order_id, branch, generation, {h15} AS category FROM acc",
    "k01_resume": "SELECT CASE WHEN order_id % 2 = 0 THEN 1 ELSE 2 END AS attempt, count(*) AS n, count(DISTINCT order_id) AS n_keys FROM resp GROUP BY 1",
    "k02_judge_dedupe_fanout": """, a AS (SELECT order_id, sha256(question || chr(10) || answer_gold || chr(10) || raw_response) AS h FROM resp),
      b AS (SELECT order_id, list_sum(list_transform(range(1, 65), lambda i: ('0x' || substr(h, i, 1))::INT)) AS d, ('0x' || substr(h, 63, 2))::INT AS low FROM a)
      SELECT order_id, (d % 3 + (d - low % 4 + 255) % 3 + (d - low % 16 + 255) % 3 + (d - low % 64 + 255) % 3)::INT AS score FROM b""",
    "k04_unresolved_failures": "SELECT user_id, max(event_id) AS event_id, 'error' AS event_type FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id",
}


def _anchors(replace: bool) -> str:
    kept = "WHERE k > need" if replace else ""
    order = "sha256(concat_ws('|', '{}', model_name, branch, generation::VARCHAR, seed::VARCHAR, example_id)), example_id"
    return f"""
, n AS (SELECT {CTX}, round_even(count(*) * 0.05::DOUBLE, 0)::BIGINT AS need FROM resp GROUP BY ALL),
pool AS (
  SELECT 'model_' || (p_partkey % 2) AS model_name, ['pure_recycling', 'dbr_medium', 'anchor_20_append'][((p_partkey // 2) % 3 + 1)::INT] AS branch,
    ((p_partkey // 6) % 3)::INT AS generation, ((p_partkey // 18) % 3 + 211)::INT AS seed, 'a_' || p_partkey AS example_id FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY {CTX} ORDER BY {order.format("anchor")}) AS k FROM pool),
s AS (SELECT {CTX}, example_id, row_number() OVER (PARTITION BY {CTX} ORDER BY {order.format("replace")}) AS k FROM resp)
SELECT {CTX}, example_id, 'synthetic' AS source FROM s JOIN n USING ({CTX}) {kept}
UNION ALL SELECT {CTX}, example_id, 'human_anchor' FROM a JOIN n USING ({CTX}) WHERE k <= need"""


SQL["c07_anchor_append"], SQL["c07_anchor_replace"] = _anchors(False), _anchors(True)

#: What an audit of a response finds.
H15 = """CASE accuracy_label WHEN 'gold_parse_failure' THEN 'parse_failure_gold' WHEN 'prediction_parse_failure' THEN 'parse_failure_pred'
  WHEN 'incorrect' THEN 'model_is_wrong' ELSE CASE WHEN replace(trim(raw_response), ',', '') <> trim(answer_gold) AND normalized_predicted <> normalized_gold
  THEN 'normalization_mismatch' ELSE 'correct' END END"""


def oracle_sql() -> dict[str, str]:
    return {name: BASE + sql.replace("{h15}", H15) for name, sql in SQL.items()}
