"""Queries over what runs leave behind: committed contexts, a judge's cache, trees of artifacts and reports, replayed selections."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gyre.functions import hashing, quality, text_rules
from gyre.operators import checks, dbr, numbering, policies
from gyre.plans import judging, oracles
from gyre.plans import queries as q
from gyre.sources import bindings, commits, runs, sinks
from gyre.sources.shared import new_folder, written
from gyre.streaming import resume
from gyre.streaming.cache import JudgeCache

CTX = bindings.CONTEXT
PURE, DBR, ANCHORED = "pure_recycling", "dbr_medium", "anchor_20_append"


def _tree():
    """The levels of a tree for a row's context."""
    return [F.concat(F.lit("run_seed"), "seed").alias("run"), F.col("model_name").alias("model_dir"), F.col("branch").alias("branch_dir"), F.concat(F.lit("gen_"), "generation").alias("generation_dir")]


def _cache_key():
    """The digest of provider, model and input of a judge's call."""
    payload = F.to_json(F.struct("question", "answer_gold", "raw_response"))
    return payload, F.sha2(F.concat_ws("|", F.lit("mock"), F.lit("rubric"), "customer", "question", "answer_gold", "raw_response"), 256)


def a16_judge_cache(spark, sf_dir):
    """A cache filled from two branches, damaged by the later generations of one, filled again by its last, compacted, then asked for every row."""
    payload, key = _cache_key()
    rows = bindings.responses(spark, sf_dir).select("*", key.alias("cache_key"), payload.alias("key_payload_json"))
    entry = rows.select("branch", "generation", "cache_key", F.lit("mock").alias("provider"), F.lit("rubric").alias("model_name"), F.lit("score").alias("call_type"), F.lit("v1").alias("schema_version"), "key_payload_json", "raw_response", F.lit("[]").alias("repair_actions_json"))
    cache = JudgeCache(spark, new_folder(spark, "judge-cache"))
    cache.put(entry.filter(F.col("branch").isin(PURE, DBR)))
    cache.put(entry.filter((F.col("branch") == DBR) & (F.col("generation") >= 1)).withColumn("repair_actions_json", F.lit("{damaged")))
    cache.put(entry.filter((F.col("branch") == DBR) & (F.col("generation") == 2)).withColumn("repair_actions_json", F.lit('["again"]')))
    cache.compact()
    found = cache.get(rows.select("branch", "generation", "cache_key"))
    return found.groupBy("branch", "generation").agg(F.count("*").alias("n_rows"), F.count_if("hit").alias("n_hits"), F.count_if(~F.col("hit")).alias("n_misses"), F.count_if(F.size("repair_actions") > 0).alias("n_repaired"))


def c15_committed_contexts(spark, sf_dir):
    """Contexts from two commits, the second of which replaces one branch, beside a part that was never committed."""
    place, by = new_folder(spark, "committed"), ["branch", "generation"]
    rows = bindings.responses(spark, sf_dir).select("branch", "generation", "order_id", "raw_response")
    commits.save(rows, place, by)
    commits.save(rows.filter((F.col("branch") == DBR) & (F.length("raw_response") > 12)), place, by)
    commits.write_part(rows.filter(F.col("branch") == PURE).limit(5), place, by)
    return commits.verified(spark, place, rows.schema, by)


def k02_judged_batches(spark, sf_dir):
    """Three batches, one a generation, through the keyed state of a stream: inputs scored in each, rows that failed, and failures still open."""
    place = new_folder(spark, "batches")
    rows = bindings.responses(spark, sf_dir).select("order_id", "generation", "customer", "answer_gold", "raw_response")
    inputs = ["customer", "answer_gold", "raw_response"]

    def score(new):
        return new.withColumn("score", hashing.mock_judgement(F.col("customer"), F.col("answer_gold"), F.col("raw_response"))["overall_pedagogical_score"])

    for generation in range(3):
        resume.judged_batch(rows.filter(F.col("generation") == generation), generation, score, place, ["order_id"], inputs, ["score"], F.col("score") <= 1, 10**9)
    tried = spark.read.parquet(f"{place}/tried").groupBy("batch").agg(F.count("*").alias("n_scored"), F.count_if("failed").alias("n_failed_inputs"))
    done = spark.read.parquet(f"{place}/results").groupBy("batch").agg(F.count("*").alias("n_done"))
    still = resume.open_failures(spark, place, ["order_id"]).groupBy("batch").agg(F.count("*").alias("n_open"))
    return tried.join(done, "batch", "left").join(still, "batch", "left").na.fill(0)


def _report_tree(spark, sf_dir):
    """A report for each context.  Those of generation 0 are older and lack some fields; one file beside them is cut off."""
    root = runs.new_tree(spark)
    rows = dbr.flagged(q._policy_rows(spark, sf_dir)).withColumn("selected", ~F.col("defect_parse_failure"))
    rates = [F.round(F.avg(F.col(f"defect_{n}").cast("int")), 9) for n in quality.DEFECTS]
    after = [F.round(F.coalesce(F.avg(F.when(F.col("selected"), F.col(f"defect_{n}").cast("int"))), F.lit(0.0)), 9) for n in quality.DEFECTS]

    def of(values, names=quality.DEFECTS):
        return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values))

    report = rows.groupBy(*CTX).agg(F.count("*").alias("total"), F.count_if("selected").alias("selected_count"), of(rates).alias("defect_rates_before"), of(after).alias("defect_rates_after"))
    newer = F.col("generation") > 0
    violation = F.struct(F.col("defect_rates_after")["silent_error"].alias("actual_rate"), F.col("selected_count").alias("violation_count"))
    report = report.select(
        *_tree(), "model_name", "branch", "generation", F.col("total").alias("target_size"), "selected_count", "defect_rates_before", "defect_rates_after",
        F.when(newer, F.round(F.col("selected_count") / F.col("total"), 9)).alias("selection_rate"),
        F.when(newer, of([F.lit(0.1), F.lit(0.3)], ("silent_error", "incorrect_answer"))).alias("budgets"),
        F.when(newer, F.map_from_arrays(F.array(F.lit("silent_error")), F.array(violation))).alias("budget_violations"),
        F.when(F.col("generation") == 2, F.array(F.lit("relax_low_structure"))).alias("relaxation_steps_used"),
    )
    runs.save_tree(written(report, "reports"), root, "dbr_budget_report.json")
    broken = spark.range(1).select(F.lit('{"model_name": "cut o').alias("value"))
    broken.coalesce(1).write.mode("append").text(f"{root}/run=run_seed9/model_dir=m/branch_dir=b/generation_dir=gen_1/artifact=dbr_budget_report.json")
    return root


#: Fields of a budget report, with what an older one is taken to say.
REPORT = {
    "model_name": ("string", ""), "branch": ("string", ""), "generation": ("int", 0), "target_size": ("bigint", 0), "selected_count": ("bigint", 0),
    "selection_rate": ("double", 0.0), "min_selection_rate": ("double", 0.0), "budgets": ("map<string,double>", {}),
    "defect_rates_before": ("map<string,double>", {}), "defect_rates_after": ("map<string,double>", {}),
    "budget_violations": ("map<string,struct<actual_rate:double,violation_count:bigint>>", {}), "relaxation_steps_used": ("array<string>", []),
}


def m10_dbr_reports(spark, sf_dir):
    good, _ = runs.reports(spark, _report_tree(spark, sf_dir), "dbr_budget_report.json", REPORT)
    return good.select("run", "seed", "model_name", "branch", "generation", "target_size", "selected_count", "selection_rate", "min_selection_rate", F.size("budgets").alias("n_budgets"), F.array_join("relaxation_steps_used", "|").alias("relaxation_steps_used"))


def m10_quarantine(spark, sf_dir):
    """Files that cannot be read, and the reports that can, by run."""
    good, bad = runs.reports(spark, _report_tree(spark, sf_dir), "dbr_budget_report.json", REPORT)
    return good.select("run", F.lit(0).alias("bad")).union(bad.select("run", F.lit(1))).groupBy("run").agg(F.count_if(F.col("bad") == 0).alias("n_good"), F.count_if(F.col("bad") == 1).alias("n_damaged"))


def m19_policy_tables(spark, sf_dir):
    """One row a report and defect, whatever defects the report names: rates, budget, and the rate that the violation states or else the one after."""
    good, _ = runs.reports(spark, _report_tree(spark, sf_dir), "dbr_budget_report.json", REPORT)
    names = F.array_distinct(F.concat(F.map_keys("defect_rates_before"), F.map_keys("defect_rates_after"), F.map_keys("budgets"), F.map_keys("budget_violations")))
    rows = good.withColumn("defect_type", F.explode(names))
    of = {c: F.element_at(c, F.col("defect_type")) for c in ("defect_rates_before", "defect_rates_after", "budgets", "budget_violations")}
    violation = of["budget_violations"]
    return rows.select(
        "seed", "model_name", "branch", "generation", "defect_type", of["defect_rates_before"].alias("rate_before"), of["defect_rates_after"].alias("rate_after"),
        F.round(of["defect_rates_after"] - of["defect_rates_before"], 9).alias("delta"), of["budgets"].alias("budget"),
        F.coalesce(violation["actual_rate"], of["defect_rates_after"]).alias("actual_after"), (F.coalesce(violation["violation_count"], F.lit(0)) > 0).alias("violation"),
    )


def e19_budget_summary(spark, sf_dir):
    """What the reports of all seeds say of a context: means and spread, the union of the relaxations that any took, and of the defects that any exceeded."""
    good, _ = runs.reports(spark, _report_tree(spark, sf_dir), "dbr_budget_report.json", REPORT)

    def union(lists):
        return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))), "|")

    exceeded = F.map_keys(F.map_filter("budget_violations", lambda _, v: v["violation_count"] > 0))
    return good.groupBy("model_name", "branch", "generation").agg(
        F.count_distinct("seed").alias("n_seeds"), F.round(F.avg("target_size"), 9).alias("target_size_mean"), F.round(F.avg("selected_count"), 9).alias("selected_count_mean"),
        F.round(F.avg("selection_rate"), 9).alias("selection_rate_mean"), F.round(F.coalesce(F.stddev_samp("selection_rate"), F.lit(0.0)), 9).alias("selection_rate_std"),
        union(F.col("relaxation_steps_used")).alias("relaxation_steps_any"), union(exceeded).alias("violations_any"),
    )


#: Stages that a run must have completed, and those of a context that may be unfinished.
RUN_STAGES, OPEN_STAGES = ("data_prep", "aggregate", "plotting"), ("synthetic_build", "anchoring")


def _manifest_tree(spark, sf_dir):
    """Manifests of runs and contexts: judging has failed where a judgement is missing, and the run with the most orders has no manifest of its own."""
    root = runs.new_tree(spark)
    rows = bindings.responses(spark, sf_dir)
    status = lambda ok: F.struct(F.when(ok, "completed").otherwise("failed").alias("status"))
    judged = F.count_if(F.col("order_id") % 37 == 0) == 0
    stages = F.map_from_arrays(F.array(*map(F.lit, ("generation", "judging", "synthetic_build"))), F.array(status(F.lit(True)), status(judged), status(F.lit(False))))
    runs.save_tree(written(rows.groupBy(*CTX).agg(stages.alias("stages")).select(*_tree(), "stages"), "manifests"), root, "stage_manifest.json")
    seeds = rows.groupBy("seed").agg(F.count("*").alias("n"), F.count_if(F.col("branch") == ANCHORED).alias("a"))
    most = F.row_number().over(q.Window.orderBy(F.desc("n"), "seed")) == 1  # a row a seed
    stages = F.map_from_arrays(F.array(*map(F.lit, RUN_STAGES[:2])), F.array(status(F.lit(True)), status(F.col("a") * 4 > F.col("n"))))
    one = seeds.withColumn("_most", most).filter("NOT _most").select(F.concat(F.lit("run_seed"), "seed").alias("run"), F.lit("run_stage_manifest.json").alias("artifact"), stages.alias("stages"))
    one.write.mode("append").partitionBy("run", "artifact").json(root)
    return root


def h13_stage_findings(spark, sf_dir):
    """Findings on the stages of runs and contexts, whatever stages a manifest names; a run without a manifest is the gravest."""
    root = _manifest_tree(spark, sf_dir)
    fields = {"stages": ("map<string,struct<status:string>>", {})}
    contexts, _ = runs.reports(spark, root, "stage_manifest.json", fields)
    found = contexts.select("run", F.explode("stages").alias("stage", "v")).filter((F.col("v.status") != "completed") & ~F.col("stage").isin(*OPEN_STAGES))
    found = found.select("run", F.lit("HIGH").alias("severity"), F.concat(F.lit("Context stage "), "stage", F.lit(" status="), "v.status").alias("message"))
    path = F.regexp_extract(F.col("_metadata.file_path"), r".*/(?:[^/=]+=)?(run_[^/]*)/(?:[^/=]+=)?run_stage_manifest", 1)
    own = written(spark.read.schema("stages map<string,struct<status:string>>").option("recursiveFileLookup", True).json(f"{root}/*/*run_stage_manifest.json").select(path.alias("run"), "stages"), "manifests")
    wanted = own.select("run", F.explode(F.array(*map(F.lit, RUN_STAGES))).alias("stage"), "stages")
    said = F.coalesce(F.element_at("stages", F.col("stage"))["status"], F.lit("missing"))
    wanted = wanted.select("run", F.lit("HIGH").alias("severity"), F.concat(F.lit("Run stage "), "stage", F.lit(" status="), said).alias("message")).filter("NOT message LIKE '%=completed'")
    lost = contexts.select("run").distinct().join(own.select("run"), "run", "left_anti").select("run", F.lit("CRITICAL").alias("severity"), F.lit("Missing run_stage_manifest.json").alias("message"))
    return found.union(wanted).union(lost).groupBy("run", "severity", "message").agg(F.count("*").alias("n"))


def i16_hidden_key(spark, sf_dir):
    """The key of a blinded pair study, which is kept apart from what judges see."""
    return q._decoded(spark, sf_dir).select("pair_id", "pair_key", "seed", "branch_a", "branch_b")


def i16_manual_template(spark, sf_dir):
    """What a person who judges pairs by hand gets: both texts, no branch, and empty fields to fill in."""
    blank = F.lit("")
    rows = q._decoded(spark, sf_dir)
    return rows.select("pair_id", "response_a", "response_b", *[blank.alias(c) for c in ("manual_winner", "manual_confidence", "manual_comment")])


def m28_training_records(spark, sf_dir):
    """One record for each branch and step from a generation to the next: base, target and trained model, and where its rows are."""
    steps = bindings.responses(spark, sf_dir).groupBy("model_name", "branch", "generation").agg(F.count("*").alias("n_rows")).filter("generation < 2")
    target = text_rules.safe_name(F.concat_ws("-", "model_name", "branch", F.concat(F.lit("g"), F.col("generation") + 1)))
    stub = F.col("n_rows") < 20  # too few rows to train on
    return steps.select(
        "branch", F.col("generation").alias("generation_from"), (F.col("generation") + 1).alias("generation_to"), F.col("model_name").alias("base_model_name"), target.alias("target_model_name"),
        F.when(stub, F.col("model_name")).otherwise(target).alias("trained_model_name"), F.concat_ws("/", F.lit("train"), "model_name", "branch", F.concat(F.lit("gen_"), "generation"), F.lit("rows.parquet")).alias("training_data_path"), stub.alias("is_stub"), F.lit("training_feasibility").alias("evaluation_mode"),
    )


def _row_tree(spark, sf_dir):
    """Outputs of every context; judgements but for the anchored branch's last generation; held-out questions of every run."""
    root = runs.new_tree(spark)
    rows = bindings.responses(spark, sf_dir)
    outputs = rows.select(*_tree(), F.concat(F.lit("r"), "seed").alias("run_id"), "model_name", "branch", "generation", "example_id", "raw_response")
    runs.save_tree(outputs, root, "model_outputs.parquet")
    judged = bindings.judged(rows).join(rows.select("order_id", "example_id", *CTX), "order_id").filter(~((F.col("branch") == ANCHORED) & (F.col("generation") == 2)))
    judged = judged.select(*_tree(), "example_id", "overall_pedagogical_score", "is_silent_error", "clarity", "structure", F.lit("judge-a").alias("judge_model"), F.concat(F.lit("said "), "clarity").alias("comment"))
    runs.save_tree(judged, root, "judge_outputs.parquet")
    held = rows.select(_tree()[0], "example_id", "question", "answer_gold").withColumns({"kind": F.lit("splits"), "artifact": F.lit("heldout_test.parquet")})
    held.write.mode("append").partitionBy("run", "kind", "artifact").parquet(root)
    return root


def m05_presence(spark, sf_dir):
    """Which contexts of a tree have which artifacts."""
    return runs.presence(spark, _row_tree(spark, sf_dir), ["model_outputs.parquet", "judge_outputs.parquet"])


def m05_sensitivity_rows(spark, sf_dir):
    """Rows that a second judge is to score, of two branches' later generations: whole contexts only."""
    rows = runs.judged_rows(spark, _row_tree(spark, sf_dir), [PURE, ANCHORED], [1, 2], prefix="old_")
    return rows.select("run", "source_seed", "model_name", "branch", "generation", "example_id", F.length("question").alias("n_question"), "old_overall_pedagogical_score", "old_is_silent_error", "old_terminology", "old_judge_model")


def m06_pair_rows(spark, sf_dir):
    """Rows that pairs are made of, of one generation of two branches; judgements must bear the judge's name and comment."""
    rows = runs.judged_rows(spark, _row_tree(spark, sf_dir), [PURE, DBR], [1], needed=("comment", "judge_model"))
    return rows.select("source_seed", "model_name", "branch", "example_id", "overall_pedagogical_score", "is_silent_error", "comment", "judge_model", F.length("answer_gold").alias("n_gold"))


def h13_budget_checks(spark, sf_dir):
    """A selection that ranks three in five rows of each context by its hash, whatever their defects, replayed against the budgets."""
    rows = dbr.flagged(q._policy_rows(spark, sf_dir))
    place = F.row_number().over(q.Window.partitionBy(*CTX).orderBy("sampling_value", "example_id"))
    n = F.count("*").over(q.Window.partitionBy(*CTX))
    rank = F.when(place <= F.floor(n * 3 / 5), place)
    decided = rows.withColumn("selection_rank", rank).withColumn("phase", F.when(F.col("generation") == 2, 2).otherwise(0))
    return dbr.budget_checks(decided, CTX, dbr.Budgets(ratio=0.6))


def a21_dry_run(spark, sf_dir):
    """Outputs of a dry run: each held-out question in the order of its id, answered by its number."""
    rows = numbering.numbered(bindings.responses(spark, sf_dir).select("order_id", "example_id", "question"), ["order_id"], "idx")
    number = F.col("idx").cast("string")
    return rows.select("example_id", F.lit("dry_run").alias("run_id"), F.col("question").alias("prompt_text"), F.concat(F.lit("Final answer: "), number).alias("raw_response"), number.alias("parsed_final_answer"))


def h18_targets(spark, sf_dir):
    """The newest run folder of each family, where two of a family's runs were written one after another."""
    root = runs.new_tree(spark)
    rows = bindings.responses(spark, sf_dir).groupBy("seed", "branch").agg(F.count("*").alias("n"))
    for suffix in ("_old", "_new"):
        one = rows.withColumns({"folder": F.concat("branch", F.lit("_seed"), F.col("seed"), F.lit(suffix))})
        for seed in (211, 212, 213):
            one.filter(F.col("seed") == seed).coalesce(1).write.mode("append").json(f"{root}/soft_seed{seed}{suffix}")
    found = runs.latest_targets(spark, root, [f"soft_seed{seed}_*" for seed in (213, 211, 999)])
    return found.select("place", "pattern", "path")


def a04_processed_splits(spark, sf_dir):
    """Splits written with questions and gold answers, read again and checked to be disjoint."""
    place = f"{new_folder(spark, 'splits')}/splits"
    rows = bindings.responses(spark, sf_dir).select("example_id", "question", "answer_gold")
    q.g02_splits(spark, sf_dir).join(rows, "example_id").write.partitionBy("split").parquet(place)
    found = runs.processed_splits(spark, place, ["base_train", "anchor_pool", "heldout_test"], ["example_id", "question", "answer_gold"])
    return found.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("example_id").alias("n_ids"), F.sum(F.length("question")).alias("n_chars"))


def a08_sinks(spark, sf_dir):
    """A table through every sink and back: CSV, Parquet, JSON lines."""
    place = new_folder(spark, "sinks")
    rows = bindings.responses(spark, sf_dir).select("order_id", "branch", "generation", "answer_gold")
    sinks.save_tabular(rows.withColumn("answer_gold", F.replace("answer_gold", F.lit("\n"), F.lit(" "))), place)
    sinks.save_jsonl(rows, f"{place}/lines")
    parts = {"csv": spark.read.schema(rows.schema).option("header", True).csv(f"{place}/csv"), "parquet": spark.read.parquet(f"{place}/parquet"), "jsonl": spark.read.schema(rows.schema).json(f"{place}/lines")}
    out = None
    for name, df in parts.items():
        part = df.groupBy("branch").agg(F.count("*").alias("n_rows"), F.sum("order_id").alias("id_sum"), F.sum(F.length("answer_gold")).alias("n_chars")).select(F.lit(name).alias("format"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def d02_generations_with_questions(spark, sf_dir):
    """Generations joined one to one with their questions, a contract that the join checks itself."""
    rows = bindings.responses(spark, sf_dir)
    both = checks.checked_join(rows.select("order_id", "branch", "raw_response"), rows.select("order_id", "question"), ["order_id"], what="generations and questions")
    return both.groupBy("branch").agg(F.count("*").alias("n_rows"), F.sum(F.length("question") + F.length("raw_response")).alias("n_chars"))


def _soft_tree(spark, sf_dir):
    """Decisions of a soft policy and a report for each context; reports of generation 0 do not name their policy."""
    root = runs.new_tree(spark)
    decided = written(policies.soft_pvf(q._policy_rows(spark, sf_dir), "soft_pvf_medium").select(*CTX, "example_id", "kept", "assigned_weight", "decision_reason"), "decisions")
    runs.save_tree(decided.select(*_tree(), "example_id", "kept", "assigned_weight", "decision_reason"), root, "soft_pvf_decisions.parquet")
    reasons = decided.groupBy(*CTX, "decision_reason").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    entry = F.struct("decision_reason", "n")
    report = reasons.groupBy(*CTX).agg(F.sum("n").alias("total_candidates"), F.sum("k").alias("kept_count"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("decision_reason_counts"))
    policy = F.when(F.col("generation") > 0, "soft_pvf_medium")
    report = report.select(*_tree(), "model_name", "branch", "generation", policy.alias("policy_name"), "total_candidates", "kept_count", "decision_reason_counts")
    runs.save_tree(written(report, "reports"), root, "soft_pvf_report.json")
    return root


def m12_soft_reports(spark, sf_dir):
    """One row a report and reason; a report that does not name its policy is of the default one, one without a keep rate has rate 0."""
    fields = {
        "model_name": ("string", ""), "branch": ("string", ""), "generation": ("int", 0), "policy_name": ("string", "soft_pvf_default"), "keep_rate": ("double", 0.0),
        "kept_count": ("bigint", 0), "total_candidates": ("bigint", 0), "decision_reason_counts": ("map<string,bigint>", {}),
    }
    good, _ = runs.reports(spark, _soft_tree(spark, sf_dir), "soft_pvf_report.json", fields)
    return good.select("seed", "model_name", "branch", "generation", "policy_name", "keep_rate", "kept_count", "total_candidates", F.explode("decision_reason_counts").alias("reason", "n"))


def m13_soft_decisions(spark, sf_dir):
    """Decisions of all contexts of a tree, by the folders they lie in."""
    rows = runs.artifact(spark, _soft_tree(spark, sf_dir), "soft_pvf_decisions.parquet", ["example_id", "kept", "assigned_weight", "decision_reason"], {"notes": "string"})
    return rows.groupBy("run", "model_dir", "branch_dir", "generation_dir").agg(F.count("*").alias("n_rows"), F.count_if("kept").alias("n_kept"), F.round(F.sum("assigned_weight"), 6).alias("weight"), F.count("notes").alias("n_notes"))


def queries():
    return {name: f for name, f in globals().items() if re.match(r"[a-m]\d\d_", name)}


_C = "model_name, branch, generation, seed"
_RATES = ", ".join(f"'{n}': round(avg(defect_{n}::INT), 9)" for n in quality.DEFECTS)
_AFTER = ", ".join(f"'{n}': round(coalesce(avg(defect_{n}::INT) FILTER (NOT defect_parse_failure), 0), 9)" for n in quality.DEFECTS)
_LONG = " UNION ALL ".join(f"SELECT {_C}, '{n}' AS defect_type, round(avg(defect_{n}::INT), 9) AS rate_before, round(coalesce(avg(defect_{n}::INT) FILTER (NOT defect_parse_failure), 0), 9) AS rate_after, count(*) FILTER (NOT defect_parse_failure) AS k FROM sev GROUP BY {_C}" for n in quality.DEFECTS)
_TREE_RUN = "'run_seed' || seed"
_LIMITS = " UNION ALL ".join(
    f"SELECT {_C}, phase, '{n}' AS defect, CASE WHEN {relaxed} THEN greatest(floor({rate}::DOUBLE * t), all_{n}) ELSE floor({rate}::DOUBLE * t) END::BIGINT AS lim, reached_{n} AS reached, defect_{n} AS f FROM run"
    for n, rate, relaxed in (("parse_failure", "0.0", "FALSE"), ("silent_error", "0.1", "phase > 3"), ("incorrect_answer", "0.3", "phase > 2"), ("low_reasoning", "0.25", "phase > 1"), ("low_structure", "0.3", "phase > 0"))
)

SQL = {
    "a16_judge_cache": """, k AS (SELECT *, concat_ws('|', customer, question, answer_gold, raw_response) AS key FROM resp),
      s AS (SELECT key, max((branch <> 'anchor_20_append')::INT) AS filled, max((branch = 'dbr_medium' AND generation >= 1)::INT) AS damaged, max((branch = 'dbr_medium' AND generation = 2)::INT) AS again FROM k GROUP BY key),
      h AS (SELECT branch, generation, filled = 1 AND (damaged = 0 OR again = 1) AS hit, again = 1 AS repaired FROM k JOIN s USING (key))
      SELECT branch, generation, count(*) AS n_rows, count(*) FILTER (hit) AS n_hits, count(*) FILTER (NOT hit) AS n_misses, count(*) FILTER (repaired) AS n_repaired FROM h GROUP BY ALL""",
    "c15_committed_contexts": "SELECT branch, generation, count(*) AS n_rows, count(*) AS n_found, 'ok' AS status FROM resp WHERE branch <> 'dbr_medium' OR length(raw_response) > 12 GROUP BY ALL",
    "k02_judged_batches": """, i AS (SELECT order_id, generation, customer || '|' || answer_gold || '|' || raw_response AS x, sha256(customer || chr(10) || answer_gold || chr(10) || raw_response) AS h FROM resp),
      z AS (SELECT *, list_sum(list_transform(range(1, 65), lambda i: ('0x' || substr(h, i, 1))::INT)) AS d, ('0x' || substr(h, 63, 2))::INT AS low FROM i),
      y AS (SELECT *, d % 3 + (d - low % 4 + 255) % 3 + (d - low % 16 + 255) % 3 + (d - low % 64 + 255) % 3 <= 1 AS failed FROM z),
      f AS (SELECT x, failed, min(generation) AS first FROM y GROUP BY ALL),
      t AS (SELECT generation AS batch, count(DISTINCT x) FILTER (failed OR generation = first) AS n_scored, count(DISTINCT x) FILTER (failed) AS n_failed_inputs,
        count(*) FILTER (NOT failed) AS n_done, count(*) FILTER (failed) AS n_open FROM y JOIN f USING (x, failed) GROUP BY 1)
      SELECT * FROM t""",
    "m10_dbr_reports": f"SELECT {_TREE_RUN} AS run, seed, model_name, branch, generation, count(*) AS target_size, count(*) FILTER (NOT defect_parse_failure) AS selected_count, CASE WHEN generation > 0 THEN round(count(*) FILTER (NOT defect_parse_failure) / count(*), 9) ELSE 0 END AS selection_rate, 0.0::DOUBLE AS min_selection_rate, CASE WHEN generation > 0 THEN 2 ELSE 0 END AS n_budgets, CASE WHEN generation = 2 THEN 'relax_low_structure' ELSE '' END AS relaxation_steps_used FROM sev GROUP BY {_C}",
    "m10_quarantine": f"SELECT run, count(*) AS n_good, 0::BIGINT AS n_damaged FROM (SELECT DISTINCT {_TREE_RUN} AS run, {_C} FROM resp) GROUP BY run UNION ALL SELECT 'run_seed9', 0, 1",
    "e19_budget_summary": f""", g AS (SELECT {_C}, count(*) AS t, count(*) FILTER (NOT defect_parse_failure) AS k, CASE WHEN generation > 0 THEN round(count(*) FILTER (NOT defect_parse_failure) / count(*), 9) ELSE 0 END AS r FROM sev GROUP BY {_C})
      SELECT model_name, branch, generation, count(DISTINCT seed) AS n_seeds, round(avg(t), 9) AS target_size_mean, round(avg(k), 9) AS selected_count_mean, round(avg(r), 9) AS selection_rate_mean, round(coalesce(stddev_samp(r), 0), 9) AS selection_rate_std,
        CASE WHEN generation = 2 THEN 'relax_low_structure' ELSE '' END AS relaxation_steps_any, CASE WHEN generation > 0 AND max(k) > 0 THEN 'silent_error' ELSE '' END AS violations_any FROM g GROUP BY 1, 2, 3""",
    "h13_stage_findings": f""", c AS (SELECT {_C}, count(*) FILTER (order_id % 37 = 0) > 0 AS bad FROM resp GROUP BY ALL),
      s AS (SELECT seed, count(*) AS n, count(*) FILTER (branch = 'anchor_20_append') AS a, row_number() OVER (ORDER BY count(*) DESC, seed) = 1 AS lost FROM resp GROUP BY seed)
      SELECT {_TREE_RUN} AS run, 'HIGH' AS severity, 'Context stage judging status=failed' AS message, count(*) AS n FROM c WHERE bad GROUP BY seed
      UNION ALL SELECT {_TREE_RUN}, 'HIGH', 'Run stage plotting status=missing', 1 FROM s WHERE NOT lost
      UNION ALL SELECT {_TREE_RUN}, 'HIGH', 'Run stage aggregate status=failed', 1 FROM s WHERE NOT lost AND a * 4 <= n
      UNION ALL SELECT {_TREE_RUN}, 'CRITICAL', 'Missing run_stage_manifest.json', 1 FROM s WHERE lost""",
    "i16_hidden_key": "{pairs} SELECT pair_id, pair_key, seed, branch_a, branch_b FROM psc",
    "i16_manual_template": "{pairs} SELECT pair_id, CASE WHEN coin THEN pure_response ELSE dbr_response END AS response_a, CASE WHEN coin THEN dbr_response ELSE pure_response END AS response_b, '' AS manual_winner, '' AS manual_confidence, '' AS manual_comment FROM psc",
    "m28_training_records": """, g AS (SELECT model_name, branch, generation, count(*) AS n, regexp_replace(model_name || '-' || branch || '-g' || (generation + 1), '[^A-Za-z0-9._:-]', '_', 'g') AS target FROM resp WHERE generation < 2 GROUP BY ALL)
      SELECT branch, generation AS generation_from, (generation + 1)::INT AS generation_to, model_name AS base_model_name, target AS target_model_name, CASE WHEN n < 20 THEN model_name ELSE target END AS trained_model_name, 'train/' || model_name || '/' || branch || '/gen_' || generation || '/rows.parquet' AS training_data_path, n < 20 AS is_stub, 'training_feasibility' AS evaluation_mode FROM g""",
    "m19_policy_tables": f""", l AS ({_LONG})
      SELECT seed, model_name, branch, generation, defect_type, rate_before, rate_after, round(rate_after - rate_before, 9) AS delta, CASE WHEN generation > 0 THEN CASE defect_type WHEN 'silent_error' THEN 0.1 WHEN 'incorrect_answer' THEN 0.3 END END::DOUBLE AS budget, rate_after AS actual_after,
        generation > 0 AND defect_type = 'silent_error' AND k > 0 AS violation FROM l""",
    "m05_presence": f"SELECT DISTINCT {_TREE_RUN} AS run, model_name AS model_dir, branch AS branch_dir, generation AS generation_dir, TRUE AS has_model_outputs, j > 0 AS has_judge_outputs, CASE WHEN j > 0 THEN 'whole' ELSE 'skipped' END AS status FROM (SELECT {_C}, count(*) FILTER (order_id % 37 <> 0 AND NOT (branch = 'anchor_20_append' AND generation = 2)) AS j FROM resp GROUP BY ALL)",
    "m05_sensitivity_rows": f"SELECT {_TREE_RUN} AS run, seed AS source_seed, model_name, branch, generation, example_id, length(question) AS n_question, overall_pedagogical_score AS old_overall_pedagogical_score, is_silent_error AS old_is_silent_error, NULL::INT AS old_terminology, CASE WHEN has_judge THEN 'judge-a' END AS old_judge_model FROM part_ev WHERE generation IN (1, 2) AND (branch = 'pure_recycling' OR branch = 'anchor_20_append' AND generation = 1)",
    "m06_pair_rows": "SELECT seed AS source_seed, model_name, branch, example_id, overall_pedagogical_score, is_silent_error, CASE WHEN has_judge THEN 'said ' || clarity END AS comment, CASE WHEN has_judge THEN 'judge-a' END AS judge_model, length(answer_gold) AS n_gold FROM part_ev WHERE generation = 1 AND branch IN ('pure_recycling', 'dbr_medium')",
    "h13_budget_checks": f""", a AS (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY dbr_score, example_id) AS k, count(*) OVER (PARTITION BY {_C}) AS n, CASE WHEN generation = 2 THEN 2 ELSE 0 END AS phase,
        {", ".join(f"sum(defect_{n}::INT) OVER (PARTITION BY {_C}) AS all_{n}" for n in quality.DEFECTS)} FROM sev),
      run AS (SELECT *, least(greatest(round_even(n * 0.6::DOUBLE, 0)::BIGINT, 1), n) AS t, {", ".join(f"sum(defect_{n}::INT) OVER (PARTITION BY {_C} ORDER BY k) AS reached_{n}" for n in quality.DEFECTS)} FROM a WHERE k <= floor(n * 3 / 5)),
      c AS ({_LIMITS})
      SELECT {_C}, phase, defect, max(lim) AS "limit", max(reached)::BIGINT AS reached, count(*) FILTER (f AND reached > lim) AS n_beyond, CASE WHEN count(*) FILTER (f AND reached > lim) > 0 THEN 'violation' ELSE 'ok' END AS status FROM c GROUP BY {_C}, phase, defect""",
    "a21_dry_run": "SELECT example_id, 'dry_run' AS run_id, question AS prompt_text, 'Final answer: ' || k AS raw_response, k::VARCHAR AS parsed_final_answer FROM (SELECT example_id, question, row_number() OVER (ORDER BY order_id) - 1 AS k FROM resp)",
    "a04_processed_splits": """, s AS (SELECT *, row_number() OVER (ORDER BY sha256('split-42|' || example_id), example_id) AS k FROM resp)
      SELECT CASE WHEN k <= 500 THEN 'base_train' WHEN k <= 800 THEN 'anchor_pool' ELSE 'heldout_test' END AS split, count(*) AS n_rows, count(DISTINCT example_id) AS n_ids, sum(length(question))::BIGINT AS n_chars FROM s WHERE k <= 1000 GROUP BY 1""",
    "a08_sinks": "SELECT format, branch, count(*) AS n_rows, sum(order_id)::BIGINT AS id_sum, sum(length(answer_gold))::BIGINT AS n_chars FROM resp CROSS JOIN (VALUES ('csv'), ('parquet'), ('jsonl')) AS f(format) GROUP BY ALL",
    "d02_generations_with_questions": "SELECT branch, count(*) AS n_rows, sum(length(question) + length(raw_response))::BIGINT AS n_chars FROM resp GROUP BY branch",
    "m12_soft_reports": f""", s AS (SELECT {', '.join('r.' + c for c in _C.split(', '))}, s.kept, s.decision_reason FROM soft AS s JOIN resp AS r USING (order_id) WHERE policy_name = 'soft_pvf_medium'),
      t AS (SELECT {_C}, count(*) AS total_candidates, count(*) FILTER (kept) AS kept_count FROM s GROUP BY ALL)
      SELECT seed, model_name, branch, generation, CASE WHEN generation > 0 THEN 'soft_pvf_medium' ELSE 'soft_pvf_default' END AS policy_name, 0.0::DOUBLE AS keep_rate, kept_count, total_candidates, reason, n
      FROM t JOIN (SELECT {_C}, decision_reason AS reason, count(*) AS n FROM s GROUP BY ALL) USING ({_C})""",
    "m13_soft_decisions": f"SELECT 'run_seed' || r.seed AS run, r.model_name AS model_dir, r.branch AS branch_dir, r.generation AS generation_dir, count(*) AS n_rows, count(*) FILTER (kept) AS n_kept, round(sum(assigned_weight), 6) AS weight, 0::BIGINT AS n_notes FROM soft AS s JOIN resp AS r USING (order_id) WHERE policy_name = 'soft_pvf_medium' GROUP BY 1, 2, 3, 4",
    "h18_targets": "SELECT place::INT AS place, 'soft_seed' || seed || '_*' AS pattern, 'soft_seed' || seed || '_new' AS path FROM (SELECT DISTINCT seed FROM resp) JOIN (VALUES (0, 213), (1, 211)) AS w(place, s) ON w.s = seed",
}


def oracle_sql():
    pairs = judging.PAIR_SQL.replace("{a}", judging._score_sql("ha")).replace("{b}", judging._score_sql("hb"))
    return {name: oracles.BASE + sql.replace("{pairs}", pairs) for name, sql in SQL.items()}
