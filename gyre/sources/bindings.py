"""Question, answer and judgement tables, derived from the orders table by fixed arithmetic.

The data folder has no model responses, so each order stands for one response of a model in a context
(model, branch, generation, seed).  Only whole numbers and text are used, so that any SQL engine derives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.functions import answers, hashing
from gyre.functions.binding import bound
from gyre.operators.policies import JUDGEMENT
from gyre.sources.shared import null_safe_join, written
from gyre.sources.tables import dealt, table

CONTEXT = ["model_name", "branch", "generation", "seed"]
#: What answers and judgements are functions of.
INPUTS = ["question", "answer_gold", "raw_response"]
#: Bytes of distinct inputs, with what is derived from them, that may be broadcast at most.
INPUT_BYTES = 64 << 20

RESPONSES = (
    "Reasoning.\nFinal answer: 42",
    "We get \\boxed{42}.",
    "Steps\nAnswer: 3/4\nThanks for reading",
    "The answer is 3.50",
    "so we have 42.0",
    "Final answer: 41\nActually, Final answer: 42",
    "The total is 1,234",
    "   ",
    "I cannot tell",
    "Work\n\nFinal Answer - (0.75).",
)
GOLDS = ("We add 16 and 26. #### 42", "42", "3/4", "unknown", "half of seven\n#### 3.50")


def _pick(values: tuple[str, ...], at: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def responses(spark: SparkSession, sf_dir: str, shared_ids: bool = False) -> DataFrame:
    """One row a response.  With shared_ids, example_id is the customer's, the same in all contexts: the first order counts."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    key = F.col("o_orderkey")
    rows = orders.select(
        key.alias("order_id"),
        (F.concat(F.lit("cust_"), F.col("o_custkey")) if shared_ids else F.concat(F.lit("ord_"), key)).alias("example_id"),
        F.concat(F.lit("cust_"), F.col("o_custkey")).alias("customer"),
        F.concat(F.lit("model_"), F.col("o_custkey") % 2).alias("model_name"),
        F.when(F.col("o_orderstatus") == "F", "pure_recycling").when(F.col("o_orderstatus") == "O", "dbr_medium").otherwise("anchor_20_append").alias("branch"),
        (F.expr("o_orderkey div 7") % 3).cast("int").alias("generation"),
        (F.col("o_custkey") % 3 + 211).cast("int").alias("seed"),
        F.repeat(F.concat("o_orderpriority", F.lit(" ")), (key % 25).cast("int")).alias("question"),
        _pick(GOLDS, key % len(GOLDS)).alias("answer_gold"),
        _pick(RESPONSES, F.expr("o_orderkey div 5") % len(RESPONSES)).alias("raw_response"),
    )
    return first_of_customer(rows) if shared_ids else rows


def first_of_customer(rows: DataFrame) -> DataFrame:
    """The first order of each example_id, which is the customer's, in a context."""
    first = F.row_number().over(Window.partitionBy(*CONTEXT, "example_id").orderBy("order_id"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def accuracy(rows: DataFrame) -> DataFrame:
    """rows with the extracted and the gold answer and their comparison."""
    rows = bound(rows, _e=answers.extract(F.col("raw_response")), normalized_gold=answers.gold_token(F.col("answer_gold")))
    rows = rows.select("*", F.col("_e.answer").alias("extracted_answer"), F.col("_e.token").alias("normalized_predicted"), F.col("_e.ok").alias("pred_parse_success"), F.col("_e.strategy").alias("pred_parse_strategy"), F.col("_e.failure").alias("pred_parse_failure_reason")).drop("_e")
    rows = bound(rows, accuracy_label=answers.label(F.col("normalized_predicted"), F.col("normalized_gold")))
    return rows.withColumn("is_correct", F.col("accuracy_label") == "correct")


def judged(rows: DataFrame) -> DataFrame:
    """(order_id and rubric columns); every 37th order has no judgement."""
    verdict = hashing.mock_judgement(F.col("question"), F.col("answer_gold"), F.col("raw_response"))
    return bound(rows.filter("order_id % 37 <> 0"), _j=verdict).select("order_id", "_j.*")


def evaluated(spark: SparkSession, sf_dir: str, shared_ids: bool = False, keep_missing: bool = False) -> DataFrame:
    """Responses with accuracy and judgement; rows without a judgement only if keep_missing.

    Both are functions of the INPUTS, so they are derived for each distinct input, and blanked where a judgement is missing.
    """
    source = responses(spark, sf_dir)
    rows = derived_once(responses(spark, sf_dir, True) if shared_ids else source, source, INPUTS, values)
    has = F.col("order_id") % 37 != 0
    rows = rows.withColumns({c: F.when(has, F.col(c)) for c in JUDGEMENT} | {"has_judge": has})
    return rows if keep_missing else rows.filter("has_judge")


def values(rows: DataFrame) -> DataFrame:
    """rows with accuracy and judgement of their INPUTS."""
    return bound(accuracy(rows), _j=hashing.mock_judgement(*map(F.col, INPUTS))).select("*", "_j.*").drop("_j")


def derived_once(rows: DataFrame, source: DataFrame, keys: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """derive(rows), whose new columns are functions of the texts in `keys`: derived for each distinct text of source and joined to the rows.

    source has all texts of rows.  Sketches of one pass tell how many differ; if they might not fit INPUT_BYTES, each row derives its own, in place.
    """
    size = F.max(sum((F.coalesce(F.octet_length(k), F.lit(0)) for k in keys), F.lit(256)))
    told = source.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n"), size.alias("size")).first()
    if told["n"] * (told["size"] or 0) > INPUT_BYTES:
        return derive(rows)
    texts = written(source.select(*keys).distinct(), "texts")
    return null_safe_join(rows, F.broadcast(written(derive(texts.repartition(rows.sparkSession.sparkContext.defaultParallelism)), "values")), keys)
