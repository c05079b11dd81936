"""The corpus pipeline: quality rules, language, near-duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the
columns of their input.  run() writes each stage's result to the shared folder and reads it again; when its rows are
used, gyre.llm.common.cleared(spark) removes what the run has written.

Every stage takes nulls in any column, texts of any length and repeated rows, and gives no rows for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm import bpe, langid, mixing, neardup, quality
from gyre.llm.common import written
from gyre.llm.queries import BPE_RANKS
from gyre.sources.tables import table

#: Texts that even the best language model codes in more bits a byte than this are of no language it knows.
FOREIGN_BITS = 7.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the full policy rejects.  Null and empty texts have too few words and go."""
    return quality.ledger(docs).filter(quality.passes(quality.FULL)).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, and those that no learnt language can code, go.

    Languages are learnt from the documents with a lang.  A null lang becomes the predicted one.
    """
    model = langid.fit(docs, F.lit(True))
    out = langid.predicted(docs, model)
    if model is not None:
        out = out.filter(f"lang_pred <> 'und' AND bits_per_byte <= {FOREIGN_BITS}").withColumn("lang", F.coalesce("lang", "lang_pred"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that is linked by a likeness of 0.8 or more."""
    return neardup.deduplicated(docs, neardup.NEAR_80).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them: not at all, once or twice.

    A null source is a source of its own.  Rows without a doc_id stand once; rows that share one stand alike.
    """
    return mixing.resampled(docs).select(*docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the token ids of each document, with their number and whether they decode to the text.

    A null text counts as empty and has no ids.  Documents that stand twice in docs stand twice in the result.
    """
    out = bpe.with_ids(docs, BPE_RANKS, public_tokenizers.PATTERN, decoded="decoded")
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: Language models, signatures and permutations are not for SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
