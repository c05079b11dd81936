"""Mixing sources to target weights, by blocks of fixed length.

Each source's words are laid end to end and cut into blocks.  Output shards draw multinomial counts of blocks from
the sources (of very many sources: of groups, then of the sources in a group); each source's slots run through pseudorandom permutations of its block numbers, one permutation a
pass; slots and blocks meet by number.  A source's target is met to the word: the last slot is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.llm.common import WORD, null_safe_join, running, small, written


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code point order, null last, repeating.  share: percent of all words that the mix takes.
    passes: how often a source is taken at most.  block: words of a block; shard: words of an output shard, about."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    passes: int = 2
    block: int = 1_024
    shard: int = 1 << 20
    seed: int = 11
    #: Sources that are drawn from at once: with more than this, groups are drawn first, then sources in a group.
    sources: int = 4_096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(sid, source, source_size, docs, weight, target) of sizes (source, size): one row a source, sid by code point, null last.

    The total is shared by weight; a target stops at mix.passes times its source's size, and the excess is shared
    again.  With sources in the order of cap / weight, the capped ones come first, so running sums find where the
    capping ends: at the first source whose share of what is left is within its cap, which has the highest share.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_source = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weights = F.array(*[F.lit(w) for w in mix.weights])
    by_source = by_source.withColumn("weight", F.get(weights, F.pmod("sid", F.lit(len(mix.weights))).cast("int")))
    by_source = by_source.withColumn("cap", F.col("source_size") * mix.passes).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "sid")
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(mix.percent) / F.lit(100.0)
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by_source = by_source.withColumn("level", (total - before) / rest)
    stop = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(stop * F.col("weight"), F.col("cap").cast("double")))
    return by_source.select("sid", "source", "source_size", "docs", "weight", target.alias("target"))


def permuted(at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each `at` in a pseudorandom permutation of 0 to size - 1 that belongs to key.

    Four Feistel rounds over the next even number of bits; what falls outside goes through again until it
    falls inside, which keeps it a permutation.  Every `at` must lie within its size.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    size, key, x = size.astype(np.uint64), key.astype(np.uint64), at.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, v, k = half[todo], low[todo], x[todo], key[todo]
        left, right = v >> h, v & m
        for step in range(4):
            f = (right + k + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def _permuted_column(at: Column, size: Column, key: Column) -> Column:
    @F.pandas_udf("long")
    def run(at: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(at.to_numpy(), size.to_numpy(), key.to_numpy()))

    # Not deterministic in name only: else the join's test for nulls is pushed below it, and each place is computed twice.
    return run.asNondeterministic()(at, size, key)


#: Rows of a bucket of a source, about.
BUCKET_ROWS = 128


def laid_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, size, sid, source_size, target, start): where each document's words begin in its source.

    Documents go by a hash of doc_id.  Running sums are taken in hash buckets of a source, as many as it has rows for,
    then over its buckets, so that a large source is spread over tasks.
    """
    rows = null_safe_join(sizes, small(sources), ["source"])
    bucket = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("docs") / BUCKET_ROWS)).alias("bucket")
    rows = rows.select("doc_id", "size", "sid", "source_size", "target", bucket)
    place = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = written(rows.withColumn("start", F.sum("size").over(place) - F.col("size")), "rows")
    sums = running(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), ["sid"], "bucket", "n")
    sums = written(sums.select("sid", "bucket", "before"), "sums")
    return rows.join(small(sums), ["sid", "bucket"]).select("doc_id", "size", "sid", "source_size", "target", (F.col("before") + F.col("start")).alias("start"))


def _plan(sources: DataFrame, mix: Mix) -> DataFrame:
    """sources with words with the words to take, blocks, slots, and `each`, the slots of a pass."""
    plan = sources.filter("source_size > 0").select("sid", "source_size", F.round("target").cast("long").alias("take"))
    plan = plan.withColumn("full", F.expr(f"source_size div {mix.block}")).withColumn("each", F.col("full") + (F.col("source_size") % mix.block > 0).cast("int"))
    plan = plan.withColumn("rest", F.expr("take % source_size"))
    part = F.least(F.expr(f"(rest + {mix.block - 1}) div {mix.block}"), F.col("each"))
    return plan.withColumn("slots", F.expr("take div source_size") * F.col("each") + part).filter("slots > 0")


def draws(plan: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """(shard, sid, n): multinomial counts of slots of each source for each output shard, none of 0, and the number of shards.

    The driver holds the number of slots of each group of sources.  A group is one source, as long as there are
    mix.sources at most; with S sources, there are about as many groups as sources in a group, the root of S.
    """
    spark = plan.sparkSession
    n, words = plan.agg(F.count("*"), F.coalesce(F.sum("take"), F.lit(0))).first()
    width = 1 if n <= mix.sources else max(mix.sources, int(np.ceil(np.sqrt(n))))
    groups = plan.groupBy(F.expr(f"sid div {width}").alias("group")).agg(F.sum("slots").alias("slots")).orderBy("group").toPandas()
    total, shards, seed = int(groups["slots"].sum()), max(1, -(-words // mix.shard)), mix.seed
    names, chances, each = groups["group"].to_numpy(np.int64), groups["slots"].to_numpy(np.float64) / max(1, total), -(-total // shards)

    def some(counts: np.ndarray, of: np.ndarray, shard: int) -> pd.DataFrame:
        drawn = np.flatnonzero(counts)
        return pd.DataFrame({"shard": shard, "sid": of[drawn], "n": counts[drawn]})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                if len(chances):
                    yield some(np.random.default_rng([seed, shard]).multinomial(each, chances), names, shard)

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, group, n, of, slots in batch[["shard", "group", "n", "of", "slots"]].itertuples(index=False):
                odds = np.asarray(slots, np.float64)
                yield some(np.random.default_rng([seed, shard, group]).multinomial(n, odds / odds.sum()), np.asarray(of), shard)

    drawn = spark.range(shards).mapInPandas(first, "shard long, sid long, n long")
    if width > 1:
        listed = F.sort_array(F.collect_list(F.struct("sid", "slots")))
        inside = plan.groupBy(F.expr(f"sid div {width}").alias("group")).agg(listed.alias("all"))
        inside = inside.select("group", F.col("all.sid").alias("of"), F.col("all.slots").alias("slots"))
        drawn = drawn.withColumnRenamed("sid", "group").join(inside, "group").mapInPandas(second, "shard long, sid long, n long")
    return drawn, shards


def slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """(shard, slot, sid, block, words): the blocks that each output shard takes, and how many words of each.

    A pass over a source takes its full blocks in a permuted order and then its short last block.  Draws differ from the
    plan by chance; the last shard settles what is left, so that each source meets its target.
    """
    plan = written(_plan(sources, mix), "plan")
    drawn, shards = draws(plan, mix)
    # A last row for each source, so that what is left finds a shard even where none was drawn for it.
    drawn = drawn.unionByName(plan.select(F.lit(shards).cast("long").alias("shard"), "sid", F.lit(0).cast("long").alias("n")))
    drawn = running(written(drawn, "draws"), ["sid"], "shard", "n").join(small(plan), "sid")
    end = F.when(F.col("shard") == shards, F.col("slots")).otherwise(F.least(F.col("before") + F.col("n"), F.col("slots")))
    drawn = drawn.withColumn("from", F.least("before", "slots")).withColumn("to", end).filter("`from` < `to`").withColumn("shard", F.least("shard", F.lit(shards - 1)))
    out = drawn.withColumn("slot", F.explode(F.sequence(F.col("from"), F.col("to") - 1)))
    out = out.withColumn("pass", F.expr("slot div each")).withColumn("at", F.expr("slot % each"))
    key = F.xxhash64(F.lit(mix.seed), "sid", "pass")
    inside = F.greatest(F.least("at", F.col("full") - 1), F.lit(0))  # the short last block is not permuted
    block = F.when(F.col("at") < F.col("full"), _permuted_column(inside, F.greatest(F.col("full"), F.lit(1)), key)).otherwise(F.col("full"))
    # Words of a slot: a block, or what is left of the source, or, in the last pass, of its target.
    before = F.col("at") * mix.block
    left = F.when(F.col("pass") == F.expr("take div source_size"), F.col("rest")).otherwise(F.col("source_size")) - before
    words_of = F.least(F.lit(mix.block).cast("long"), F.col("source_size") - before, left)
    return out.select("shard", "slot", "sid", block.alias("block"), words_of.alias("words"))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """(doc_id, sid, start, block, from, to): the part of each block that a document fills, counted in the block."""
    some = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    base = F.col("block") * block
    return some.select("doc_id", "sid", "start", "block", F.greatest(F.col("start") - base, F.lit(0)).alias("from"), F.least(F.col("start") + F.col("size") - base, F.lit(block)).alias("to"))


def mixture(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """What each output shard holds: (shard, slot, sid, block, doc_id, start, from, to), to being cut where a slot is."""
    taken = slots(sources, mix).join(pieces(rows, mix.block), ["sid", "block"]).filter("`from` < words")
    return taken.select("shard", "slot", "sid", "block", "doc_id", "start", "from", F.least("to", "words").alias("to"))


def _mixed(docs: DataFrame, mix: Mix, doc: str, text: str, source: str) -> DataFrame:
    """What mixed() returns, with the number of the source, sid."""
    sizes = written(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    sources = written(targets(sizes, mix), "sources")
    rows = written(laid_out(sizes, sources), "laid")
    taken = mixture(rows, sources, mix).groupBy("sid", "start").agg(F.sum(F.col("to") - F.col("from")).alias("words"))
    taken = taken.select(F.col("sid").alias("_sid"), F.col("start").alias("_start"), "words")
    out = rows.join(taken, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "sid", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix(), doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs: how many of its words the mix takes.

    size counts words, 0 for a null or empty text; such rows are taken 0 times.  A null source is a source of its
    own and sorts last.  Rows that share a doc_id are documents of their own.  Reruns give the same rows.
    An empty table, and one without words, give targets and counts of 0.
    """
    return _mixed(docs, mix, doc, text, source).drop("sid")


def _settled(rows: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, sid, size, taken, low, times) with the times of some documents one more or one less.

    Times are rounded document by document, which long documents of a source do all alike.  A source whose words then
    differ from those taken by more than its longest document is settled: of its documents rounded the other way,
    so many are changed, by a hash of doc_id, that it differs by half a document at most.  Running sums are taken in
    hash buckets of a source, then over its buckets.
    """
    gap = F.sum(F.col("taken") - F.col("times") * F.col("size"))
    gaps = rows.groupBy("sid").agg(gap.alias("gap"), F.max("size").alias("longest")).filter("abs(gap) > longest").select("sid", "gap")
    gaps = written(gaps, "gaps")
    buckets = max(1, min(1 << 16, rows.count() // 2_000))
    some = rows.join(small(gaps), "sid").filter("IF(gap > 0, times = low AND taken > low * size, times > low)")
    some = some.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    place = Window.partitionBy("sid", "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = written(some.select("doc_id", "sid", "bucket", "size", "gap", (F.sum("size").over(place) - F.col("size")).alias("start")), "settling")
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sums = written(some.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", before.alias("before")), "sums")
    chosen = some.join(small(sums), ["sid", "bucket"]).filter("2 * (before + start) + size <= 2 * abs(gap)")
    chosen = written(chosen.select("doc_id", F.signum("gap").cast("int").alias("change")), "changes")
    return rows.join(small(chosen), "doc_id", "left").withColumn("times", F.col("times") + F.coalesce("change", F.lit(0))).drop("change")


def resampled(docs: DataFrame, mix: Mix = Mix(), doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as the mix takes them, in whole documents: each stands as often as the mix takes its words, rounded.

    A row is left out where the mix takes under half of its words, and stands twice from one and a half times on, but
    for those that _settled() changes: the words of each source meet its target to its longest document.
    Rows without a doc_id stand once.  Rows that share one stand alike, and count for the first of their sources.
    """
    rows = _mixed(docs, mix, doc, text, source).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sid").alias("sid"), F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    share = F.coalesce(F.try_divide("taken", "size"), F.lit(0.0))
    rows = written(rows.withColumns({"low": F.floor(share).cast("int"), "times": F.floor(share + 0.5).cast("int")}), "rounded")
    times = written(_settled(rows, mix.seed).select(F.col("doc_id").alias("_doc"), F.col("times").alias("_times")), "times").filter("_times <> 1")
    out = docs.join(small(times), F.col(doc) == F.col("_doc"), "left")
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("_times", F.lit(1))))).drop("_doc", "_times", "_copy")
