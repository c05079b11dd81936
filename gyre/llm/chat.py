"""Chat formatting by perspective rotation: each participant in turn is the assistant.

Only DataFrame expressions.  A conversation of at most `window` turns is one row of each perspective.  A longer one is cut
into chunks of `window` turns, so that no task holds an unbounded group; a chunk opens with the system turns in force and
the last turns before it, which are shown and not learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.llm.common import few, null_safe_join, running, small, written

WINDOW = 64
#: Turns before a chunk that it repeats, and system turns at most.
CONTEXT, SYSTEMS = 8, 8
#: Ways in which the chunks of one conversation are spread where they meet its speakers by a shuffle.
SALTS = 16
#: The part of turns without a number: before all others.
FIRST = -(1 << 62)


def perspectives(turns: DataFrame, window: int = WINDOW, context: int = CONTEXT, systems: int = SYSTEMS, system: str = "system", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation, chunk and participant: the dialogue with that speaker as assistant.

    Columns: conv_id, chunk (from 0), perspective, text, spans (array of start and end, in characters of text, of what
    the model is to learn: the assistant's words and their end mark), n_turns and n_target_turns (of the chunk itself).

    A participant is a role other than `system` that speaks anywhere in the conversation; a null role is
    `unknown`.  System turns are never learnt.  Others are named users.  A null text is empty.  Turns go by (turn, role,
    text), nulls first; repeated rows all stay.  A null conv_id is a conversation of its own.  Marks inside a text are
    broken up, so that no text can forge a turn.

    Chunk n holds the turns n * window to (n + 1) * window - 1 in that order.  From chunk 1 on, its text opens with the
    last `context` turns before it, and before these with the system turns in force: the last `systems` ones of the nearest
    earlier chunk that has any, but for those among the `context` turns.  Other columns are ignored; an empty table gives no rows.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|", "< |").alias("text"),
    )
    long = written(said.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > window), "long")
    if long.isEmpty():
        return _short(said, system)
    known = small(long.select(F.col("conv_id").alias("_conv"), "n"))
    rest = said.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti")
    rows = said.join(known, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return _short(rest, system).union(_long(rows, window, context, systems, system))


def _short(said: DataFrame, system: str) -> DataFrame:
    """Conversations that are one chunk: their turns are gathered once, and the speakers found among them."""
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", F.lit(True).alias("own")))).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda name: name != system))
    return _rendered(whole.select("conv_id", F.lit(0).cast("long").alias("chunk"), F.explode(speakers).alias("perspective"), "turns"), system)


def _long(rows: DataFrame, window: int, context: int, systems: int, system: str) -> DataFrame:
    """Conversations (with their number n of turns) of several chunks.

    Turns are numbered without gathering a conversation: within ranges of turn numbers, and on from the counts of the ranges.
    """
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / window), F.lit(FIRST)).cast("long"))
    counts = running(rows.groupBy("conv_id", "part").agg(F.count("*").alias("_n")), ["conv_id"], "part", "_n").drop("_n")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text"))
    rows = null_safe_join(rows, small(written(counts, "parts")), ["conv_id", "part"]).withColumn("at", F.col("before") + place - 1)
    chunk = F.floor(F.col("at") / window)
    own = F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))
    on = (F.col("at") % window >= window - context) & ((chunk + 1) * window < F.col("n"))
    rows = rows.withColumn("_to", F.explode(F.when(on, F.array(own, F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own")))).otherwise(F.array(own))))
    units = rows.groupBy("conv_id", F.col("_to.chunk").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", F.col("_to.own").alias("own")))).alias("turns"))
    units = written(units, "units")
    named = F.filter("turns", lambda t: t["own"] & (t["role"] == system))
    named = F.when(F.size(named) > 0, F.slice(named, F.greatest(F.lit(1), F.size(named) - systems + 1), systems))
    units = null_safe_join(units, _in_force(units.select("conv_id", "chunk", named.alias("named"))), ["conv_id", "chunk"])
    first = F.col("chunk") * window - context
    head = F.transform(F.filter(F.coalesce("force", F.array()), lambda t: t["at"] < first), lambda t: F.struct(t["at"], t["role"], t["text"], F.lit(False).alias("own")))
    units = units.select("conv_id", "chunk", F.concat(head, "turns").alias("turns"))
    speakers = written(rows.filter(F.col("role") != system).select("conv_id", F.col("role").alias("perspective")).distinct(), "speakers")
    if few(speakers, 100_000):
        both = null_safe_join(units, F.broadcast(speakers), ["conv_id"])
    else:
        spread = speakers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = null_safe_join(units.withColumn("salt", (F.col("chunk") % SALTS).cast("int")), spread, ["conv_id", "salt"])
    return _rendered(both, system)


def _in_force(named: DataFrame, width: int = 1_024) -> DataFrame:
    """(conv_id, chunk, force): `named` of the nearest earlier chunk where it is not null; first among `width` chunks, then among those."""
    block = F.expr(f"chunk div {width}")
    earlier = F.last("named", ignorenulls=True).over(Window.partitionBy("conv_id", "block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    rows = named.withColumn("block", block).withColumn("near", earlier)
    blocks = rows.groupBy("conv_id", "block").agg(F.max(F.when(F.col("named").isNotNull(), F.struct("chunk", "named")))["named"].alias("_last"))
    far = F.last("_last", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("conv_id", "block", far.alias("far"))
    return null_safe_join(rows, blocks, ["conv_id", "block"]).select("conv_id", "chunk", F.coalesce("near", "far").alias("force"))


def _rendered(both: DataFrame, system: str) -> DataFrame:
    """Rows (conv_id, chunk, perspective, turns) with their text and spans; turns that are not the chunk's own are not learnt."""

    def segment(x: Column) -> Column:
        speaks = x["role"] == F.col("perspective")
        head = F.when(speaks, F.lit("<|assistant|>\n")).when(x["role"] == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user "), F.regexp_replace(x["role"], r"[<|>\s]", "_"), F.lit("|>\n")))
        return F.struct(head.alias("head"), F.concat(x["text"], F.lit("<|end|>\n")).alias("body"), (speaks & x["own"]).alias("target"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        spans = F.when(x["target"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return both.withColumn("segments", F.transform("turns", segment)).select(
        "conv_id", "chunk", "perspective",
        F.array_join(F.transform("segments", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.aggregate("segments", zero, step)["spans"].alias("spans"),
        F.size(F.filter("turns", lambda x: x["own"])).cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda x: x["target"])).cast("long").alias("n_target_turns"),
    )
