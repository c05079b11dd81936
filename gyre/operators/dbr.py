"""Defect-budgeted selection: a greedy pass over three length bins under budgets for each defect.

The bins take turns, and each takes its next row that fits the budgets left; rounds go on until the target is met.  Within a pass budgets are fixed and counts only grow, so a
defect that has used its budget closes all patterns of flags that hold it, for good: between two such closings the choice is a plain
alternation of the bins over rows of open patterns, and where it ends follows from running counts.

1. Rows are sorted by ranges over all tasks and cut into blocks of BLOCK rows of a context and bin: a byte of flags each, and how often
   each pattern occurs.
2. One task a context finds the closings from the counts of its blocks.  Where a closing falls, it asks for the flags of these blocks, and goes
   on when it has them; contexts of up to WHOLE blocks have them from the beginning.
3. Each block is told how many rows of which patterns it gives in which step, and numbers its own.

No task holds a context's rows.  Counts are some hundred bytes a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions import quality
from gyre.functions.hashing import unit_score
from gyre.sources.shared import all_running, few, null_safe_join, small, written
from gyre.sources.tables import tasks

BLOCK = 4_096
#: Blocks of a context whose flags go to its task at once.
WHOLE = 256
BINS = ("short", "medium", "long")
RELAX = ("low_structure", "low_reasoning", "incorrect_answer", "silent_error", "parse_failure")


@dataclass(frozen=True)
class Budgets:
    ratio: float = 1.0
    rates: dict[str, float] = field(default_factory=lambda: {"parse_failure": 0.0, "silent_error": 0.10, "incorrect_answer": 0.30, "low_reasoning": 0.25, "low_structure": 0.30})
    parse_fallback: bool = False


def flagged(rows: DataFrame) -> DataFrame:
    """rows with defect flags, severity, length bin and sampling value."""
    flags = quality.defects(F.col("pred_parse_success"), F.col("is_silent_error"), F.col("correct"), F.col("reasoning_soundness"), F.col("structure"))
    rows = rows.withColumns({f"defect_{name}": flag for name, flag in flags.items()})
    parts = [F.col("seed"), F.col("branch"), F.col("generation"), F.col("example_id")]
    return rows.withColumn("severity", quality.severity({n: F.col(f"defect_{n}") for n in flags})).withColumn("length_bin", quality.length_bin(F.col("question"), *parts)).withColumn("sampling_value", unit_score(*parts, "dbr"))


#: Of each pattern of flags as a number, whether it has the defect of each bit; bits are in the order of quality.DEFECTS.
PATTERNS = np.arange(1 << len(quality.DEFECTS))
HAS = (PATTERNS[:, None] >> np.arange(len(quality.DEFECTS)) & 1).astype(bool)
PARSE = quality.DEFECTS.index("parse_failure")


class Wanted(Exception):
    """A context's next step falls into blocks whose flags are not here."""

    def __init__(self, blocks: list[tuple[int, int]]) -> None:
        self.blocks = blocks


class Bin:
    """The rows of a bin, in order, that are not chosen: counts of patterns for each block, and the flags of some blocks."""

    def __init__(self, number: int, counts: np.ndarray, flags: dict[int, np.ndarray]) -> None:
        self.number, self.left = number, counts.astype(np.int64).reshape(-1, len(PATTERNS))
        self.flags, self.live = flags, {at: np.ones(len(f), bool) for at, f in flags.items()}

    def open(self, patterns: np.ndarray) -> None:
        """Counts rows of these patterns, and their defects, up to each block."""
        self.patterns = patterns
        mine = self.left * patterns
        self.rows = np.concatenate([[0], np.cumsum(mine.sum(axis=1))])
        self.defects = np.concatenate([np.zeros((1, HAS.shape[1]), np.int64), np.cumsum(mine @ HAS, axis=0)])
        self.n = int(self.rows[-1])

    def block(self, k: int) -> int:
        """The block in which the first k rows end; the number of blocks if all rows are taken, so that no block is cut."""
        return int(np.searchsorted(self.rows, k, "right")) - 1

    def bounds(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Defects of the first k rows, at least and at most."""
        at = self.block(min(k, self.n))
        return self.defects[at], self.defects[min(at + (self.rows[at] < k), len(self.left))]

    def places(self, at: int) -> np.ndarray:
        """Places of rows of open patterns in a block."""
        if at not in self.flags:
            raise Wanted([(self.number, at)])
        return np.flatnonzero(self.live[at] & self.patterns[self.flags[at]])

    def exact(self, k: int) -> np.ndarray:
        """Defects of the first k rows."""
        at = self.block(min(k, self.n))
        inside = min(k, self.n) - self.rows[at]
        if not inside:
            return self.defects[at]
        places = self.places(at)[:inside]
        return self.defects[at] + HAS[self.flags[at][places]].sum(axis=0)

    def missing(self, first: int, last: int) -> list[tuple[int, int]]:
        """Blocks whose flags are needed to count any of the first to last rows exactly, and are not here."""
        first, last = min(first, self.n), min(last, self.n)
        ends = range(self.block(first), self.block(last) + 1)
        return [(self.number, at) for at in ends if at < len(self.left) and at not in self.flags and max(first, self.rows[at] + 1) <= min(last, self.rows[at + 1] - 1)]

    def take(self, k: int) -> list[tuple[int, int, int]]:
        """Chooses the first k rows: (block, rows ahead of it, rows of it) for each block that gives any."""
        out, at = [], self.block(k)
        inside = k - self.rows[at]
        cut = self.places(at)[:inside] if inside else None
        given = np.flatnonzero(np.diff(self.rows[: at + 1]))
        for block in given:
            out.append((int(block), int(self.rows[block]), int(self.rows[block + 1] - self.rows[block])))
            if block in self.live:
                self.live[block] &= ~self.patterns[self.flags[block]]
        self.left[given] *= ~self.patterns
        if inside:
            out.append((at, int(self.rows[at]), int(inside)))
            self.left[at] -= np.bincount(self.flags[at][cut], minlength=len(PATTERNS))
            self.live[at][cut] = False
        return out


def last_true(holds, low: int, high: int) -> int:
    """The largest number from low to high for which holds() is true, which it is up to some number; it is at low."""
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if holds(middle) else (low, middle - 1)
    return low


def chosen(bins: list[Bin], budgets: Budgets) -> tuple[list[dict], bool]:
    """What each block gives in each step of the selection, and whether the target is met.

    A step has its phase (0: the first budgets), the patterns open in it, the rows chosen before it and the rows that each bin has
    for it.  Raises Wanted where flags are missing.
    """
    totals = sum(b.left.sum(axis=0) for b in bins) @ HAS
    n = int(sum(b.left.sum() for b in bins))
    target = min(max(int(np.rint(n * budgets.ratio)), 1), n)
    limits = np.array([int(budgets.rates[name] * target) for name in quality.DEFECTS])
    limits[PARSE] = totals[PARSE] if budgets.parse_fallback else limits[PARSE]
    counts, taken, steps = np.zeros(len(limits), np.int64), 0, []

    def open_patterns() -> np.ndarray:
        closed = HAS & (counts >= limits)
        barred = HAS[:, PARSE] & (not budgets.parse_fallback)
        return ~(closed.any(axis=1) | barred)

    def take(part: list[tuple[Bin, int]], sizes: list[int], phase: int) -> None:
        nonlocal counts, taken
        base, gained = taken, sum(b.exact(k) for b, k in part)  # asks for flags before anything changes
        for b, k in part:
            mask = int((b.patterns.astype(np.int64) << PATTERNS).sum())
            steps.extend({"bin": b.number, "block": at, "step": len(steps), "phase": phase, "open": mask, "ahead": ahead, "n": rows, "base": base, "sizes": sizes} for at, ahead, rows in b.take(k))
            taken += k
        counts = counts + gained

    def sweep(phase: int) -> None:
        while taken < target:
            patterns = open_patterns()
            for b in bins:
                b.open(patterns)
            if not any(b.n for b in bins):
                return
            room = limits - counts
            watched = np.flatnonzero(HAS[patterns].any(axis=0))

            def fits(defects: np.ndarray) -> bool:
                return bool((defects[watched] < room[watched]).all())

            # A round that begins below the target is a whole one.
            rounds = last_true(lambda k: k == 0 or sum(min(b.n, k - 1) for b in bins) < target - taken, 0, max(b.n for b in bins))
            low = last_true(lambda k: fits(sum(b.bounds(k)[1] for b in bins)), 0, rounds)
            high = last_true(lambda k: fits(sum(b.bounds(k)[0] for b in bins)), low, rounds)
            missing = [m for b in bins for m in b.missing(low + (low < high), high)]
            if missing:
                raise Wanted(missing)
            rounds = last_true(lambda k: fits(sum(b.exact(k) for b in bins)), low, high)
            if rounds:
                sizes = [b.n for b in bins]
                take([(b, min(b.n, rounds)) for b in bins], sizes, phase)
            # In the next round a defect uses up its budget: each bin takes one row of what is open by then.
            for b in bins if taken < target else ():
                b.open(open_patterns())
                if b.n:
                    take([(b, 1)], [0] * len(bins), phase)

    sweep(0)
    for phase, name in enumerate(RELAX, 1):
        at = quality.DEFECTS.index(name)
        if taken >= target:
            break
        if limits[at] >= totals[at] or (name == "parse_failure" and not budgets.parse_fallback):
            continue
        limits[at] = totals[at]
        sweep(phase)
    return steps, taken >= target


def places_of(flags: np.ndarray, bin_number: int, steps: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Rank and phase of each row of a block from its steps in order; rank 0: not chosen."""
    rank, phase = np.zeros(len(flags), np.int64), np.zeros(len(flags), np.int64)
    for s in steps:
        mine = np.flatnonzero((rank == 0) & (s["open"] >> PATTERNS & 1).astype(bool)[flags])[: s["n"]]
        j = s["ahead"] + np.arange(len(mine))
        others = sum(np.minimum(size, j + (b < bin_number)) for b, size in enumerate(s["sizes"]) if b != bin_number)
        rank[mine], phase[mine] = s["base"] + 1 + j + others, s["phase"]
    return rank, phase


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(context, bin, place, at, flags, counts, example_ids): rows in order, `block` of a context and bin at most; blocks go by (place, at)."""
    order = ["context", "bin", "severity", F.desc_nulls_last("reasoning_soundness"), F.desc_nulls_last("structure"), F.desc_nulls_last("clarity"), "sampling_value", "example_id"]
    parts = max(tasks(rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.to_json("context", {"ignoreNullFields": "false"}).alias("key"), "context", "bin", "flags", "example_id")
    kind = rows.schema["context"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, 0
        for batch in chain(batches, [None]):
            parts = [*([held] if held is not None else []), *([pa.Table.from_batches([batch])] if batch is not None else [])]
            table = pa.concat_tables(parts) if parts else None
            if table is None or not table.num_rows:
                continue
            codes = table["key"].combine_chunks().dictionary_encode().indices.to_numpy() * len(BINS) + table["bin"].to_numpy()
            runs = np.concatenate([np.flatnonzero(np.diff(codes, prepend=-1)), [len(codes)]])
            begins = np.concatenate([np.arange(x, y, block) for x, y in zip(runs, runs[1:])])
            ends = np.append(begins[1:], len(codes))
            if batch is not None:  # the last block may go on in the next batch
                held = table.slice(begins[-1])
                begins, ends = begins[:-1], ends[:-1]
            if not len(begins):
                continue
            done = table.slice(0, ends[-1]).combine_chunks()
            flags, offsets = done["flags"].to_numpy().astype(np.uint8), np.append(begins, ends[-1])
            owner = np.repeat(np.arange(len(begins)), ends - begins)
            counts = np.bincount(owner * len(PATTERNS) + flags, minlength=len(begins) * len(PATTERNS))
            ids = done["example_id"].combine_chunks()
            yield pa.record_batch({
                "context": done["context"].take(begins).combine_chunks(),
                "bin": done["bin"].take(begins).combine_chunks(),
                "at": pa.array(np.arange(at, at + len(begins))),
                "flags": pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flags)]),
                "counts": pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1) * len(PATTERNS), pa.int32()), pa.array(counts)),
                "example_ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids),
            })
            at += len(begins)

    cut = ordered.mapInArrow(run, f"context {kind}, bin int, at long, flags binary, counts array<bigint>, example_ids array<string>")
    return cut.withColumn("place", F.spark_partition_id().cast("long"))


STEP = "struct<step:bigint,phase:bigint,open:bigint,ahead:bigint,n:bigint,base:bigint,sizes:array<bigint>>"
STEP_ARROW = pa.list_(pa.struct([*((name, pa.int64()) for name in ("step", "phase", "open", "ahead", "n", "base")), ("sizes", pa.list_(pa.int64()))]))


def _solved(budgets: Budgets, kind: str, given: DataFrame) -> DataFrame:
    """For each block of a context its steps, or for a context that lacks flags the blocks whose flags it wants."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bin", "ascending"), ("place", "ascending"), ("at", "ascending")])
        number = table["bin"].to_numpy()
        first = [int(np.searchsorted(number, b)) for b in range(len(BINS) + 1)]
        counts = table["counts"].combine_chunks().flatten().to_numpy().reshape(-1, len(PATTERNS))
        flags = table["flags"].to_pylist()
        bins = [Bin(b, counts[x:y], {at: np.frombuffer(f, np.uint8) for at, f in enumerate(flags[x:y]) if f is not None}) for b, (x, y) in enumerate(zip(first, first[1:]))]
        keys = table.select(["context", "place", "at"])
        try:
            steps, met = chosen(bins, budgets)
        except Wanted as wanted:
            out = keys.take([first[b] + at for b, at in wanted.blocks])
            return out.append_column("wanted", pa.array([True] * len(out))).append_column("met", pa.array([None] * len(out), pa.bool_())).append_column("steps", pa.array([None] * len(out), STEP_ARROW))
        of: list[list[dict]] = [[] for _ in flags]
        for s in steps:
            of[first[s.pop("bin")] + s.pop("block")].append(s)
        return keys.append_column("wanted", pa.array([False] * len(of))).append_column("met", pa.array([met] * len(of))).append_column("steps", pa.array(of, STEP_ARROW))

    return given.groupBy("context").applyInArrow(run, f"context {kind}, place bigint, at bigint, wanted boolean, met boolean, steps array<{STEP}>")


def dbr(rows: DataFrame, by: list[str], budgets: Budgets = Budgets(), block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(by, example_id, selected, selection_rank, decision_reason) of rows as flagged() makes them; rank null: not selected."""
    return decided(rows, by, budgets, block, whole).select(*by, "example_id", "selected", "selection_rank", "decision_reason")


def decided(rows: DataFrame, by: list[str], budgets: Budgets = Budgets(), block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """What dbr() gives, with length_bin and the defect flags of each row, which blocks carry: nothing is joined to the rows again.

    Rows of a bin go by severity, then by falling reasoning, structure and clarity (nulls last), sampling value and example_id.  A null in `by`
    is a value of its own; an empty table gives no rows.
    """
    bit = [F.col(f"defect_{n}").cast("int") * (1 << k) for k, n in enumerate(quality.DEFECTS)]
    number = F.array_position(F.array(*map(F.lit, BINS)), F.col("length_bin")).cast("int") - 1
    rows = rows.select(F.struct(*by).alias("context"), number.alias("bin"), sum(bit[1:], bit[0]).alias("flags"), "severity", "reasoning_soundness", "structure", "clarity", "sampling_value", "example_id")
    blocks = written(_blocks(written(rows, "flagged"), block), "blocks")
    kind, keys = blocks.schema["context"].dataType.simpleString(), ["place", "at"]
    open_, done = blocks.select("context", "bin", *keys, "counts"), []
    short = open_.groupBy("context").agg(F.count("*").alias("n")).filter(F.col("n") <= whole).select("context")
    known = written(open_.join(short, "context", "left_semi").select(*keys), "known")
    while True:
        flags = blocks.select(*keys, "flags").join(small(known), keys, "left_semi")
        out = written(_solved(budgets, kind, open_.join(flags, keys, "left")), "solved")
        done.append(out.filter("NOT wanted").select(*keys, "met", "steps"))
        wanted = out.filter("wanted")
        if wanted.isEmpty():
            break
        open_ = open_.join(wanted.select("context").distinct(), "context", "left_semi")
        known = written(known.union(wanted.select(*keys)).distinct(), "known")
    steps = done[0]
    for part in done[1:]:
        steps = steps.union(part)
    both = blocks.select("context", "bin", *keys, "flags", "example_ids").join(F.broadcast(steps) if few(steps, 10_000) else steps, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [places_of(np.frombuffer(f, np.uint8), b, s) for f, b, s in zip(*(batch[c].to_pylist() for c in ("flags", "bin", "steps")))]
            rank, phase = ([pa.array(x) for x in part] for part in zip(*found))
            lists = batch["example_ids"]
            owner = pa.array(np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())))
            flags = np.frombuffer(b"".join(batch["flags"].to_pylist()), np.uint8).astype(np.int32)
            yield pa.record_batch([batch["context"].take(owner), lists.flatten(), batch["bin"].take(owner), pa.array(flags), pa.concat_arrays(rank), pa.concat_arrays(phase), batch["met"].take(owner)], ["context", "example_id", "bin", "flags", "rank", "phase", "met"])

    out = both.mapInArrow(run, f"context {kind}, example_id string, bin int, flags int, rank bigint, phase bigint, met boolean")
    has = {n: (F.shiftright("flags", k) % 2 == 1).alias(f"defect_{n}") for k, n in enumerate(quality.DEFECTS)}
    taken = F.get(F.array(*[F.lit(r) for r in ("selected_within_budget", *[f"selected_relaxed_{n}" for n in RELAX])]), F.col("phase").cast("int"))
    reason = F.when(F.col("rank") > 0, taken).when(F.col("met"), "rejected_target_reached").when(has["parse_failure"], "rejected_parse_forbidden").otherwise("rejected_budget_constraints")
    length = F.get(F.array(*map(F.lit, BINS)), F.col("bin")).alias("length_bin")
    return out.select("context.*", "example_id", (F.col("rank") > 0).alias("selected"), F.nullif("rank", F.lit(0)).alias("selection_rank"), reason.alias("decision_reason"), length, *has.values())


def budget_checks(decided: DataFrame, by: list[str], budgets: Budgets = Budgets(), rank: str = "selection_rank", phase: str = "phase") -> DataFrame:
    """A selection replayed: for each context, phase and defect its limit, the most of it reached, and the rows chosen beyond the limit.

    decided: all rows of the contexts with their defect flags, their rank (null: not chosen) and the phase that chose them (0: the first budgets; k: with
    the first k of RELAX relaxed, each to all that a context has of it).  Rows are replayed in the order of their ranks by running sums over
    ranges of ranks, so a context of any size is spread.  Contexts without chosen rows give no rows.
    """
    flags = [f"defect_{n}" for n in quality.DEFECTS]
    n = F.count("*")
    target = F.least(F.greatest(F.rint(n * F.lit(budgets.ratio)).cast("long"), F.lit(1)), n)
    decided = written(decided.select(*by, F.col(rank).cast("long").alias("_rank"), F.col(phase).alias("phase"), *[F.col(f).cast("long").alias(f) for f in flags]), "decided")
    totals = decided.groupBy(*by).agg(target.alias("_target"), *[F.sum(f).alias(f"_all_{f}") for f in flags])
    rows = all_running(decided.filter("_rank IS NOT NULL"), by, "_rank", {f"_reached_{f}": f for f in flags})
    rows = null_safe_join(rows.withColumns({f"_reached_{f}": F.col(f"_reached_{f}") + F.col(f) for f in flags}), totals, by)
    parts = []
    for name, f in zip(quality.DEFECTS, flags):
        first = F.floor(F.lit(budgets.rates[name]) * F.col("_target")).cast("long")
        relaxed = F.col("phase") > RELAX.index(name) if name != "parse_failure" or budgets.parse_fallback else F.lit(False)
        limit = F.when(relaxed, F.greatest(first, F.col(f"_all_{f}"))).otherwise(first)
        parts.append(F.struct(F.lit(name).alias("defect"), limit.alias("limit"), F.col(f"_reached_{f}").alias("reached"), ((F.col(f) == 1) & (F.col(f"_reached_{f}") > limit)).cast("long").alias("beyond")))
    out = rows.select(*by, "phase", F.inline(F.array(*parts)))
    out = out.groupBy(*by, "phase", "defect").agg(F.max("limit").alias("limit"), F.max("reached").alias("reached"), F.sum("beyond").alias("n_beyond"))
    return out.withColumn("status", F.when(F.col("n_beyond") > 0, "violation").otherwise("ok"))


def phase_of(reason: Column) -> Column:
    """The phase that a decision's reason names."""
    names = ["selected_within_budget", *[f"selected_relaxed_{n}" for n in RELAX]]
    return (F.array_position(F.array(*map(F.lit, names)), reason) - 1).cast("int")


def defect_rates(rows: DataFrame, by: list[str], selected: str = "selected") -> DataFrame:
    """Rates of each defect before and after the selection, one row a context and defect; 0 where none is selected."""
    sums = [F.avg(F.col(f"defect_{n}").cast("int")).alias(f"before_{n}") for n in quality.DEFECTS] + [F.coalesce(F.avg(F.when(F.col(selected), F.col(f"defect_{n}").cast("int"))), F.lit(0.0)).alias(f"after_{n}") for n in quality.DEFECTS]
    parts = F.array(*[F.struct(F.lit(n).alias("defect"), F.col(f"before_{n}").alias("rate_before"), F.col(f"after_{n}").alias("rate_after")) for n in quality.DEFECTS])
    return rows.groupBy(*by).agg(*sums).select(*by, F.inline(parts)).withColumn("delta", F.col("rate_after") - F.col("rate_before"))
