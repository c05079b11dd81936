"""Conversation structure repair: the cheapest edits after which a conversation is `(s?(ua)+)?` in the initials of its roles.

A forward Viterbi pass over four grammar states (nothing yet, after the system turn, after a user, after an assistant)
carries the least (cost, audit string) of each state.  Each turn is kept, given another role, or deleted; then the layer is
closed by insertions, two at most, as a third would only come back to a state.  Two audits of one layer edit the same turns,
so where their costs are equal neither opens the other, and the least of each layer stays least whatever follows.

Conversations of at most `window` turns are gathered and solved in one piece.  Longer ones are sorted by ranges over all tasks and
cut into chunks of `window` turns; a chunk is solved from each of the four states, and these tables are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.llm.common import few, null_safe_join, small, written

WINDOW = 1_024
#: Ways in which the turns of one text are spread where they meet its first turn by a shuffle.
SALTS = 16
BLANKS = " \t\n\v\f\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of a new role, a deletion, an insertion, and of a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: The states from which a turn of a role may follow, and the state after it.
MOVES = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
Layer = list[tuple[int, str] | None]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): conversations with faults put in by crc32(`conv_id:turn`) % 20, for tests of repairs.

    0: the turn goes, as copies 0; 1: its text becomes empty; 2: it loses its `.`, `!` and `?`; 3: it stands twice, as copies 2; 4: its
    role becomes user.  A null role, text, conv_id or turn counts as one space there; conv_id and turn stay null.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]).cast("binary")) % 20
    text = F.coalesce("text", space)
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def fault(role: str, text: str, again: bool) -> str:
    """The first fault of a turn: blank, duplicate, truncated, or none as an empty string."""
    body = text.rstrip(BLANKS)
    if not body:
        return "blank"
    return "duplicate" if again else "" if body[-1] in ".!?" else "truncated"


def faults(turns: list[tuple[str, str, bool]]) -> list[tuple[str, str]]:
    """(initial, fault) of turns (role, text, seen earlier); an empty role has an initial of its own, which no rule allows."""
    return [(role[:1] or "-", fault(role, text, again)) for role, text, again in turns]


def closed(layer: Layer) -> Layer:
    """A layer after insertions of a user's and then an assistant's turn, where those are cheaper."""
    layer = list(layer)
    for name in "ua":
        before, to = MOVES[name]
        ways = [(layer[s][0] + INSERT, layer[s][1] + "I") for s in before if layer[s]]
        layer[to] = min([*ways, *filter(None, [layer[to]])], default=None)
    return layer


def stepped(layer: Layer, initial: str, kind: str) -> Layer:
    """The closed layer after one more turn."""
    out = [(state[0] + DELETE, state[1] + "D") if state else None for state in layer]
    if kind not in ("blank", "duplicate"):
        cut = CUT if kind == "truncated" else 0
        edits = [(initial, 0, "K")] if initial in MOVES else []
        for name, cost, edit in [*edits, ("u", REROLE, "R"), ("a", REROLE, "R")]:
            before, to = MOVES[name]
            ways = [(layer[s][0] + cost + cut, layer[s][1] + edit) for s in before if layer[s]]
            out[to] = min([*ways, *filter(None, [out[to]])], default=None)
    return closed(out)


#: The layer before the first turn.
BEGIN = closed([(0, ""), None, None, None])


def solved(marks: list[tuple[str, str]], layer: Layer = BEGIN) -> Layer:
    for initial, kind in marks:
        layer = stepped(layer, initial, kind)
    return layer


def accepted(layer: Layer) -> tuple[int, str]:
    """The least (cost, audit) in a state in which a conversation may end."""
    return min(filter(None, (layer[NOTHING], layer[ASSISTANT])))


def replayed(turns: list[tuple[str, str, bool]], audit: str, state: int = NOTHING) -> list[tuple[str, str]]:
    """The (role, text) of turns after the edits of an audit, which begins in a state."""
    out, rest = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)[:2]
        if edit == "D":
            continue
        name = role[:1] if edit == "K" else "a" if state == USER else "u"
        out.append((role if edit == "K" else NAMES[name], text))
        state = MOVES[name][1]
    return out


def counted(marks: list[tuple[str, str]]) -> list[int]:
    """Blank, duplicate and truncated turns, and neighbours whose initials may not follow each other."""
    kinds = [kind for _, kind in marks]
    initials = [initial for initial, _ in marks]
    return [*map(kinds.count, ("blank", "duplicate", "truncated")), sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))]


def _expanded(turns: list[dict], again: bool) -> list[tuple[str, str, bool]]:
    """(role, text, seen earlier) of each copy of turns in order; again: the turns know already which are seen earlier."""
    seen: set[tuple[str, str]] = set()
    out = []
    for t in turns:
        key = (t["role"], t["text"])
        for k in range(t["copies"]):
            out.append((*key, (t["again"] or k > 0) if again else key in seen))
            seen.add(key)
    return out


def _edited(turns: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"role": role, "text": text} for role, text in turns]


REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _short(whole: DataFrame) -> DataFrame:
    """Conversations (conv_id, gaps, turns) that are held by one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns in batch["turns"].to_pylist():
                turns = _expanded(turns, False)
                marks = faults(turns)
                cost, audit = accepted(solved(marks))
                rows.append((*counted(marks), cost, audit, _edited(replayed(turns, audit))))
            columns = list(zip(*rows)) or [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string()), pa.array(columns[6], REPAIRED)]
            yield pa.record_batch([batch["conv_id"], batch["gaps"], pa.array([0] * len(rows), pa.int64()), *arrays], _names())

    return whole.select("conv_id", "gaps", "turns").mapInArrow(run, _schema(whole))


def _names() -> list[str]:
    return ["conv_id", "gaps", "chunk", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def _schema(df: DataFrame) -> str:
    kind = df.schema["conv_id"].dataType.simpleString()
    return f"conv_id {kind}, gaps bigint, chunk bigint, {COUNTS}, cost bigint, audit string, repaired array<struct<role:string,text:string>>"


def _seen_earlier(rows: DataFrame) -> DataFrame:
    """Distinct rows of turns with `again`: whether an earlier turn of the conversation has the same role and text.

    Only texts that stand at several turns are looked up, by their digest; their first turns are broadcast if they are few, else they
    meet the turns under SALTS salts, so that a text that fills a conversation is spread.
    """
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    first, keys = written(first, "first"), ["conv_id", "digest"]
    if few(first):
        first = F.broadcast(first)
    else:
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows, keys = rows.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")), [*keys, "salt"]
    out = null_safe_join(rows, first, keys, "left")
    return out.withColumn("again", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)))


def _chunks(rows: DataFrame, window: int) -> DataFrame:
    """Turns in chunks of at most `window` copies, (conv_id, place, at, turns): the order of chunks is that of (place, at).

    Rows are sorted over all tasks, so a conversation of any length is spread; a task cuts what it reads as it goes.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    spread = rows.select("conv_id", "turn", "role", "text", "copies", "again").repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size, at = None, [], 0, 0

        def chunk() -> pa.RecordBatch:
            return pa.record_batch([of, pa.array([at], pa.int64()), pa.array([held], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int32()), ("again", pa.bool_())])))], ["conv_id", "at", "turns"])

        for batch in batches:
            fields = batch.select(["role", "text", "copies", "again"]).to_pylist()
            for k, row in enumerate(fields):
                conv = batch["conv_id"].slice(k, 1)
                while row["copies"]:
                    if held and (size >= window or conv != of):
                        yield chunk()
                        held, size, at = [], 0, at + 1
                    take = min(row["copies"], window - size)
                    of, size = conv, size + take
                    held.append(row | {"copies": take})
                    row = row | {"copies": row["copies"] - take, "again": True}
        if held:
            yield chunk()

    cut = spread.mapInArrow(run, f"conv_id {kind}, at bigint, turns array<struct<role:string,text:string,copies:int,again:boolean>>")
    return cut.select("conv_id", F.spark_partition_id().cast("long").alias("place"), "at", "turns")


def _tables(chunks: DataFrame) -> DataFrame:
    """For each chunk its counts, first and last initial, and the (cost, audit) from each state to each state."""
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns in batch["turns"].to_pylist():
                marks = faults(_expanded(turns, True))
                table = [solved(marks, [(0, "") if s == entry else None for s in range(4)]) for entry in range(4)]
                rows.append((*counted(marks), marks[0][0], marks[-1][0], [x[0] if x else None for row in table for x in row], [x[1] if x else None for row in table for x in row]))
            columns = list(zip(*rows)) or [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.string())]
            names = ["conv_id", "place", "at", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "audits"]
            yield pa.record_batch([*(batch[c] for c in names[:3]), *map(pa.array, columns, types)], names)

    return chunks.mapInArrow(run, f"conv_id {kind}, place bigint, at bigint, {COUNTS}, first string, last string, costs array<bigint>, audits array<string>")


def joined(tables: list[list[list[tuple[int, str] | None]]]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost over chunks in order, and the state in which each is entered with its audit.

    A state carries its cost, the rank of its audit so far up to closing insertions, and these insertions: audits of one layer that
    differ elsewhere keep their order, so no more of them is ever compared.  What a chunk did is a link to what came before.
    """
    states = {s: (x[0], 0, x[1], None) for s, x in enumerate(BEGIN) if x}
    for table in tables:
        best: dict[int, tuple] = {}
        for s, (cost, rank, tail, _) in states.items():
            for e, way in enumerate(table[s]):
                if way and (e not in best or (cost + way[0], rank, tail + way[1]) < best[e][:3]):
                    best[e] = (cost + way[0], rank, tail + way[1], s)
        ranks = {key: n for n, key in enumerate(sorted({(rank, audit.rstrip("I")) for _, rank, audit, _ in best.values()}))}
        states = {e: (cost, ranks[rank, audit.rstrip("I")], audit[len(audit.rstrip("I")) :], (states[s][3], s, table[s][e][1])) for e, (cost, rank, audit, s) in best.items()}
    cost, _, _, link = min((states[e] for e in (NOTHING, ASSISTANT) if e in states), key=lambda x: x[:3])
    path = []
    while link:
        path.append(link[1:])
        link = link[0]
    path.reverse()
    head = BEGIN[path[0][0]][1]  # what was inserted ahead of all turns belongs to the first chunk
    return cost, [(NOTHING, head + path[0][1]), *path[1:]]


def _paths(tables: DataFrame) -> DataFrame:
    """(conv_id, place, at, chunk, entry, audit, cost, illegal) of each chunk: cost and neighbours across chunks count at the first turn of one."""
    kind = tables.schema["conv_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("at", "ascending")])
        firsts, lasts = table["first"].to_pylist(), table["last"].to_pylist()
        ways = [[[(c, a) if a is not None else None for c, a in zip(costs[s : s + 4], audits[s : s + 4])] for s in range(0, 16, 4)] for costs, audits in zip(table["costs"].to_pylist(), table["audits"].to_pylist())]
        cost, path = joined(ways)
        across = [0, *(int(x + y not in LEGAL) for x, y in zip(lasts, firsts[1:]))]
        illegal = [x + y for x, y in zip(table["illegal"].to_pylist(), across)]
        n = len(path)
        arrays = [pa.array(range(n), pa.int64()), pa.array([s for s, _ in path], pa.int32()), pa.array([a for _, a in path], pa.string()), pa.array([cost] + [0] * (n - 1), pa.int64()), pa.array(illegal, pa.int64())]
        return pa.table([*(table[c] for c in ("conv_id", "place", "at")), *arrays], ["conv_id", "place", "at", "chunk", "entry", "audit", "cost", "illegal"])

    some = tables.select("conv_id", "place", "at", "first", "last", "costs", "audits", "illegal")
    return some.groupBy("conv_id").applyInArrow(run, f"conv_id {kind}, place bigint, at bigint, chunk bigint, entry int, audit string, cost bigint, illegal bigint")


def _long(rows: DataFrame, window: int) -> DataFrame:
    """Conversations that are spread over tasks.  Equal turns are counted before they are sorted."""
    rows = rows.filter("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies"))
    chunks = written(_chunks(_seen_earlier(written(rows, "turns")), window), "chunks")
    tables = written(_tables(chunks), "tables")
    missing = null_safe_join(_paths(tables), gaps(rows), ["conv_id"]).withColumn("gaps", F.when(F.col("chunk") == 0, F.col("gaps")).otherwise(0))
    paths = written(missing, "paths")
    keys = ["conv_id", "place", "at"]
    both = null_safe_join(chunks, small(paths, 100_000), keys)
    both = null_safe_join(both, tables.select(*keys, "blank", "duplicate", "truncated"), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_edited(replayed(_expanded(turns, True), audit, entry)) for turns, audit, entry in zip(*(batch[c].to_pylist() for c in ("turns", "audit", "entry")))]
            yield pa.record_batch([*(batch[c] for c in _names()[:-1]), pa.array(done, REPAIRED)], _names())

    return both.mapInArrow(run, _schema(rows))


def _parts(turns: DataFrame, window: int) -> list[DataFrame]:
    """The repairs of conversations that are one piece, and of those in chunks if there are any."""
    turns = turns.select("conv_id", "turn", "role", "text", "copies")
    long = written(turns.groupBy("conv_id").agg(F.sum("copies").alias("_n")).filter(F.col("_n") > window).select(F.col("conv_id").alias("_conv")), "long")
    parts, rest, same = [], turns, F.col("conv_id").eqNullSafe(F.col("_conv"))
    if not long.isEmpty():
        long = small(long)
        rest = turns.join(long, same, "left_anti")
        parts = [_long(turns.join(long, same, "left_semi"), window)]
    here = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies"))
    whole = rest.groupBy("conv_id").agg(F.sort_array(F.collect_list(here)).alias("turns"))
    numbers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull()))
    missing = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(numbers), F.lit(0)).cast("long")
    return [_short(whole.withColumn("gaps", missing)), *parts]


def repairs(turns: DataFrame, window: int = WINDOW) -> DataFrame:
    """The cheapest repair of each conversation of turns (conv_id, turn, role, text, copies; see damaged()): one row, or one a chunk.

    Columns: conv_id, gaps (numbers missing between its least and greatest turn; of the conversation, at chunk 0), chunk (from 0), blank, duplicate,
    truncated, illegal, cost (of the conversation, at chunk 0), audit, repaired (array of role and text).  Conversations of more than
    `window` turns come in chunks.

    Turns go by (turn, role, text), nulls first.  Faults, of which a turn's first counts: blank (nothing but ASCII white space), duplicate
    (role and text stand earlier), truncated (the last other character is none of `.!?`).  illegal: neighbours whose roles'
    initials are not su, ua or au.  Edits: K keeps (0), R gives the role user or assistant (1), D deletes (2; blank and duplicate
    turns must go), I inserts an empty turn (5); a truncated turn that stays costs 5 more.  Of audits that cost the same the least in ASCII is taken.

    A conversation without turns (copies 0 in all) gives a row of zeros.  Role and text are not null (damaged() sees to it); an empty role has no
    initial that a rule allows.  A null conv_id is a conversation of its own.  Other columns are ignored; an empty table gives no rows.
    """
    return reduce(DataFrame.union, _parts(turns, window))


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): numbers missing between the least and the greatest turn of each conversation; without numbers none."""
    numbers = turns.select("conv_id", "turn").distinct().groupBy("conv_id")
    return numbers.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def _body() -> Column:
    return F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digests(chunks: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations in chunks: of their turns as `role:text`, joined by new lines.

    A digest is sequential in its text, so one task reads a conversation, chunk by chunk, and holds no more than a batch of them.
    """
    kind = chunks.schema["conv_id"].dataType.simpleString()
    body = chunks.filter(F.size("repaired") > 0).select("conv_id", "chunk", _body().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, hashed = None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch([of, pa.array([hashed.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            for k, text in enumerate(batch["body"].to_pylist()):
                conv = batch["conv_id"].slice(k, 1)
                if conv != of:
                    if hashed:
                        yield out()
                    of, hashed = conv, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(text.encode("utf-8", "surrogatepass"))
        if hashed:
            yield out()

    return body.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def reports(turns: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each conversation of turns: what repairs() counts and costs, the whole audit, and the digest of the repaired turns."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    short, *long = _parts(turns, window)
    out = short.select("conv_id", *counts, "audit", F.sha2(_body(), 256).alias("repaired_sha256"))
    for chunks in long:
        chunks = written(chunks, "repairs")
        audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
        whole = chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], audit.alias("audit"))
        whole = null_safe_join(whole, digests(chunks), ["conv_id"], "left")
        out = out.union(whole.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))
    return out
