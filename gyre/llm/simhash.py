"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits.

A fingerprint has eight bytes, each at its position.  Two of them that differ in at most three bits differ in at most three bytes,
so they share five positional bytes or more: the guaranteed minimum.  The index is inverted by positional bytes, three at a time:
of five positions three lie in one half of the eight, so the eight triples within a half find every such pair.  A triple is as rare
as 24 bits, where lists of single bytes would hold a part of 256 of the table each.

Within a list, fingerprints tally the positional bytes they share; those with the minimum are verified by their differing bits.
A list that is long, as of many variants of one text, is read by two more shared bytes: fingerprints with five bytes in common differ in
24 bits at most, a space that a task can hold whole, where a step of a bit is a look-up.  No list is cut, and none emits its pairs:
a task returns a spanning forest of the links it found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.llm.common import few, sliced, small, spaced, written
from gyre.llm.components import components

BITS = 3
WORDS = 3
SEED = 42
BYTES = 8
#: Positional bytes that linked fingerprints share at least.
LEAST = BYTES - BITS
#: Positions of an index key, so that any LEAST positions hold one of them.
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
#: Fingerprints of a list that are compared with each other; longer lists are read by LEAST bytes.
LIST = 1_024
#: Index entries that a task takes, about.
ENTRIES = 1_000_000
#: Shingles that are hashed at a time.
SHINGLES = 100_000
#: Ways in which the documents of one fingerprint are spread where they meet its component by a shuffle.
SALTS = 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a text's shingles, repeats included: a bit is set if more than half of the shingles' XXH64 have it.

    A text of fewer words is one shingle; one without words has fingerprint 0.  A shingle is a slice of the spaced text, so that no
    text is held word by word.
    """
    line = spaced(text)
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - words)
    starts = np.concatenate([[0], gaps + 1])[:n]
    ends = np.concatenate([gaps, [len(line)]])[-n:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        part = zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(line[i:j], seed) for i, j in part], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = np.fromiter((fingerprint(t.as_py(), words) for t in part["text"]), np.uint64, len(part))
            yield pa.record_batch({"doc_id": part["doc_id"], "fp": pa.array(found.view(np.int64))})

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _key(fp: Column, number: int, positions: tuple[int, ...]) -> Column:
    """The bytes of fp at these positions, and the number of the positions in the topmost byte."""
    mask = sum(0xFF << 8 * p for p in positions)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.struct(F.lit(number).cast("tinyint").alias("at"), fp.bitwiseAND(F.lit(signed)).alias("bytes"))


def _listed(nodes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): each fp of nodes in one list for each set of positions."""
    return nodes.select(F.explode(F.array(*[_key(F.col("fp"), n, s) for n, s in enumerate(sets)])).alias("key"), "fp")


def lists(entries: DataFrame) -> DataFrame:
    """(key, n) of lists with several entries, counted before they are shuffled."""
    return entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints a and b share LEAST positional bytes, and then differ in at most BITS bits."""
    x = (a ^ b).view(np.uint64)
    tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    out = tally >= LEAST
    out[out] = np.bitwise_count(x[out]) <= BITS
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) between nodes 0 to n - 1: each node that is not the least of its component, and that least."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def pairs_of_lists(list_of: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near entries of the same list, lists being runs of list_of: those one, two, three places apart, and so on."""
    at, step = np.arange(len(fp) - 1), 1
    while len(at):
        at = at[list_of[at] == list_of[at + step]]
        found = at[near(fp[at], fp[at + step])]
        yield found, found + step
        step += 1
        at = at[at + step < len(fp)]


#: All changes of 24 bits by one to BITS bits.
STEPS = np.array([sum(1 << b for b in s) for k in range(1, BITS + 1) for s in combinations(range(24), k)], np.uint32)


def pairs_of_space(small_fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of distinct values of 24 bits that differ in at most BITS bits, by a table of the whole space."""
    place = np.full(1 << 24, -1, np.int32)
    place[small_fp] = np.arange(len(small_fp))
    for step in STEPS:
        other = place[small_fp ^ step]
        mine = np.flatnonzero(other > np.arange(len(small_fp)))
        yield mine, other[mine]


def squeezed(fp: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """The bytes of fp that are not at these positions, as a number of 24 bits."""
    rest = [p for p in range(BYTES) if p not in positions]
    bits = fp.view(np.uint64)
    return sum(((bits >> np.uint64(8 * p) & np.uint64(0xFF)) << np.uint64(8 * n) for n, p in enumerate(rest)), np.zeros(len(fp), np.uint64)).astype(np.uint32)


def _links(fp: np.ndarray, ways: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """A spanning forest (a, b) of the links; ways are joined as they come, so that no task holds all of them."""
    nodes, at = np.unique(fp, return_inverse=True)
    held_a, held_b, held = [], [], 0
    a = b = np.empty(0, np.int64)
    for x, y in ways:
        if len(x):
            held_a.append(at[x])
            held_b.append(at[y])
            held += len(x)
        if held > ENTRIES:
            a, b = forest(len(nodes), np.concatenate([a, *held_a]), np.concatenate([b, *held_b]))
            held_a, held_b, held = [], [], 0
    a, b = forest(len(nodes), np.concatenate([a, *held_a]), np.concatenate([b, *held_b]))
    return pa.table({"a": nodes[a], "b": nodes[b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _in_lists(table: pa.Table) -> pa.Table:
    """Links in the short lists of a task."""
    at, key, fp = (table[c].to_numpy() for c in ("at", "bytes", "fp"))
    order = np.lexsort((key, at))
    at, key, fp = at[order], key[order], fp[order]
    list_of = np.concatenate([[0], np.cumsum((at[1:] != at[:-1]) | (key[1:] != key[:-1]))])
    return _links(fp, pairs_of_lists(list_of, fp))


FIVES = list(combinations(range(BYTES), LEAST))


def _in_spaces(table: pa.Table) -> pa.Table:
    """Links of fingerprints that share LEAST bytes: in the space of the other 24 bits, or pair by pair where that is less work."""
    fp = table["fp"].to_numpy()
    if len(fp) < len(STEPS):
        return _links(fp, pairs_of_lists(np.zeros(len(fp), np.int64), fp))
    return _links(fp, pairs_of_space(squeezed(fp, FIVES[table["at"][0].as_py()])))


def _in_short(index: DataFrame, sizes: DataFrame, longest: int, entries: int) -> DataFrame:
    """Links in the lists of an index that have at most `longest` entries, packed into tasks of some `entries`."""
    sizes = sizes.filter(F.col("n") <= longest)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(-(-total // entries), index.sparkSession.sparkContext.defaultParallelism)
    rows = index.join(small(sizes.select("key")), "key").select("key.*", "fp")
    return rows.groupBy(F.pmod(F.xxhash64("at", "bytes"), F.lit(tasks)).alias("task")).applyInArrow(_in_lists, "a long, b long")


def links(nodes: DataFrame, longest: int = LIST, entries: int = ENTRIES) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints (fp).

    Fingerprints of longer lists are listed once more, by
    LEAST bytes: each such list is a task's work of bounded size whatever the table.
    """
    index = _listed(nodes, TRIPLES)
    sizes = written(lists(index), "lists")
    out, long = _in_short(index, sizes, longest, entries), sizes.filter(F.col("n") > longest)
    if long.isEmpty():
        return out
    crowded = written(index.join(small(long.select("key")), "key").select("fp").distinct(), "crowded")
    deeper = _listed(crowded, FIVES)
    sizes = written(lists(deeper), "lists")
    spaces = deeper.join(small(sizes.filter(F.col("n") > longest).select("key")), "key").select("key.*", "fp")
    out = out.union(_in_short(deeper, sizes, longest, entries))
    return out.union(spaces.groupBy("at", "bytes").applyInArrow(_in_spaces, "a long, b long"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", longest: int = LIST) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs; component_id: the smallest doc_id reachable over links.

    Words: runs of anything but ASCII white space, A-Z lower-cased; shingles of WORDS words, repeats included; fingerprints link at BITS
    or fewer differing bits.  Null texts, empty ones and those of white space have fingerprint 0 and link like others.  Rows that share a
    doc_id link with each other.  A row whose doc_id is null joins others as its text does, and gets their component, or null if
    none has a doc_id.  Other columns are ignored; an empty table gives no rows.
    """
    sketch = written(fingerprints(docs, doc=doc, text=text), "fingerprints")
    nodes = written(sketch.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = written(links(nodes.select("fp"), longest), "links")
    twice = sketch.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("doc_id", F.col("a"))
    same_id = sketch.join(small(written(twice, "twice")), "doc_id").select("a", F.col("fp").alias("b"))
    place = written(components(found.union(same_id), "links"), "components")
    # A component is named by its least fingerprint here; its least doc_id follows from the nodes.
    placed = nodes.withColumnRenamed("fp", "node").join(small(place), "node", "left").withColumn("joined", F.col("component").isNotNull())
    joined = written(placed.filter("joined"), "joined")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(small(written(least, "least")), "component").select(F.col("node").alias("fp"), "component_id")
    # Other fingerprints of several rows are components by themselves; one of a single row is its own document's, and is not looked up.
    known = written(known.union(placed.filter("NOT joined AND n > 1").select(F.col("node"), "least")), "known")
    if few(known):
        out = sketch.join(F.broadcast(known), "fp", "left")
    else:
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = sketch.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(SALTS)).cast("int")).join(spread, ["fp", "salt"], "left")
    return out.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
