"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. Each text becomes a digest of its words and a SuperMinHash signature of its set of word shingles.
2. Texts with equal words are one node; nodes with an equal band of signature rows share a bucket.
3. Each node is compared with the smallest node of each of its buckets, on full sets.  A bucket whose nodes are
   then linked with each other is settled, and its other pairs need no look.
4. In a bucket of a block or less that is not settled, all nodes outside its largest group of linked nodes are compared with all nodes.  In a
   larger one they are compared with a sample of that group.
5. What is then not settled in larger buckets is compared by a second key: the shingles of a set, the commonest last, of which two linked sets
   share one among the first few (prefix filter), at places and in sets of sizes that leave room for the rest (positional filter).
6. Components of the links are the groups of near-duplicates.

Comparisons count through an inverted index.  Large buckets are cut into blocks, and blocks meet in a task, so no task holds a
whole bucket; a task returns a spanning forest of the links that it found, not the links.  Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.llm.common import few, sliced, small, spaced, words_of, written
from gyre.llm.components import UnionFind, components


@dataclass(frozen=True)
class Settings:
    """percent: the least similarity, 100 * |A and B| >= percent * |A or B|.  bands of rows each make the signature.

    A pair at the threshold t shares no band with probability (1 - t ** rows) ** bands: under 1e-6 for 85 %
    with 36 bands of 7, under 4e-6 for 80 % with 42 bands of 6.
    """

    percent: int = 85
    bands: int = 36
    rows: int = 7
    words: int = 5
    #: Nodes and shingles of a block at most, about.
    block_nodes: int = 512
    block_shingles: int = 1_000_000
    #: Nodes of a bucket's largest group that others are compared with before all of it.
    sample: int = 256


NEAR_85 = Settings()
NEAR_80 = Settings(percent=80, bands=42, rows=6)

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}
WORDS_KEPT = 100_000
#: Elements whose permutations are held at a time.
ELEMENTS = 50_000
#: Rows that a worker turns into sets at a time.
SLICE = 128


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _stride(k: int) -> np.uint64:
    return np.uint64(int(STEP) * k & 0xFFFFFFFFFFFFFFFF)


def _word_hash(word: bytes) -> int:
    value = _words.get(word)
    if value is None:
        value = xxhash.xxh3_64_intdigest(word)
        if len(_words) < WORDS_KEPT:
            _words[word] = value
    return value


def shingles(line: bytes, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words; fewer words are one shingle.  line: words between spaces."""
    hashes = np.fromiter(map(_word_hash, words_of(line)), np.uint64)
    n = len(hashes)
    if not n:
        return hashes
    take = min(size, n)
    total = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        total = mixed(total + STEP) + hashes[k : n - take + 1 + k] if k else mixed(total) + hashes[: n - take + 1]
    return np.unique(mixed(total))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m values for each set (an empty set: all infinite).

    Round j draws, for each element, a value in [j, j + 1) and the j-th place of the element's own random
    permutation of the m slots; a slot keeps the least value that it gets.  Values only rise with j, so a set
    is done as soon as all of its slots are below the round's number.  All sets of a batch take each round
    together; elements go in slices, which bounds the memory for the permutations.
    """
    out = np.full((len(sets), m), np.inf)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    elements, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    for start in range(0, len(elements), ELEMENTS):
        e, owner = elements[start : start + ELEMENTS], owners[start : start + ELEMENTS]
        places = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(e), 1))
        first, last = owner[0], owner[-1] + 1
        row = np.arange(len(e))
        for j in range(m):
            open_sets = out[first:last].max(axis=1) >= j
            if not open_sets.any():
                break
            if not open_sets[owner - first].all():
                live = open_sets[owner - first]
                e, owner, places = e[live], owner[live], places[live]
                row = np.arange(len(e))
            if not len(e):
                break
            draw = mixed(e + _stride(2 * j + 1))
            value = j + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            other = j + ((mixed(e + _stride(2 * j + 2)) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            place = places[row, other]
            places[row, other] = places[:, j]
            np.minimum.at(flat, owner * m + place, value)
    return out


def band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    values = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), settings.bands, settings.rows)
    key = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64) * STEP, values.shape[:2])
    for k in range(settings.rows):
        key = mixed(key + values[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, settings: Settings, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, bands) of each row.  Without words: null digest and bands, 0 shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, SLICE):
            lines = [spaced(t.as_py()) for t in part["text"]]
            sets = [shingles(line, settings.words) for line in lines]
            keys = band_keys(super_minhash(sets, settings.bands * settings.rows), settings)
            yield pa.record_batch({
                "doc_id": part["doc_id"],
                "digest": pa.array([hashlib.sha256(line).digest() if line else None for line in lines], pa.binary()),
                "n_shingles": pa.array(map(len, sets), pa.int64()),
                "bands": pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64())),
            })

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, digest binary, n_shingles long, bands array<long>")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, n_shingles, lead) of nodes (node, n_shingles, bands) in buckets of several nodes; lead: the bucket's smallest."""
    exploded = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last").select("key", "lead")
    buckets = written(buckets, "buckets")
    return exploded.join(small(buckets), "key").select("key", "node", "n_shingles", "lead")


def stars(members: DataFrame) -> DataFrame:
    """Comparisons (see verified_edges) of each node with the leads of its buckets: one group for each lead."""
    leads = members.filter("node = lead").groupBy(F.col("lead").alias("group"), "node").agg(F.max("n_shingles").alias("n_shingles"))
    others = members.filter("node > lead").groupBy(F.col("lead").alias("group"), "node").agg(F.max("n_shingles").alias("n_shingles"))
    return leads.withColumn("minor", F.lit(True)).union(others.withColumn("minor", F.lit(False))).withColumn("apart", F.lit(False))


def unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, n_shingles, minor, n, shingles, most) of buckets whose nodes are in several components of found (node, component).

    minor: nodes outside the largest component of the bucket, which has `most` nodes.  n, shingles: of all its nodes.  Of buckets with equal nodes,
    one is taken.
    """
    placed = members.join(small(found), "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    sums = [F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), *[F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]]
    parts = placed.groupBy("key", "component").agg(*sums)
    largest = F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("top")
    keys = parts.groupBy("key").agg(F.count("*").alias("parts"), largest, *[F.sum(c).alias(f"all_{c}") for c in ("n", "shingles", "h1", "h2")]).filter("parts > 1")
    one = F.min(F.struct("key", F.col("top.n").alias("most"), (-F.col("top.c")).alias("main"))).alias("one")
    keys = keys.groupBy(F.col("all_n").alias("n"), F.col("all_shingles").alias("shingles"), "all_h1", "all_h2").agg(one).select("one.*", "n", "shingles")
    return placed.join(small(written(keys, "unsettled")), "key").withColumn("minor", F.col("component") != F.col("main")).drop("component", "main")


def _block_or_less(settings: Settings):
    return (F.col("n") <= settings.block_nodes) & (F.col("shingles") <= settings.block_shingles)


def sampled(rows: DataFrame, settings: Settings) -> DataFrame:
    """Comparisons (see verified_edges) of unsettled() buckets: whole ones of a block or less; of others, minor nodes and about `sample` others, by a hash."""
    some = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("most") / settings.sample)) == 0
    rows = rows.filter(_block_or_less(settings) | F.col("minor") | some)
    return rows.select(F.col("key").alias("group"), "node", "n_shingles", "minor", (~_block_or_less(settings)).alias("apart"))


#: Slots in which shingles are counted to be ordered by; the order need only be the same for all sets, so slots may be shared.
SLOTS = 1 << 21
#: Entries of a list that are all looked at in pairs; of longer lists only those outside its largest component look at others.
LIST = 4_096
#: Entries that a task takes, about.
ENTRIES = 500_000


def ordered_first(found: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, the commonest last, and for each the largest size of a set that it may be the first shared one with.

    A set of n shingles shares at least percent % of n with any set it links with, so one of its first n - that + 1 is shared.  Where a shared
    shingle is the first, at place i, no more than n - i are; that bounds the size of the other set.
    """
    n = len(found)
    place = np.arange(n - -(-percent * n // 100) + 1 if n else 0)
    order = np.lexsort((found, counts[found % np.uint64(len(counts))]))
    return found[order[: len(place)]], (n - place) * (100 + percent) // percent - n


def pairs_of_lists(lists: np.ndarray, size: np.ndarray, most: np.ndarray, component: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two entries of one list, of several components, each of a size within the other's bound, the larger one at home.

    Entries are sorted by list, then by size: an entry looks at those after it until they are too large.
    """

    def kept(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = (most[y] >= size[x]) & (component[x] != component[y]) & home[y]
        return x[hit], y[hit]

    begins = np.flatnonzero(np.diff(lists, prepend=-1))
    ends = np.append(begins[1:], len(lists))
    short = np.repeat(ends - begins <= LIST, ends - begins)
    at, step = np.flatnonzero(short), 1
    while len(at):
        at = at[at + step < len(lists)]
        at = at[(lists[at] == lists[at + step]) & (size[at + step] <= most[at])]
        yield kept(at, at + step)
        step += 1
    for begin, end in zip(begins, ends):
        if end - begin > LIST:
            names, which = np.unique(component[begin:end], return_inverse=True)
            for x in begin + np.flatnonzero(which != np.bincount(which, minlength=len(names)).argmax()):
                y = np.arange(begin, begin + np.searchsorted(size[begin:end], most[x], "right"))
                later = y > x
                yield kept(np.full(later.sum(), x), y[later])
                yield kept(y[~later], np.full((~later).sum(), x))


def _candidates(table: pa.Table) -> pa.Table:
    """Candidate pairs in the lists of a task, each once."""
    keys = ("shingle", "cell", "size", "node")
    shingle, cell, size, node, most, component, home = (table[c].to_numpy() for c in (*keys, "most", "component", "home"))
    order = np.lexsort((node, size, cell, shingle))
    shingle, cell, size, node, most, component, home = (x[order] for x in (shingle, cell, size, node, most, component, home))
    lists = np.concatenate([[0], np.cumsum((shingle[1:] != shingle[:-1]) | (cell[1:] != cell[:-1]))])
    found = {(a, b, m, n) if a < b else (b, a, n, m) for x, y in pairs_of_lists(lists, size, most, component, home) for a, b, m, n in zip(node[x].tolist(), node[y].tolist(), size[x].tolist(), size[y].tolist())}
    columns = list(zip(*found)) or [[]] * 4
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("a", "b", "a_size", "b_size"), columns)})


def prefix_candidates(texts: DataFrame, settings: Settings) -> DataFrame:
    """Candidate pairs (a, b, a_size, b_size) among texts (node, component, text): all linked pairs of different components, and few others.

    Shingles are counted in SLOTS slots, an array of fixed size that goes to every task.  An entry is a shingle of a set's first ones; entries of
    one shingle and of sizes within a factor of the threshold meet.
    """
    percent, size = settings.percent, settings.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for part in sliced(batches, SLICE):
            for text in part["text"]:
                np.add.at(total, shingles(spaced(text.as_py()), size) % np.uint64(SLOTS), 1)
        used = np.flatnonzero(total)
        yield pa.record_batch({"slot": pa.array(used), "n": pa.array(total[used])})

    slots = written(texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots").toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots["slot"]] = slots["n"]
    known = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, SLICE):
            sets = [shingles(spaced(t.as_py()), size) for t in part["text"]]
            firsts = [ordered_first(s, known.value, percent) for s in sets]
            n = [len(first) for first, _ in firsts]
            owner = np.repeat(np.arange(len(sets)), n)
            shingle = np.concatenate([first for first, _ in firsts])
            # A shingle that is alone in its slot is in no other set.
            shared = known.value[shingle % np.uint64(SLOTS)] > 1
            owner, rows = owner[shared], pa.array(owner[shared])
            yield pa.record_batch({"shingle": pa.array(shingle[shared].view(np.int64)), "node": part["node"].take(rows), "component": part["component"].take(rows), "size": pa.array(np.array([len(s) for s in sets], np.int64)[owner]), "most": pa.array(np.concatenate([most for _, most in firsts])[shared])})

    rows = written(texts.mapInArrow(entries, "shingle long, node long, component long, size long, most long"), "entries")
    # A list is cut by sizes, a step a twentieth: an entry is at home in the cell of its own size and looks into those up to its bound.
    cell = lambda c: F.floor(F.log(c) / F.log(F.lit(1.05))).cast("int")
    rows = rows.withColumn("cell", F.explode(F.sequence(cell("size"), F.greatest(cell("size"), cell("most"))))).withColumn("home", F.col("cell") == cell("size"))
    lists = rows.groupBy("shingle", "cell").agg(F.count("*").alias("n"), F.max("home").alias("home"), F.min("component").alias("x"), F.max("component").alias("y"))
    lists = written(lists.filter("home AND x < y").select("shingle", "cell", "n"), "lists")
    total = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(-(-total // ENTRIES), texts.sparkSession.sparkContext.defaultParallelism)
    met = rows.join(small(lists.select("shingle", "cell")), ["shingle", "cell"])
    found = met.groupBy(F.pmod(F.xxhash64("shingle", "cell"), F.lit(tasks)).alias("task")).applyInArrow(_candidates, "a long, b long, a_size long, b_size long")
    return found.distinct()


def remaining(docs: DataFrame, rows: DataFrame, found: DataFrame, settings: Settings, doc: str, text: str) -> DataFrame:
    """Comparisons (see verified_edges) of what is not settled in buckets of more than a block: each candidate pair, by its smaller node."""
    crowd = rows.filter(~_block_or_less(settings)).select("node").distinct()
    crowd = written(crowd.join(small(found), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "crowd")
    texts = docs.select(F.col(doc).cast("long").alias("node"), F.col(text).alias("text")).join(small(crowd), "node")
    pairs = written(prefix_candidates(texts, settings), "candidates")
    centre = pairs.groupBy(F.col("a").alias("group")).agg(F.max("a_size").alias("n_shingles")).select("group", F.col("group").alias("node"), "n_shingles", F.lit(True).alias("minor"))
    others = pairs.groupBy(F.col("a").alias("group"), F.col("b").alias("node")).agg(F.max("b_size").alias("n_shingles"))
    return centre.union(others.withColumn("minor", F.lit(False))).withColumn("apart", F.lit(False))


def linked_pairs(sets: list[np.ndarray], percent: int, probes: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the first `probes` sets, the later sets that it links with, by counting through an inverted index."""
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")  # owners rise within each element
    posted, starts = owner[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ends = np.cumsum(sizes)
    for x in range(min(probes, len(sets) - 1)):
        mine = slice(ends[x] - sizes[x], ends[x])
        lo, hi = place[mine] + 1, starts[ids[mine] + 1]
        n = hi - lo
        if not n.sum():
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(posted[at], minlength=len(sets))
        found = np.flatnonzero(100 * shared >= percent * (sizes[x] + sizes - shared))
        yield x, found[found > x]


def _verify(settings: Settings):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, group in pdf.groupby("group", sort=True):
            if len(group) < 2:
                continue
            group = group.sort_values("minor", ascending=False, kind="stable")
            nodes, sets = group["node"].tolist(), [np.asarray(s).view(np.uint64) for s in group["shingles"]]
            forest = UnionFind()
            for x, others in linked_pairs(sets, settings.percent, int(group["minor"].sum())):
                links += [(nodes[x], nodes[y]) for y in others.tolist() if forest.union(x, y)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def comparisons(groups: DataFrame, settings: Settings) -> DataFrame:
    """(node, tasks): where each node of groups is compared; a task is (group, minor, kind, left, right).

    A group of a block or less is one task, and such groups are packed by their shingles.  In a larger one, each block of
    minor nodes meets each block of the others (kind 1) and, if there are several minor nodes and they are not held apart, each block of
    these (kind 0).
    """
    of = lambda minor, column: F.coalesce(F.sum(F.when(F.col("minor") == minor, column)), F.lit(0))
    sizes = groups.groupBy("group").agg(F.max("apart").alias("apart"), *[of(minor, column).alias(name) for minor, column, name in ((True, F.lit(1), "n1"), (True, F.col("n_shingles"), "s1"), (False, F.lit(1), "n0"), (False, F.col("n_shingles"), "s0"))])
    blocks = [F.greatest(F.ceil(F.col(f"n{k}") / settings.block_nodes), F.ceil(F.col(f"s{k}") / settings.block_shingles)).alias(f"b{k}") for k in (1, 0)]
    alone = (F.col("n1") + F.col("n0") <= settings.block_nodes) & (F.col("s1") + F.col("s0") <= settings.block_shingles)
    sizes = written(sizes.select("group", F.when(F.col("apart"), 0).otherwise(F.col("n1")).alias("n1"), (F.col("n1") + F.col("n0")).alias("n"), (F.col("s1") + F.col("s0")).alias("s"), *blocks, alone.alias("alone")), "sizes")
    n, s = sizes.filter("alone").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    bins = max(1, -(-n // settings.block_nodes), -(-s // settings.block_shingles))
    own = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("minor"), F.col("b1")).otherwise(F.col("b0")), F.lit(1)))

    def task(kind: int, left, right):
        return F.struct(F.col("group"), F.col("minor"), F.lit(kind).alias("kind"), left.cast("long").alias("left"), right.cast("long").alias("right"))

    def each(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), make)).otherwise(F.array().cast(kinds))

    kinds = "array<struct<group:bigint,minor:boolean,kind:int,left:bigint,right:bigint>>"
    packed = F.array(task(-1, F.pmod(F.xxhash64("group"), F.lit(bins)), F.lit(-1)))
    among = each(F.when(F.col("n1") > 1, F.col("b1")).otherwise(F.lit(0)), lambda i: task(0, F.least(own, i), F.greatest(own, i)))
    across = F.when(F.col("minor"), each(F.col("b0"), lambda j: task(1, own, j))).otherwise(each(F.col("b1"), lambda i: task(1, i, own)))
    tasks = F.when(F.col("alone"), packed).when(F.col("minor"), F.concat(among, across)).otherwise(across)
    rows = groups.join(small(sizes), "group").select("node", F.explode(tasks).alias("task"))
    return rows.groupBy("node").agg(F.collect_list("task").alias("tasks"))


def verified_edges(docs: DataFrame, groups: DataFrame, settings: Settings, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A spanning forest (a, b) of the links within groups (group, node, n_shingles, minor, apart), confirmed on full sets.

    Minor nodes are compared with all nodes of their group, or in groups of more than a block that are held apart with those that are not minor; the
    others are not compared with each other.  A node's set is found once.
    """
    tasks = written(comparisons(groups, settings), "tasks")
    size = settings.words

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, SLICE):
            found = [shingles(spaced(t.as_py()), size).view(np.int64) for t in part["text"]]
            yield pa.record_batch({"node": part["node"], "tasks": part["tasks"], "shingles": pa.array(found, pa.list_(pa.int64()))})

    known = F.broadcast(tasks) if few(tasks.select(F.explode("tasks"))) else tasks
    texts = docs.select(F.col(doc).cast("long").alias("node"), F.col(text).alias("text")).join(known, "node")
    whole = texts.mapInArrow(sets, f"node long, tasks {tasks.schema['tasks'].dataType.simpleString()}, shingles array<long>")
    whole = whole.select("node", "shingles", F.explode("tasks").alias("task")).select("node", "shingles", "task.*")
    # A group that is packed is told from others in its task; a large one has tasks of its own.
    whole = whole.withColumn("large", F.when(F.col("kind") >= 0, F.col("group")))
    return whole.groupBy("large", "kind", "left", "right").applyInPandas(_verify(settings), "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = NEAR_85, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Words: runs of anything but ASCII white space, A-Z lower-cased.  A document's set holds its distinct shingles
    of settings.words words; with fewer words, all of them are one shingle.  Documents link if their sets are
    at least settings.percent % alike; component_id is the smallest doc_id reachable over links.
    Null and empty texts, and texts of white space, have no shingles and link with nothing.  Rows that share
    a doc_id count as one document with all of their texts.  A row whose doc_id is null links others to
    nothing; it gets the component of an equal text, or null.  An empty table gives no rows.
    """
    sketch = written(sketches(docs, settings, doc, text), "sketches")
    copies = sketch.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    copies = written(copies, "copies")
    members = written(bucket_members(copies.filter("node IS NOT NULL")), "members")
    links = written(verified_edges(docs, stars(members), settings, doc, text), "confirmed")  # in a stage of its own, or a task would hold two workers
    found = written(components(links, "links"), "components")
    rows = written(unsettled(members, found), "groups")
    if not rows.isEmpty():
        links = links.union(written(verified_edges(docs, sampled(rows, settings), settings, doc, text), "confirmed"))
        if not rows.filter(~_block_or_less(settings)).isEmpty():
            found = written(components(links, "links"), "components")
            rows = written(unsettled(members, found), "groups")
            links = links.union(written(verified_edges(docs, remaining(docs, rows, found, settings, doc, text), settings, doc, text), "confirmed"))
    same_id = sketch.filter("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    by_id = sketch.join(small(same_id.select("doc_id")), "doc_id").join(copies.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = written(components(links.union(by_id), "links"), "components")
    repeated = copies.filter("n > 1").select("digest", "node")
    out = sketch.select("doc_id", "n_shingles", "digest").join(small(repeated, 500_000), "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")).join(small(found), "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, settings: Settings = NEAR_80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: that with the smallest doc_id, in one row.

    All columns stay.  Of rows that share a doc_id, the one with the smallest text stays, then with the smallest other
    columns, as JSON.  Rows without a doc_id go only if their text equals that of a document with one.
    """
    found = near_duplicates(docs, settings, doc, text)
    found = written(found.select(F.col("doc_id").alias("_doc"), "kept"), "found")
    gone = found.filter("NOT kept AND _doc IS NOT NULL").select("_doc").distinct()
    docs = docs.join(small(gone), F.col(doc) == F.col("_doc"), "left_anti")
    twice = written(found.filter("kept AND _doc IS NOT NULL").groupBy("_doc").agg(F.count("*").alias("n")).filter("n > 1").select("_doc"), "twice")
    if twice.isEmpty():
        return docs
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col(text), F.to_json(F.struct(*docs.columns))))
    once = docs.join(small(twice), F.col(doc) == F.col("_doc"), "left_semi").groupBy(doc).agg(first.alias("_row")).select("_row.*")
    return docs.join(small(twice), F.col(doc) == F.col("_doc"), "left_anti").unionByName(once)
