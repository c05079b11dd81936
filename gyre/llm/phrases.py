"""Phrase collocations by Suffix-sigma: counts of all short phrases, and the phrases whose words stand together more than by chance.

1. A task turns some texts at a time into word numbers, and every word into the suffix of at most MAX_WORDS words that begins there and
   ends with its piece.  Equal suffixes are counted, and go, packed by the thousands, to the bucket of their language and first word.
2. A bucket sorts its suffixes in reverse lexicographic order.  A phrase is a prefix of a run of them, and its count is complete where the
   run ends: what one stack would hold as it reads on is, for each depth, a sum over runs.  Only frequent phrases leave a bucket.
3. Phrases are cut in two; the counts of the parts are joined to them.

A first word, pair, or longer prefix that is very common would fill its bucket.  Such prefixes are found first: the tasks report what fills
a part of 1 / SHARE of their words, so there are few.  Their suffixes are dealt by one more word each, and their own counts are summed over buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.llm.common import few, partitions, written

MAX_WORDS = 5
LEAST = 100
TOP = 2_000
#: Bytes of text that a task turns into suffixes at a time, about.
SLICE = 4_000_000
#: Suffixes of a bucket, about.
BUCKET = 1_000_000
#: A prefix is reported where it fills 1 / SHARE of a slice, and is hot where such reports fill 1 / (5 * SHARE) of all words.
SHARE = 200
#: Parts of a language's phrases in which the first are sought before they are among all.
PARTS = 256
UNKNOWN = "und"

#: What a byte is: 0 a part of a word, 1 a space between words, 2 an end of a piece.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
ENDS = [bytes([b]) for b in b".,;:!?\n\v\f\r"]
KINDS[[b[0] for b in ENDS]] = 2


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the number of each occurrence's word, and the number of the piece that it stands in.

    Texts are laid end to end with an end of piece between them, and every step works on all of their bytes at once.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    kinds = KINDS[raw]
    inside = kinds == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    letters, offsets = raw[inside], np.concatenate([[0], np.cumsum(ends - starts)])
    piece = np.cumsum(kinds == 2, dtype=np.int32)[starts]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), piece


def suffixes(words: np.ndarray, piece: np.ndarray, size: int = MAX_WORDS) -> np.ndarray:
    """For every word, the numbers (from 1) of it and those that follow in its piece, `size` in all; 0 stands behind the piece's end."""
    out = np.zeros((len(words), size), np.int32)
    for k in range(min(size, len(words))):
        n = len(words) - k
        out[:n, k] = np.where(piece[:n] == piece[k:], words[k:] + 1, 0)
    return out


def reverse_sorted(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct rows in reverse lexicographic order, their counts, and for each depth where a run of equal prefixes begins."""
    if rows.max(initial=0) < 1 << 21:  # three numbers fit into one: two keys are sorted by, in place of five
        packed = [sum(rows[:, k].astype(np.int64) << 21 * (2 - k % 3) for k in range(at, min(at + 3, rows.shape[1]))) for at in range(0, rows.shape[1], 3)]
    else:
        packed = list(rows.T)
    order = np.lexsort(packed[::-1])[::-1]
    rows, counts = rows[order], counts[order]
    changed = np.ones(rows.shape, bool)
    changed[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    first = np.flatnonzero(changed[:, -1])
    return rows[first], np.add.reduceat(counts, first) if len(first) else counts, [np.flatnonzero(changed[first, k]) for k in range(rows.shape[1])]


def prefix_counts(rows: np.ndarray, counts: np.ndarray, runs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth, one row for each prefix of so many words, and its count."""
    for k, begin in enumerate(runs):
        total = np.add.reduceat(counts, begin) if len(begin) else counts
        whole = rows[begin, k] > 0
        yield begin[whole], total[whole]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(rows: np.ndarray, distinct: list[bytes], lang: str) -> np.ndarray:
    """A hash of each prefix of each row, by language and words; a prefix that goes on behind the piece's end is another than one that ends."""
    of_word = np.array([0, *map(xxhash.xxh64_intdigest, distinct)], np.uint64)
    out = np.empty(rows.shape, np.uint64)
    h = np.full(len(rows), xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1), np.uint64)
    for k in range(rows.shape[1]):
        h = mixed(h + of_word[rows[:, k]])
        out[:, k] = h
    return out


def depths(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """How many words of each row name its bucket: one more than of its longest hot prefix, if all shorter ones are hot."""
    going = np.logical_and.accumulate(np.isin(hashes, hot), axis=1) if len(hot) else np.zeros(hashes.shape, bool)
    return np.minimum(going.sum(axis=1), hashes.shape[1] - 1)


def _cut(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of at most `size` bytes that end with pieces; only a piece that is longer itself makes a longer part."""
    at = 0
    while len(raw) - at > size:
        end = max(raw.rfind(b, at, at + size) for b in ENDS)
        if end < 0:
            end = min((x for b in ENDS if (x := raw.find(b, at + size)) >= 0), default=len(raw))
        yield raw[at : end + 1]
        at = end + 1
    yield raw[at:]


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of some `size` bytes each; what is left of all languages comes at the end."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            name = lang.as_py()
            for part in _cut(text.as_buffer().to_pybytes(), size):
                held.setdefault(name, []).append(part)
                sizes[name] = sizes.get(name, 0) + len(part) + 1
                total += len(part) + 1
                if total > 4 * size or sizes[name] > size:
                    largest = max(sizes, key=sizes.get)
                    total -= sizes.pop(largest)
                    yield largest, held.pop(largest)
    yield from held.items()


def _counted(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct words of some texts, their distinct suffixes in reverse order with counts, and the runs of prefixes."""
    distinct, words, piece = words_of(texts)
    return distinct.to_pylist(), *reverse_sorted(suffixes(words, piece), np.ones(len(words), np.int64))


def sizes_and_hot(docs: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """(lang, n) of each language, the number of all words, and the hashes of hot prefixes.

    A prefix that holds a part of 1 / SHARE + 1 / (5 * SHARE) of all words fills 1 / SHARE of slices that hold the rest of them, so none
    such is missed; at most 5 * SHARE for each depth are hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _slices(batches, SLICE):
            distinct, rows, counts, runs = _counted(texts)
            n = int(counts.sum())
            hashes = prefix_hashes(rows, distinct, lang)
            found = [(hashes[at, k], total) for k, (at, total) in enumerate(prefix_counts(rows, counts, runs)) if k < MAX_WORDS - 1]
            many = [(h[t * SHARE >= n], t[t * SHARE >= n]) for h, t in found]
            h, t = (np.concatenate(x) for x in zip(*many))
            yield pa.record_batch({"lang": pa.array([lang] * (len(h) + 1)), "hash": pa.array([None, *h.view(np.int64).tolist()], pa.int64()), "n": pa.array([n, *t.tolist()], pa.int64())})

    seen = written(docs.mapInArrow(run, "lang string, hash long, n long"), "reported")
    langs = written(seen.filter("hash IS NULL").groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"), "languages")
    total = langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = seen.filter("hash IS NOT NULL").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") * 5 * SHARE >= total)
    return langs, total, sorted(r["hash"] for r in hot.select("hash").collect())


def _packed(lang: str, distinct: list[bytes], rows: np.ndarray, counts: np.ndarray, bucket: np.ndarray, depth: np.ndarray) -> Iterator[dict]:
    """The suffixes of a slice for each bucket, with the words they use: numbers are of the row's own words.

    Suffixes stay in order and go column by column, in the narrowest kind of number, so that what is shuffled compresses well.
    """
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    names = np.array([b"", *distinct], object)
    for at, end in zip(cuts, [*cuts[1:], len(order)]):
        mine = order[at:end]
        used, numbers = np.unique(rows[mine], return_inverse=True)
        lead = int(used[0] != 0)  # number 0 is no word
        numbers = numbers.reshape(-1, MAX_WORDS) + lead
        kind = np.uint16 if len(used) < 1 << 16 else np.uint32
        most = np.uint8 if counts[mine].max() < 256 else np.int64
        yield {"bucket": int(bucket[mine[0]]), "lang": lang, "words": names[used[1 - lead :]].tolist(), "suffixes": numbers.T.astype(kind).tobytes(), "counts": counts[mine].astype(most).tobytes(), "depths": depth[mine].astype(np.uint8).tobytes()}


PACKED = "bucket long, lang string, words array<binary>, suffixes binary, counts binary, depths binary"
PACKED_ARROW = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("suffixes", pa.binary()), ("counts", pa.binary()), ("depths", pa.binary())])


def dealt(docs: DataFrame, buckets: int, hot: list[int]) -> DataFrame:
    """Suffixes of documents (lang, text), packed by bucket: a row holds what a slice has for a bucket, so there are no more rows than suffixes."""
    hot = np.array(hot, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _slices(batches, SLICE):
            distinct, rows, counts, _ = _counted(texts)
            if not len(rows):
                continue
            hashes = prefix_hashes(rows, distinct, lang)
            depth = depths(hashes, hot)
            bucket = (hashes[np.arange(len(rows)), depth] % np.uint64(buckets)).astype(np.int64)
            part = []
            for row in _packed(lang, distinct, rows, counts, bucket, depth):
                part.append(row)
                if len(part) == 256:
                    yield pa.RecordBatch.from_pylist(part, PACKED_ARROW)
                    part = []
            yield pa.RecordBatch.from_pylist(part, PACKED_ARROW)

    return docs.mapInArrow(run, PACKED)


def _bucket_counts(least: int):
    """Phrases of one bucket, by language: frequent ones, and prefixes shorter than the key, whose counts other buckets add to."""

    def one(lang: str, table: pa.Table) -> Iterator[pa.Table]:
        lists = table["words"].combine_chunks()
        words, firsts = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy()).cumsum()
        sorted_words = words.dictionary.to_pylist()
        rank = np.empty(len(sorted_words), np.int32)  # words by their bytes, so that the order of numbers is lexicographic
        rank[sorted(range(len(sorted_words)), key=sorted_words.__getitem__)] = np.arange(1, len(sorted_words) + 1)
        names = np.array([b"", *sorted(sorted_words)], object)
        of = rank[words.indices.to_numpy()] if len(sorted_words) else rank
        rows, counts, depth = [], [], []
        for begin, end, s, c, d in zip([0, *firsts[:-1]], firsts, table["suffixes"], table["counts"], table["depths"]):
            d = np.frombuffer(d.as_buffer(), np.uint8)
            c = np.frombuffer(c.as_buffer(), np.uint8 if c.as_buffer().size == len(d) else np.int64)
            numbers = np.frombuffer(s.as_buffer(), np.uint16 if s.as_buffer().size == 2 * MAX_WORDS * len(d) else np.uint32).reshape(MAX_WORDS, -1).T
            rows.append(np.concatenate([[0], of[begin:end]]).astype(np.int32)[numbers])
            counts.append(c.astype(np.int64))
            depth.append(d)
        rows, counts = np.concatenate(rows), np.concatenate(counts)
        # Depths ride along as a last column: equal suffixes have equal depths, so they split no run of the words.
        both, counts, runs = reverse_sorted(np.column_stack([rows, np.concatenate(depth).astype(np.int32)]), counts)
        rows, depth = both[:, :MAX_WORDS], both[:, MAX_WORDS]
        for k, (at, total) in enumerate(prefix_counts(rows, counts, runs[:MAX_WORDS])):
            keep = (total >= least) | (depth[at] > k)
            at, total = at[keep], total[keep]
            yield pa.table({"lang": pa.array([lang] * len(at), pa.string()), "phrase": pa.array([b" ".join(row[: k + 1]).decode("utf-8", "surrogatepass") for row in names[rows[at]]], pa.string()), "words": pa.array(np.full(len(at), k + 1), pa.int32()), "n": pa.array(total, pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        langs = table["lang"].to_pylist()
        parts = []
        for lang in sorted(set(langs)):
            parts += one(lang, table.filter(pa.array([x == lang for x in langs])))
        return pa.concat_tables(parts)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of every phrase of 1 to MAX_WORDS words with n >= least occurrences, and (lang, n) of all words.

    A-Z are lower-cased.  Pieces end at `.,;:!?` and at line feed to carriage return; words are what spaces and tabs separate in them.  All contiguous
    occurrences within pieces count, overlaps too.  A null lang is `und`, a null text empty.
    """
    docs = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    langs, total, hot = sizes_and_hot(docs)
    buckets = max(-(-total // BUCKET), partitions(docs))
    found = dealt(docs, buckets, hot).groupBy("bucket").applyInArrow(_bucket_counts(least), "lang string, phrase string, words int, n long")
    sums = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return written(sums, "phrases"), langs


def _with_count(rows: DataFrame, counts: DataFrame, phrase: str, name: str) -> DataFrame:
    """rows with the count of a phrase as a column.  Counts are broadcast if they are few; else the join's own shuffle is split where a common word is a part of many phrases."""
    right = counts.select("lang", F.col("phrase").alias(phrase), F.col("n").alias(name))
    return rows.join(F.broadcast(right) if few(counts, 200_000) else right, ["lang", phrase])


def score() -> Column:
    """floor(1000 * a * n / (l * r)) of four columns of counts; the products are whole decimals."""
    return F.expr("CAST(CAST(a AS decimal(20, 0)) * n * 1000 AS decimal(38, 0)) div (CAST(l AS decimal(19, 0)) * CAST(r AS decimal(19, 0)))").cast("long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = 100, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first `top` phrases of each language, (lang, rank, phrase, a, l, r, n, score).

    Candidates are phrases of 2 to MAX_WORDS words with a >= least occurrences.  A cut into a first part with l and a rest with r occurrences
    scores floor(1000 * a * n / (l * r)), n being all words of the language; the lowest cut counts, the earliest of those that tie.  A candidate goes
    if a longer one holds its words contiguously and 100 * its count >= percent * a.  Order: score and a descending, phrase by its bytes.

    Null texts and empty ones have no words; a null lang is `und`.  Rows that repeat count again.  Other columns are ignored; an empty table
    gives no rows.  Products are decimals of 38 digits, which hold counts up to 10 ** 11.
    """
    counts, langs = phrase_counts(docs, least, lang, text)
    candidates = counts.filter("words > 1").withColumn("parts", F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice("parts", at, size), " "))))
    longer = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("n").alias("within"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    rest = candidates.join(longer, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (100 * F.col("within") < percent * F.col("n")))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    rest = rest.select("lang", "phrase", "words", "parts", F.col("n").alias("a"), cut.alias("k"))
    rest = rest.withColumn("head", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ")).withColumn("tail", F.array_join(F.slice("parts", F.col("k") + 1, F.col("words")), " "))
    rest = _with_count(_with_count(rest.drop("parts", "words"), counts, "head", "l"), counts, "tail", "r")
    rest = rest.join(F.broadcast(langs) if few(langs, 100_000) else langs, "lang")
    best = rest.withColumn("score", score()).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First among the phrases of one salt, then among those that are left: no task sorts all phrases of a language.
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
