"""Documents scored by the difference of two language models: one of a target set, one of the background.

Both are word bigram models over one vocabulary, all lower-cased words of the documents, smoothed alike: the background's
smoothing is scaled by how much larger it is, so that it trusts its pairs as far as the target model does.  What a document
adds to the counts itself is left out when it is scored.

Words and pairs are counted each for itself, under 64-bit keys, over all documents.  Documents are dealt into blocks; a
block adds up its own keys and sends them to buckets, which are ranges of keys; a bucket adds up what the blocks sent and
answers each block with the totals of its keys; then the block scores its documents.  So a frequent word is one key of each
block, and no task has more than a block or a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.llm.common import lowered, small, words_of

#: The weight of the unigram in a bigram's probability, in observations, and of each word in a unigram's: for the target model.
PRIOR, WORD_PRIOR = 8.0, 0.5
#: Bytes of text of a block, and blocks whose keys a bucket holds at a time, both about.
BLOCK, BLOCKS_A_BUCKET = 8 << 20, 2
WORDS_KEPT = 200_000
#: What stands before a text's first word.
MARK = np.uint64(0x9E3779B97F4A7C15)
NAMES = ("n_tokens", "target_loss", "background_loss", "score")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WordIds(dict):
    """The key of each word; a bounded number of words is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = value
        return value


_ids = WordIds()


def tokens(text: str | None) -> np.ndarray:
    """Keys of a text's words, A-Z lower-cased; a null text has none."""
    return np.fromiter(map(_ids.__getitem__, words_of(lowered(text))), np.uint64)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of some arrays, sorted, and the place of each value in them.

    What np.unique gives of the arrays in a row, in a third of the memory: places are of 32 bits, and `parts` is emptied.
    """
    values = np.concatenate(parts)
    parts.clear()
    order = np.argsort(values)
    values = values[order]
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    values = values[first]
    at = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    number = np.cumsum(first, dtype=at.dtype)
    number -= 1
    at[order] = number
    return values, at


class Keyed:
    """The words of some texts: of each, its text and its place in the sorted keys, and those of its pair and of the word before it."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        found = [tokens(text.as_py()) for text in texts]
        self.sizes = np.array([len(x) for x in found], np.int64)
        words = np.concatenate([np.empty(0, np.uint64), *found])
        self.doc = np.repeat(np.arange(len(found), dtype=np.int32), self.sizes)
        del found
        self.first = np.flatnonzero(np.diff(self.doc, prepend=-1))
        before = np.roll(words, 1)
        before[self.first] = MARK
        parts = [words, _stirred(_stirred(before + np.uint64(1)) ^ words), np.full(len(self.first), MARK)]
        n = len(words)
        del words, before
        self.keys, at = _distinct(parts)
        self.word, self.pair, mark = at[:n], at[n : 2 * n], at[2 * n :]
        self.last = np.roll(self.word, 1)
        self.last[self.first] = mark

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How often the chosen rows hold each key; the mark counts once a text."""
        chosen = rows[self.doc].astype(np.float64)
        out = np.bincount(self.word, chosen, len(self.keys)) + np.bincount(self.pair, chosen, len(self.keys))
        return (out + np.bincount(self.last[self.first], chosen[self.first], len(self.keys))).astype(np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often the text of each word holds that word, its pair and the word before it (the mark: once)."""
        own, own_pair = (self._within(at) for at in (self.word, self.pair))
        last = np.roll(own, 1)
        last[self.first] = 1
        return own, own_pair, last

    def _within(self, at: np.ndarray) -> np.ndarray:
        """How often the text of each word holds the key at its place."""
        _, same = _distinct([self.doc.astype(np.int64) * len(self.keys) + at])
        return np.bincount(same)[same].astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers: how many bytes the largest takes, then all first bytes, all second bytes and so on, which puts what is equal together for the codecs of Spark."""
    x = x.astype(np.uint64)
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.uint64).reshape(-1)


def _cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted keys fall in, by their upper halves."""
    at = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    found, start = np.unique(at, return_index=True)
    return list(zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(keys)]))


ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("n_background", pa.binary()), ("n_target", pa.binary())])
TOLD = pa.schema([("of", pa.int64()), ("bucket", pa.int64()), ("n_background", pa.binary()), ("n_target", pa.binary())])


def _flags(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(bool)


def _ask(buckets: int, text: str):
    def run(docs: pa.Table) -> pa.Table:
        """A block's distinct keys with its counts of them, one row a bucket; keys as differences."""
        own = Keyed(docs[text])
        counted, target = _flags(docs, "_counted"), _flags(docs, "_target")
        n, m = own.counts(counted), own.counts(counted & target)
        rows = [(docs["_block"][0].as_py(), b, _packed(np.diff(own.keys[i:j], prepend=np.uint64(0))), _packed(n[i:j]), _packed(m[i:j])) for b, i, j in _cuts(own.keys, buckets)]
        return pa.Table.from_pylist([dict(zip(ASKED.names, row)) for row in rows], ASKED)

    return run


def _tell(asked: pa.Table) -> pa.Table:
    """A bucket's totals, for each block those of the keys that it sent."""
    keys = [np.cumsum(_unpacked(raw.as_py()), dtype=np.uint64) for raw in asked["keys"]]
    ends = np.cumsum([0, *map(len, keys)])
    every, at = _distinct(keys)
    out = {"of": asked["block"], "bucket": asked["bucket"]}
    for name in ("n_background", "n_target"):
        total = np.zeros(len(every), np.int64)
        for i, j, raw in zip(ends, ends[1:], asked[name]):
            total[at[i:j]] += _unpacked(raw.as_py()).astype(np.int64)  # a block's keys are distinct
        out[name] = pa.array([_packed(total[at[i:j]]) for i, j in zip(ends, ends[1:])], pa.binary())
    return pa.table(out).cast(TOLD)


def _score(docs: pa.Table, told: pa.Table, text: str, sizes: tuple[int, int, int]) -> pa.Table:
    """The rows of a block with NAMES."""
    own, told = Keyed(docs[text]), told.sort_by("bucket")
    *totals, vocabulary = sizes
    counted, target = _flags(docs, "_counted"), _flags(docs, "_target")
    own_word, own_pair, own_last = own.own()
    out = {"n_tokens": pa.array(own.sizes)}
    for name, total, rows in (("background_loss", totals[0], counted), ("target_loss", totals[1], counted & target)):
        scale = total / totals[1] if totals[0] and totals[1] else 1.0
        n = np.concatenate([np.empty(0, np.uint64), *map(_unpacked, told[f"n_{name[:-5]}"].to_pylist())]).astype(np.float64)
        mine = rows[own.doc]
        unigram = (n[own.word] - own_word * mine + WORD_PRIOR * scale) / (total - own.sizes[own.doc] * mine + WORD_PRIOR * scale * vocabulary)
        chance = (n[own.pair] - own_pair * mine + PRIOR * scale * unigram) / (n[own.last] - own_last * mine + PRIOR * scale)
        bits = np.bincount(own.doc, -np.log2(chance), len(own.sizes)) / np.maximum(own.sizes, 1)
        out[name] = pa.array(bits, pa.float64(), mask=own.sizes == 0)
    out["score"] = pa.compute.subtract(out["target_loss"], out["background_loss"])
    docs = docs.drop_columns(["_block", "_target", "_counted"])
    for name in NAMES:
        docs = docs.append_column(name, out[name])
    return docs


def sizes_of(rows: DataFrame, text: str = "text") -> tuple[int, int, int, int]:
    """Of rows (text, _target, _counted): counted words, those of the target, distinct words of all rows, and bytes in words.

    Distinct words are counted by a sketch, to a hundredth: the number only scales the smoothing, of both models alike.
    """
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    words = rows.select("_target", "_counted", F.explode(words).alias("word")).filter("word <> ''")
    n = [F.count_if(F.col("_counted")), F.count_if(F.col("_counted") & F.col("_target")), F.approx_count_distinct("word", 0.01), F.sum(F.octet_length("word") + 1)]
    return tuple(x or 0 for x in words.agg(*n).first())


def scored(docs: DataFrame, target: str = "target", text: str = "text", counted: Column | None = None) -> DataFrame:
    """docs with n_tokens, target_loss, background_loss (bits a word) and score, their difference: low is like the target.

    Every row counts for the background, rows whose `target` is true for the target as well; rows where `counted` is not true
    are scored only.  Texts without words, and null texts, have 0 tokens and nulls; a null target is false.  Repeated rows
    each count.  Without a target, its model gives all words the same chance.  A very long text is a block of its own.  No
    row is dropped; columns of these names are replaced; an empty table gives no rows.
    """
    kept = docs.drop(*NAMES)
    flag = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    rows = kept.withColumns({"_target": F.coalesce(F.col(target), F.lit(False)), "_counted": flag})
    *sizes, size = sizes_of(rows, text)
    blocks = max(1, size // BLOCK)
    spread = [c for c, kind in kept.dtypes if kind in ("string", "bigint", "int") and c != text]
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(text, *spread), F.lit(blocks)))
    asked = rows.groupBy("_block").applyInArrow(_ask(max(1, blocks // BLOCKS_A_BUCKET), text), "block long, bucket long, keys binary, n_background binary, n_target binary")
    told = asked.groupBy("bucket").applyInArrow(_tell, "of long, bucket long, n_background binary, n_target binary")
    schema = T.StructType([*kept.schema, *[T.StructField(name, T.LongType() if name == "n_tokens" else T.DoubleType()) for name in NAMES]])
    return rows.groupBy("_block").cogroup(told.groupBy("of")).applyInArrow(lambda left, right: _score(left, right, text, tuple(sizes)), schema)


def with_target(docs: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """docs with `target`: whether a row of labels (doc_id, quality) calls the document good.  Null ids are not good."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    return docs.join(small(good), F.col(doc) == F.col("_good"), "left").withColumn("target", F.col("_good").isNotNull()).drop("_good")
