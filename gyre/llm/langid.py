"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics.

Each language has a tree of byte contexts up to ORDER bytes deep.  The code length of a byte is found in its
longest known context; where the byte was never seen there, the escape probability of that context is paid
and the next shorter context is asked (PPM method C: a context with d different followers in n
observations escapes with d / (n + d)).  A text's language is that whose model codes it in the fewest bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.llm.common import few, written

#: Bytes of context.  With the byte itself they fill 32 bits.
ORDER = 3
#: Documents to learn a language from, about: each is taken by a hash of its text with the chance that gives so many.
DOCS_PER_LANGUAGE = 1_500
#: Characters of these documents, about: where texts are long, fewer are taken.
CHARS_PER_LANGUAGE = 30_000_000
#: Characters that all languages together learn from, and distinct byte sequences of all of them, at most.
CHARS_IN_ALL, MAX_GRAMS = 120_000_000, 20_000_000
#: Languages at most.  Each is a model that every worker holds.
MAX_LANGUAGES = 512
#: Grams whose code lengths a worker remembers.
REMEMBERED = 1_000_000
#: Characters that are scored at a time, about.
SLICE_CHARS = 250_000


def gram_slices(text: str, size: int = SLICE_CHARS) -> Iterator[np.ndarray]:
    """Each byte of a text with the ORDER bytes before it, as 32 bits, for `size` bytes at a time; a text begins after line feeds."""
    raw = b"\n" * ORDER + text.encode("utf-8", "surrogatepass")
    for at in range(ORDER, max(len(raw), ORDER + 1), size):
        part = np.frombuffer(raw, np.uint8, min(size, len(raw) - at) + ORDER, at - ORDER).astype(np.uint32)
        out = part[ORDER:].copy()
        for back in range(1, ORDER + 1):
            out |= part[ORDER - back : len(part) - back] << np.uint32(8 * back)
        yield out


def grams(text: str) -> np.ndarray:
    """gram_slices of a whole text."""
    return np.concatenate(list(gram_slices(text)))


def gram_counts(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): how often each language's texts hold each gram.  Rows with a null lang or text are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("lang"):
                found, n = np.unique(np.concatenate([grams(t) for t in rows["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": found.astype(np.int64), "n": n})

    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """The context tree of one language: sorted grams and contexts of each order with their code lengths in bits."""

    def __init__(self, found: np.ndarray, n: np.ndarray) -> None:
        self.orders = []
        for order in range(ORDER, -1, -1):
            keys, back = np.unique(found & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen = np.bincount(back, n)
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(of, seen), np.bincount(of)
            bits = np.log2(total + kinds)[of] - np.log2(seen)
            self.orders.append((order, keys, bits.astype(np.float32), contexts, (np.log2(total + kinds) - np.log2(kinds)).astype(np.float32)))

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte after the bytes before it."""
        out, open_ = np.zeros(len(wanted), np.float32), np.ones(len(wanted), bool)
        for order, keys, bits, contexts, escapes in self.orders:
            part = wanted & np.uint32((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = open_ & (keys[at] == part)
            out[hit] += bits[at[hit]]
            open_ &= ~hit
            context = part >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            miss = open_ & (contexts[at] == context)
            out[miss] += escapes[at[miss]]
        out[open_] += 8
        return out


class Model:
    """Trees of several languages, and the code lengths of grams that have been asked for."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.languages = sorted(counts["lang"].unique())
        self.counts = {name: (rows["gram"].to_numpy(np.uint32), rows["n"].to_numpy(np.float64)) for name, rows in counts.groupby("lang")}
        self.trees: list[Tree] = []
        self.known, self.costs = np.empty(0, np.uint32), np.empty((0, 0), np.float32)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "counts": self.counts, "trees": [], "known": np.empty(0, np.uint32), "costs": np.empty((0, 0), np.float32)}

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code lengths of sorted, distinct grams: a row for each gram, a column for each language."""
        if not self.trees:
            self.trees = [Tree(*self.counts[name]) for name in self.languages]
            self.costs = np.empty((0, len(self.languages)), np.float32)
        if len(self.known) > REMEMBERED:
            self.known, self.costs = self.known[:0], self.costs[:0]
        new = np.setdiff1d(wanted, self.known, assume_unique=True)
        if len(new):
            costs = np.stack([tree.bits(new) for tree in self.trees], axis=1)
            order = np.argsort(np.concatenate([self.known, new]), kind="stable")
            self.known, self.costs = np.concatenate([self.known, new])[order], np.concatenate([self.costs, costs])[order]
        return self.costs[np.searchsorted(self.known, wanted)]

    def score(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language; a text of more than SLICE_CHARS is scored slice by slice."""
        if len(texts) == 1:
            return sum(self._bits([part]) for part in gram_slices(texts[0]))
        return self._bits([grams(t) for t in texts])

    def _bits(self, parts: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(p) for p in parts])
        tagged = np.sort(np.concatenate(parts).astype(np.uint64) | np.repeat(np.arange(len(parts), dtype=np.uint64) << np.uint64(32), sizes))
        starts = np.flatnonzero(np.concatenate([[True], tagged[1:] != tagged[:-1]]))
        times = np.diff(np.concatenate([starts, [len(tagged)]]))
        kinds = tagged[starts]
        wanted, back = np.unique((kinds & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_inverse=True)
        costs = self.bits(wanted)[back].astype(np.float64) * times[:, None]
        owner = (kinds >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        return np.add.reduceat(costs, first, axis=0)


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", per_language: int = DOCS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE, in_all: int = CHARS_IN_ALL) -> Model | None:
    """A model of the languages in the rows where `learn` holds; None if they name no language.

    About `per_language` distinct texts of each language are learnt, of `chars` characters in all or four texts, chosen by
    their hash.  `in_all` bounds the characters of all languages together, each having an equal part of it: this bounds the statistics, which the
    driver gathers and every worker holds.  They are counted first, and more than MAX_GRAMS are refused.  A text with many copies is one text, so a language
    that consists of copies is learnt too.  More than MAX_LANGUAGES values of lang are refused: each is a model that
    every worker holds, so such a column wants cleaning first.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), learn.alias("learn")).filter("learn AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    kinds = rows.groupBy("lang", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).agg(F.first(F.length("text")).alias("n"))
    sizes = written(kinds.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("chars")), "sizes")
    if not few(sizes, MAX_LANGUAGES):
        raise ValueError(f"more than {MAX_LANGUAGES} languages; pass a cleaner column")
    chars = min(chars, in_all // max(1, sizes.count()))
    unit = (F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double")) / float(1 << 53)
    drawn = (unit * F.col("docs") < per_language) & ((unit * F.col("chars") < chars) | (unit * F.col("docs") < 4))
    chosen = rows.join(F.broadcast(sizes), "lang").filter(drawn).dropDuplicates(["lang", "text"])
    counts = written(gram_counts(chosen), "grams")
    if not few(counts, MAX_GRAMS):
        raise ValueError(f"more than {MAX_GRAMS} distinct byte sequences to learn; pass fewer characters")
    counts = counts.toPandas()
    return Model(counts) if len(counts) else None


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and bits_per_byte.

    A null text, a text without a letter and, without a model, every text is `und` with score 0 and null
    bits_per_byte.  score: the best language's share of 2 ** -bits, with the bits taken over 64 bytes of
    average text, or over all of a shorter one.  Ties go to the language that sorts first.  No row is dropped; columns of
    these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        out = [("und", 0.0, None)] * len(texts)
        if own is not None:
            good = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            at = 0
            while at < len(good):
                part, size = [], 0
                while at < len(good) and (not part or size + len(texts.iat[good[at]]) < SLICE_CHARS):
                    part.append(good[at])
                    size += len(texts.iat[good[at]])
                    at += 1
                chosen = [texts.iat[i] for i in part]
                for i, t, bits in zip(part, chosen, own.score(chosen)):
                    n = len(t.encode("utf-8", "surrogatepass"))
                    best = int(bits.argmin())
                    share = 1 / np.exp2((bits[best] - bits) / n * min(n, 64)).sum()
                    out[i] = (own.languages[best], float(share), float(bits[best] / n))
        return pd.DataFrame(out, columns=["lang_pred", "score", "bits_per_byte"])

    # Not deterministic in name only: else a filter on the result is pushed below it, and every text is scored twice.
    return docs.withColumn("_said", run.asNondeterministic()(F.col(text))).withColumns({name: F.col(f"_said.{name}") for name in ("lang_pred", "score", "bits_per_byte")}).drop("_said")
