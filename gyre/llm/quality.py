"""Quality rules as a ledger: each rule is evaluated once, and its failure is one bit.

The ledger holds the measurements and the bits of every document.  A policy is a version with a mask; it
rejects a document if a masked bit is set.  New policies and ablations need only the bits, not the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SYMBOLS = re.compile(rb"[#*$%&|<>]")
WORDS = re.compile(rb"[^ \t-\r]+")
#: Letters of all scripts, and those of ASCII.
LETTERS, PLAIN = regex.compile(r"\p{L}+"), re.compile(r"[A-Za-z]+")
#: Bytes from which a text's words are numbered instead of held.
LONG = 1_000_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the list holds twice or more, each word counted once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    return _covered(np.fromiter((seen[w] > 1 for w in windows), bool, len(windows)))


def _covered(again: np.ndarray) -> int:
    covered = np.zeros(len(again) + 2, bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def _repeated_ids(ids: np.ndarray) -> int:
    """What repeated() counts, of words by number: windows are numbered word by word, so that no two share a number."""
    if len(ids) < 3:
        return 0
    pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    _, which, n = np.unique(pairs[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    return _covered(n[which] > 1)


def _words_of(raw: bytes) -> tuple[int, int, int]:
    """Words, bytes in words and repeated words of a text."""
    if len(raw) < LONG:
        words = raw.split()  # on ASCII white space, which is what ends a word
        return len(words), sum(map(len, words)), repeated(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(m[0], len(numbers)) for m in WORDS.finditer(raw)), np.int64)
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    return len(ids), int(np.bincount(ids, minlength=len(numbers)) @ sizes), _repeated_ids(ids)


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; a null text has no words and no lines.

    n_lines: lines with a word; n_dup_lines: those equal to an earlier one.  n_repeat_words: words that lie
    in a window of three words which the text holds twice or more, each word counted once.  n_letters: characters
    that Unicode calls letters.  A text of LONG bytes or more is held once, and its words as numbers.
    """
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    n_words, word_bytes, repeats = _words_of(raw)
    word_chars = len(text) - (len(raw) - word_bytes)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = sum(map(len, (PLAIN if len(raw) == len(text) else LETTERS).findall(text)))
    return n_words, word_chars, len(SYMBOLS.findall(raw)), len(lines) - len(set(lines)), repeats, len(lines), letters


def measured(text: Column) -> Column:
    """MEASURES of each text, as a struct."""

    @pandas_udf(", ".join(f"{name} long" for name in MEASURES))
    def rows(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(text) for text in texts], columns=list(MEASURES), dtype="int64")

    return rows(text)


@dataclass(frozen=True)
class Rule:
    """A rule fails where the expression over MEASURES is true.  Its place in the list is its bit."""

    name: str
    fails: str


#: All comparisons are between whole numbers, so that no engine rounds them.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("letters", "2 * n_letters < word_chars"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        unknown = set(self.rules) - {rule.name for rule in rules}
        if unknown:
            raise ValueError(f"policy {self.version} names unknown rules: {sorted(unknown)}")
        return sum(1 << bit for bit, rule in enumerate(rules) if rule.name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
FULL = Policy("full", tuple(rule.name for rule in RULES))


def ledger(df: DataFrame, text: str = "text", bits: str = "failed_bits", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with MEASURES and the failure bits.  Texts may be null (all measures 0); no row is dropped.

    Columns of these names that df already has are replaced.
    """
    out = df.withColumn("_measured", measured(F.col(text))).withColumns({name: F.col(f"_measured.{name}") for name in MEASURES}).drop("_measured")
    flags = [F.when(F.expr(rule.fails), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(rules)]
    total = flags[0]
    for flag in flags[1:]:
        total = total.bitwiseOR(flag)
    return out.withColumn(bits, total.cast("long"))


def passes(policy: Policy, bits: str = "failed_bits", rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a policy keeps a row of the ledger."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablation(ledger_df: DataFrame, policy: Policy, bits: str = "failed_bits", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that it alone rejects.

    The ledger is first counted by its bits, of which there are at most 2 ** len(rules) values, so that the
    shuffle carries no documents.  An empty ledger gives a row of zeros for each rule.
    """
    mask = policy.mask(rules)
    counts = ledger_df.groupBy(F.col(bits).bitwiseAND(F.lit(mask)).alias("_bits")).agg(F.count("*").alias("_n"))
    named = [(bit, rule.name) for bit, rule in enumerate(rules) if rule.name in policy.rules]
    sums = []
    for bit, name in named:
        sums += [
            F.sum(F.when(F.col("_bits").bitwiseAND(F.lit(1 << bit)) != 0, F.col("_n")).otherwise(0)).alias(f"_f{bit}"),
            F.sum(F.when(F.col("_bits") == (1 << bit), F.col("_n")).otherwise(0)).alias(f"_o{bit}"),
        ]
    rows = F.array(*[F.struct(F.lit(policy.version).alias("policy"), F.lit(name).alias("rule"), F.coalesce(F.col(f"_f{bit}"), F.lit(0)).cast("long").alias("n_failed"), F.coalesce(F.col(f"_o{bit}"), F.lit(0)).cast("long").alias("n_only")) for bit, name in named])
    return counts.agg(*sums).select(F.inline(rows))
