"""Deterministic scores, ids and orders from SHA-256, and a stand-in judge that is a pure function of its input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gyre.functions.binding import let


def _digits(digest: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digest, start, n), 16, 10).cast("long")


def unit_score(seed: Column, branch: Column, generation: Column, example: Column, tag: str) -> Column:
    """A number in [0, 1) from the first 12 hexadecimal digits of SHA-256 of the parts, joined by bars."""
    digest = F.sha2(F.concat_ws("|", seed.cast("string"), branch, generation.cast("string"), example, F.lit(tag)), 256)
    return _digits(digest, 1, 12).cast("double") / F.lit(float(16**12))


def stable_id(name: Column, question: Column, answer: Column) -> Column:
    """name, a low line and 16 hexadecimal digits of its own, the question's and the answer's trimmed text."""
    return F.concat(name, F.lit("_"), F.substring(F.sha2(F.concat_ws("\n", F.trim(name), F.trim(question), F.trim(answer)), 256), 1, 16))


def hash_order(purpose: str, *parts: Column) -> Column:
    """A key whose order is a reproducible shuffle, for each purpose another."""
    return F.sha2(F.concat_ws("|", F.lit(purpose), *[p.cast("string") for p in parts]), 256)


def mock_judgement(question: Column, gold: Column, response: Column) -> Column:
    """Rubric scores taken from the digest of the input as a 256-bit number h: h, h >> 2, h >> 4 and h >> 6 modulo 3; silent if 7 divides h.

    The number is read as digits of 60 bits, from the right: 2 ** 60 is 1 modulo 21, so their sum stands for it, and a shift by an even number
    of bits only takes off the bits shifted out, as 4 is 1 modulo 3.  Digest, digits and their sum are each bound once.
    """

    def digits(digest: Column) -> Column:
        last = _digits(digest, 50, 15)
        return F.struct((last % 64).cast("int").alias("low"), ((_digits(digest, 1, 4) + _digits(digest, 5, 15) + _digits(digest, 20, 15) + _digits(digest, 35, 15) + last) % 21).cast("int").alias("all"))

    def sums(h: Column) -> Column:
        part = [F.pmod(h["all"] - h["low"] % (1 << bits), F.lit(3)).cast("int").alias(f"p{bits}") for bits in (0, 2, 4, 6)]
        return F.struct(*part, (h["all"] % 7 == 0).alias("silent"))

    def scores(x: Column) -> Column:
        names = ("clarity", "structure", "terminology", "reasoning_soundness")
        total = x["p0"] + x["p2"] + x["p4"] + x["p6"]
        return F.struct(*[x[f"p{bits}"].alias(name) for bits, name in zip((0, 2, 4, 6), names)], total.alias("overall_pedagogical_score"), x["silent"].alias("is_silent_error"))

    return let(let(let(F.sha2(F.concat_ws("\n", question, gold, response), 256), digits), sums), scores)
