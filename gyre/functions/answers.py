"""Final answers: finding them in responses, reading gold answers, and exact comparison.

Patterns are written for Java with the rules of Unix lines, so that only a line feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gyre.functions.binding import let

# The token and marker patterns that define an answer.
TOKEN = r"[-+]?\d+(?:\.\d+)?(?:\s*/\s*[-+]?\d+)?"
BOXED = r"\\boxed\s*\{([^{}]+)\}"
MARKERS = (
    ("final_answer_marker", r"(?:^|\n)\s*final\s+answer\s*[:\-]\s*(.+?)(?:\n|$)"),
    ("answer_marker", r"(?:^|\n)\s*answer\s*[:\-]\s*(.+?)(?:\n|$)"),
    ("the_answer_is", r"(?:^|\n)\s*the\s+answer\s+is\s+(.+?)(?:\n|$)"),
)
GOLD_MARKER = r"####\s*([^\n\r]+)"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

CANDIDATE = "array<struct<strategy:string,raw:string,token:string>>"


def strip(text: Column) -> Column:
    """text without white space, in Unicode's sense, at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$(?!\n)", "")


#: What clean() takes off both ends, from without: white space, quotes, closing marks, opening brackets, white space.
_AROUND = (r"[\s\x1c-\x1f]", r"[`'\" ]", r"[.,;:!?)\]}>]", r"[(\[<{]", r"[\s\x1c-\x1f]")
_ANY = r"(?=[\s\x1c-\x1f`'\".,;:!?)\]}>(\[<{])"
ENDS = "(?U)^" + _ANY + "".join(f"{c}*+" for c in _AROUND) + "|" + _ANY + "".join(f"{c}*+" for c in _AROUND[::-1]) + r"\z"


def clean(fragment: Column) -> Column:
    """A fragment without the quotes, closing marks and opening brackets around it, taken off in that order."""
    return F.regexp_replace(fragment, ENDS, "")


def numeric_token(fragment: Column) -> Column:
    """The first number or fraction of a fragment, without white space; null if there is none.

    Nothing that clean() takes off the ends is part of a number, so the fragment need not be cleaned.
    """

    def read(token: Column) -> Column:
        return F.when(token == "", None).when(token.contains("/"), F.regexp_replace(token, r"(?U)\s+", "")).otherwise(token)

    return let(F.regexp_extract(fragment, "(?U)" + TOKEN, 0), read)


def candidates(text: Column) -> Column:
    """All answers that a response states, in the order of their strategies; the last line with text comes last.

    Plain searches tell first whether a pattern can match at all.
    """

    def all_of(strategy: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit("(?id)" + pattern if strategy != "boxed" else pattern), F.lit(1))
        return F.transform(F.transform(found, clean), lambda x: F.struct(F.lit(strategy).alias("strategy"), x.alias("raw"), numeric_token(x).alias("token")))

    none = F.array().cast(CANDIDATE)
    boxed = F.when(text.contains("\\boxed"), all_of("boxed", BOXED)).otherwise(none)
    marked = F.when(F.lower(text).contains("answer"), F.concat(*[all_of(*marker) for marker in MARKERS])).otherwise(none)
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), strip), lambda x: x != "")
    last = F.transform(F.slice(F.reverse(lines), 1, 1), lambda x: F.struct(F.lit("trailing_numeric").alias("strategy"), clean(x).alias("raw"), numeric_token(x).alias("token")))
    return F.filter(F.concat(boxed, marked, last), lambda c: c["token"].isNotNull())


def extract(text: Column) -> Column:
    """The final answer of a response: struct of answer, token, ok, strategy and failure.

    No candidate fails, and so do candidates with different tokens (as text: 1 and 1.0 differ).  A null or blank
    response is `empty_output`.
    """

    def read(state: Column) -> Column:
        blank, found, tokens = state["blank"], state["found"], state["tokens"]
        one = ~blank & (tokens == 1)
        last = F.get(F.when(one, found), F.size(found) - 1)
        return F.struct(
            last["raw"].alias("answer"),
            last["token"].alias("token"),
            F.coalesce(one, F.lit(False)).alias("ok"),
            F.when(blank | (tokens == 0), "none").when(tokens > 1, "ambiguous").otherwise(last["strategy"]).alias("strategy"),
            F.when(blank, "empty_output").when(tokens == 0, "no_numeric_candidate").when(tokens > 1, "multiple_candidate_answers").alias("failure"),
        )

    def count(found: Column) -> Column:
        blank = ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
        return F.struct(found.alias("found"), F.size(F.array_distinct(F.transform(found, lambda c: c["token"]))).alias("tokens"), blank.alias("blank"))

    return let(let(candidates(text), count), read)


def gold_token(text: Column) -> Column:
    """The number of a gold answer: after the marker if there is one with a number, else the first of the text."""
    return F.coalesce(numeric_token(F.regexp_extract(text, "(?d)" + GOLD_MARKER, 1)), numeric_token(text))


def rational(token: Column) -> Column:
    """A token as an exact struct (num, den) of decimals; null where it is none: a zero denominator, a point in a
    fraction, or more than 18 digits on a side."""
    top, bottom, point = F.split_part(token, F.lit("/"), F.lit(1)), F.split_part(token, F.lit("/"), F.lit(2)), F.split_part(token, F.lit("."), F.lit(2))
    whole = token.rlike(r"^[-+]?\d{1,18}/[-+]?\d{1,18}$") & ~bottom.rlike(r"^[-+]?0+$")
    plain = token.rlike(r"^[-+]?\d+(\.\d+)?$") & (F.length(F.translate(token, "-+.", "")) <= 18)

    def exact(num: Column, den: Column) -> Column:
        return F.struct(num.try_cast("decimal(18,0)").alias("num"), den.try_cast("decimal(18,0)").alias("den"))

    number = exact(F.replace(token, F.lit("."), F.lit("")), F.rpad(F.lit("1"), F.length(point) + 1, F.lit("0")))
    return F.when(token.contains("/"), F.when(whole, exact(top, bottom))).when(plain, number)


def _plain(token: Column) -> Column:
    """A long decimal number in one form: no plus, no zeros that say nothing."""
    bare = F.regexp_replace(token, r"^\+", "")
    bare = F.when(bare.contains("."), F.regexp_replace(bare, r"\.?0+$", "")).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(bare, r"^(-?)0+(?=\d)", "$1"), r"^-0$", "0")


def _is_number(token: Column, value: Column) -> Column:
    return F.coalesce(value.isNotNull() | token.rlike(r"^[-+]?\d+(\.\d+)?$"), F.lit(False))


def is_number(token: Column) -> Column:
    """Whether a token has an exact value (a decimal of any length, or a fraction that rational() can hold)."""
    return _is_number(token, rational(token))


def _same_value(a: Column, b: Column, x: Column, y: Column) -> Column:
    same = F.when(x.isNotNull() & y.isNotNull(), x["num"] * y["den"] == y["num"] * x["den"]).otherwise(_plain(a) == _plain(b))
    return F.coalesce(same, F.lit(False))


def same_value(a: Column, b: Column) -> Column:
    """Whether two tokens are the same exact number, by cross multiplication; long decimals are compared as text."""
    return let(F.struct(rational(a).alias("x"), rational(b).alias("y")), lambda v: _same_value(a, b, v["x"], v["y"]))


def label(token: Column, gold: Column) -> Column:
    """gold_parse_failure, prediction_parse_failure, correct or incorrect, the first that holds.  Either value is read once."""

    def said(v: Column) -> Column:
        out = F.when(~_is_number(gold, v["y"]), "gold_parse_failure").when(~_is_number(token, v["x"]), "prediction_parse_failure")
        return out.when(_same_value(token, gold, v["x"], v["y"]), "correct").otherwise("incorrect")

    return let(F.struct(rational(token).alias("x"), rational(gold).alias("y")), said)
