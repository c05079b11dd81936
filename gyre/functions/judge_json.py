"""Judge payloads: finding the JSON object in a reply, repairing it in safe ways, and checking it.

The reply is scanned once in Python, batch by batch, only to cut out the balanced object; what it holds is then read and
checked by column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rubric's keys.
SUB_SCORES = ("clarity", "structure", "terminology", "reasoning_soundness")
KEYS = (*SUB_SCORES, "overall_pedagogical_score", "is_silent_error", "comment")
PAIR_KEYS = ("winner", "confidence", "reason")

#: A string, with its end if it has one, or a brace.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}]', re.DOTALL)


def balanced_object(text: str | None) -> tuple[str | None, str | None]:
    """The first balanced {...} of a text and how it was found: direct, embedded, truncated (closed here) or None.

    Braces inside strings do not count.  An object that ends too early is closed only if all rubric keys stand in it.
    """
    body = (text or "").strip()
    start = body.find("{")
    if start < 0:
        return None, None
    depth, quoted = 0, False
    for token in TOKEN.finditer(body, start):
        mark = token[0]
        if mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
            if not depth:
                return body[start : token.end()], "direct" if (start, token.end()) == (0, len(body)) else "embedded"
        else:
            quoted = not token[1]
    rest = body[start:]
    if all(f'"{key}"' in rest for key in KEYS):
        return rest + '"' * quoted + "}" * depth, "truncated"
    return None, None


def json_object(reply: Column) -> Column:
    """(body, found) of each reply: see balanced_object."""

    @F.pandas_udf("body string, found string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([balanced_object(t) for t in texts], columns=["body", "found"])

    return scan(reply)


def safe_int(text: Column) -> Column:
    """Whole numbers, also as strings or with a zero fraction; anything else, true and false too, is null."""
    return F.when(text.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.regexp_replace(F.trim(text), r"\.0*$", "").try_cast("int"))


def safe_bool(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)) == "true", True).when(F.lower(F.trim(text)) == "false", False)


def judge_payload(body: Column) -> Column:
    """A rubric payload as a struct: error (null if it holds), the scores, and repairs joined by bars.

    Missing and unknown keys are errors, but for a key `type` of value `object`; sub-scores lie in 0 to 2; a total that is
    not their sum is replaced by it.
    """
    values = F.from_json(body, "map<string,string>")
    keys = F.map_keys(values)
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in KEYS]))
    typed = (F.size(extra) == 1) & (F.get(extra, F.lit(0)) == "type") & (F.lower(values["type"]) == "object")
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in KEYS]), keys)) > 0
    parts = {k: safe_int(values[k]) for k in SUB_SCORES}
    said, silent = safe_int(values["overall_pedagogical_score"]), safe_bool(values["is_silent_error"])
    total = sum(list(parts.values())[1:], parts[SUB_SCORES[0]])
    bad_type = silent.isNull() | said.isNull()
    bad_range = F.lit(False)
    for p in parts.values():
        bad_type, bad_range = bad_type | p.isNull(), bad_range | ~p.between(0, 2)
    error = (
        F.when(values.isNull() | (F.size(values) == 0), "no_json_object").when(missing, "missing_keys").when((F.size(extra) > 0) & ~typed, "unknown_keys")
        .when(bad_type, "wrong_type").when(bad_range, "out_of_range")
    )
    repairs = F.concat_ws("|", F.when(typed, F.lit("dropped_type")), F.when(said != total, F.lit("recomputed_overall")))
    fine = error.isNull()
    return F.struct(
        error.alias("error"), *[F.when(fine, p).alias(k) for k, p in parts.items()], F.when(fine, total).alias("overall_pedagogical_score"),
        F.when(fine, silent).alias("is_silent_error"), F.when(fine, values["comment"]).alias("comment"), F.when(fine, repairs).alias("repairs"),
    )


def pair_payload(body: Column) -> Column:
    """A comparison's payload: winner (A, B or Tie), confidence in 0 to 2 and a reason that is not blank, or an error."""
    values = F.from_json(body, "map<string,string>")
    keys, wanted = F.map_keys(values), F.array(*[F.lit(k) for k in PAIR_KEYS])
    winner = F.initcap(F.trim(values["winner"]))
    confidence = safe_int(values["confidence"])
    error = (
        F.when(values.isNull() | (F.size(values) == 0), "no_json_object").when(F.size(F.array_except(wanted, keys)) > 0, "missing_keys")
        .when(F.size(F.array_except(keys, wanted)) > 0, "unknown_keys").when(~F.coalesce(winner.isin("A", "B", "Tie"), F.lit(False)), "bad_winner")
        .when(~F.coalesce(confidence.between(0, 2), F.lit(False)), "bad_confidence").when(F.coalesce(F.trim(values["reason"]), F.lit("")) == "", "blank_reason")
    )
    fine = error.isNull()
    return F.struct(error.alias("error"), F.when(fine, winner).alias("winner"), F.when(fine, confidence).alias("confidence"), F.when(fine, values["reason"]).alias("reason"))
