"""Small text rules: prompts, validation of repairs, masking, retry times, names, line kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gyre.functions import answers

# Prompt texts by version.
PROMPT_STRICT = (
    "Solve the math word problem step by step.\nKeep the explanation concise and numerical.\nThe final line MUST be exactly in this format:\n"
    "Final answer: <number>\nThe <number> must be numeric only (no units, no extra words).\nDo not add any text after the final line.\n\nQuestion: "
)
PROMPT_PLAIN = "Solve step-by-step and conclude with 'Final answer: ...'.\n\nQuestion: "
STRICT_VERSIONS = ("v2", "v2_strict_final", "strict_final_answer")


def prompt(question: Column, version: Column) -> Column:
    return F.concat(F.when(F.lower(version).isin(*STRICT_VERSIONS), F.lit(PROMPT_STRICT)).otherwise(F.lit(PROMPT_PLAIN)), question)


def _final_line(text: Column) -> Column:
    """What the last line with text states as final answer; empty if it states none."""
    lines = F.filter(F.transform(F.split(text, answers.LINE_ENDS), answers.strip), lambda x: x != "")
    return F.regexp_extract(F.coalesce(F.element_at(F.when(F.size(lines) > 0, lines), -1), F.lit("")), r"(?i)^final answer\s*:\s*(.+)$", 1)


def repair_error(repaired: Column, expected: Column, gold: Column | None = None, max_chars: int | None = None) -> Column:
    """Why a repaired response is not to be used; null if it is fine.

    It must end with a line that states the expected token; against a gold answer it must also score as correct.
    """
    state = F.struct(answers.strip(F.coalesce(repaired, F.lit(""))).alias("text"), expected.alias("expected"))

    def read(s: Column, line: Column) -> Column:
        return answers.let(answers.numeric_token(line), lambda token: _repair_error(s["text"], line, token, s["expected"], gold, max_chars))

    return answers.let(state, lambda s: answers.let(_final_line(s["text"]), lambda line: read(s, line)))


def _repair_error(text: Column, line: Column, token: Column, expected: Column, gold: Column | None, max_chars: int | None) -> Column:
    out = F.when(text == "", "empty")
    if max_chars is not None:
        out = out.when(F.length(text) > max_chars, "too_long")
    out = out.when(line == "", "no_final_line").when(expected.isNull(), "expected_not_numeric").when(token.isNull(), "final_not_numeric").when(token != expected, "final_changed")
    if gold is not None:
        wrong = answers.let(answers.extract(text), lambda said: F.when(~said["ok"], "parse_failure").when(answers.let(answers.gold_token(gold), lambda right: answers.label(said["token"], right)) != "correct", "incorrect"))
        out = out.otherwise(wrong)
    return out


def masked(secret: Column) -> Column:
    """The first four and last two characters of a secret; a short one is all stars."""
    return F.when(F.length(secret) <= 6, F.repeat(F.lit("*"), F.length(secret))).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(2))))


def preview(text: Column, limit: int = 200) -> Column:
    """text on one line, cut to a limit."""
    compact = answers.strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.substring(compact, 1, limit), F.lit("...<trimmed>")))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a number, or an HTTP date against now; never below 0; null for anything else."""
    raw = F.trim(value)
    number = F.when(raw.rlike(r"^[-+]?\d+(\.\d+)?$"), raw.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(number, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def retry_sleep(attempt: Column, wait: Column, most_wait: float = 120.0, base: float = 1.5, most: float = 45.0) -> Column:
    """A wait that was asked for, in bounds, or a doubling one; without the random part."""
    doubling = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    return F.when(wait.isNotNull(), F.least(F.lit(most_wait), F.greatest(F.lit(1.0), wait))).otherwise(doubling)


def safe_name(text: Column) -> Column:
    """text with every character but letters, digits and _ - . : replaced by a low line, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\-.:]", "_"), r"^_+|_+$", "")


def error_class(message: Column) -> Column:
    """(category, retryable) of a failure message."""
    code = F.regexp_extract(message, r"\b([45]\d\d)\b", 1).try_cast("int")
    text = F.lower(message)
    category = F.when(text.contains("timeout") | text.contains("timed out"), "network_timeout").when(code == 429, "quota_or_rate_limit").when(code.between(500, 599), "server_error").when(code.isin(401, 403), "auth").when(code.between(400, 499), "request").when(text.contains("connect"), "network_transport").when(text.contains("json") | text.contains("schema"), "bad_payload").otherwise("unknown")
    return F.struct(category.alias("category"), category.isin("network_timeout", "network_transport", "quota_or_rate_limit", "server_error").alias("retryable"))


def line_kind(line: Column, is_first: Column) -> Column:
    """title, h1, h2, h3, bullet, table, table_rule, blank or body: what a line of a plain or Markdown text is."""
    s = F.trim(line)
    rule = s.contains("|") & s.rlike(r"^[|:\- ]+$") & s.contains("-")
    return (
        F.when(is_first, "title").when(s == "", "blank").when(rule, "table_rule").when(s.startswith("|"), "table").when(s.startswith("### "), "h3")
        .when(s.startswith("## ") | s.rlike(r"^\d+\.\d+\s"), "h2").when(s.startswith("# ") | s.rlike(r"^\d+\.\s"), "h1").when(s.rlike(r"^[-*] "), "bullet").otherwise("body")
    )


def row_cells(line: Column) -> Column:
    """The trimmed cells of a Markdown table row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), F.trim)
