"""Text expressions with the semantics of Python strings, for Catalyst. No UDFs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill import lexicons

_SPACE = r"\s\x1c-\x1f"


def py_strip(x: Column) -> Column:
    """Unicode white space off both ends. (F2)"""
    return F.regexp_replace(x, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def tokens(x: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.regexp_extract_all(x, F.lit(r"(\S+)"), 1)


def preview(x: Column, n: int) -> Column:
    """The first n characters, on one line."""
    return F.regexp_replace(F.substring(x, 1, n), "\n", " ")


def count_class(x: Column, keep: str) -> Column:
    """How many characters fall into a class of regular expressions; the others go in whole runs. (F8)"""
    return F.length(F.regexp_replace(x, f"(?U)[^{keep}]+", ""))


def sentence_count(x: Column) -> Column:
    return F.greatest(F.size(F.split(x, "[.!?]+")), F.lit(1))


def has_letter(x: Column) -> Column:
    return F.rlike(x, F.lit("[a-zA-Z]"))


def any_of(words: Column, vocabulary) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary]))


def contains_any(x: Column, patterns) -> Column:
    """Whether one of the substrings occurs."""
    return reduce(or_, [F.contains(x, F.lit(p)) for p in patterns], F.lit(False))


def question_keywords(question: str) -> list[str]:
    """The words to look for: lower case, longer than two, no stop words; punctuation stays."""
    return [w for w in question.lower().split() if w not in lexicons.QUESTION_STOP_WORDS and len(w) > 2]


def percent(x: Column) -> Column:
    """One decimal, ties to even."""
    return F.concat(F.format_string("%.1f", F.bround(x, 1)), F.lit("%"))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_label(ts: Column) -> Column:
    """Monday and Sunday of the week, e.g. 2024-01-01/2024-01-07."""
    monday = F.date_trunc("week", ts).cast("date")
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def string_array(json: Column) -> Column:
    """A JSON array of strings; null for anything else."""
    return F.from_json(json, "array<string>")


def fenced_json(reply: Column, schema: str) -> Column:
    """The JSON of a model's reply, with or without a code fence and a `json` tag."""
    body = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(body, schema)


def default_label(x: Column, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def status_icon(status: Column) -> Column:
    """Known run states as marks, others as they are."""
    return F.when(status == "success", "[ok]").when(status == "failed", "[failed]").when(status == "in_progress", "[running]").otherwise(status)
