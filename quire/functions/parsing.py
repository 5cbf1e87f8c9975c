"""Answers of language models as data: JSON out of text, quizzes, error reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import blank_to_null, strip

QUIZ = "array<struct<question_id:string,question_text:string,answer_text:string>>"


def json_text(answer: Column) -> Column:
    """The JSON in an answer: a fenced block, else from the first bracket to the last one; null if none."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.length(fenced) > 0, fenced).otherwise(answer)
    return F.nullif(F.regexp_extract(body, r"(?s)[\[{].*[\]}]", 0), F.lit(""))


def quiz_items(answer: Column, least: int = 4) -> Column:
    """The questions of a quiz; null if there are too few or one lacks a field."""
    items = F.from_json(json_text(answer), QUIZ)
    full = F.forall(items, lambda x: blank_to_null(x["question_id"]).isNotNull() & blank_to_null(x["question_text"]).isNotNull() & blank_to_null(x["answer_text"]).isNotNull())
    return F.when((F.size(items) >= least) & full, items)


def skip_reason(text: Column, least: int = 400) -> Column:
    """Why no quiz is made of a text; null if one is."""
    return F.when(F.length(strip(text)) < least, "content_too_short")


def http_status(reason: Column, kind: str = "section_task") -> Column:
    """The status of a failure by its reason, for section tasks, unit content and reparsing.

    A section task or a reparse takes a named status from 400 to 599.  Then things not found are 404, and all else is
    400; a reparse knows 400 for what the caller did wrong, else 500."""
    lowered = F.lower(strip(reason))
    named = F.regexp_extract(reason, r"status=(\d{3})", 1).try_cast("int")
    named = F.when(named.between(400, 599), named)
    missing = F.when(lowered.contains("not found"), 404).otherwise(400)
    if kind == "unit_content":
        return missing
    if kind == "reparse":
        wrong = lowered.contains("bad_request") | lowered.contains("cannot be empty") | lowered.contains("unsupported") | lowered.contains("unknown parser_mode")
        return F.coalesce(named, F.when(wrong, 400).otherwise(500))
    return F.coalesce(named, missing)


def provider_reason(status: Column, message: Column) -> Column:
    """`status=NNN | message`, without what is missing."""
    return F.concat_ws(" | ", F.when(status.isNotNull(), F.concat(F.lit("status="), status.cast("string"))), blank_to_null(message))


def clean_ratio(value: Column) -> Column:
    """A ratio in [0, 1]; what is no number is 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def allowed(value: Column, names: list[str], default: str = "unknown") -> Column:
    lowered = F.lower(strip(value))
    return F.when(lowered.isin(names), lowered).otherwise(default)


def artifact_key(scope: Column, *parts: Column) -> Column:
    return F.concat_ws(":", scope, *parts)
