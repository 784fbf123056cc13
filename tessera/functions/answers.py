"""Texts that models return, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(raw: Column) -> Column:
    """Without thoughts and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"(?s)```(?:json)?", ""))


def answer_json(raw: Column) -> Column:
    """The JSON object in an answer: the whole, or from the first brace to the last; null if there is none."""
    c = cleaned(raw)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def answer_text(raw: Column) -> Column:
    """The answer of the object, or the raw text where it cannot be read."""
    return F.coalesce(F.try_variant_get(answer_json(raw), "$.answer", "string"), cleaned(raw))


def sub_questions(raw: Column, question: Column) -> Column:
    """The first list of strings in a text, or the question itself."""
    got = F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), "array<string>")
    return F.when(F.size(got) > 0, got).otherwise(F.array(question))
