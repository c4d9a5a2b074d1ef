"""Column functions over what a language model returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JUDGE_LABELS = ["correct", "incorrect", "incomplete"]
# The question types, in the order in which they are looked for, and the default.
QUESTION_TYPES = ["distributed", "query_focused", "full_context"]
DEFAULT_TYPE = "query_focused"
EVALUATION = "struct<sufficient: boolean, reason: string, sub_question: string>"


def unfenced(content: Column) -> Column:
    """Without the first pair of Markdown fences, if there is one."""
    inner = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(F.contains(content, F.lit("```")), inner).otherwise(F.trim(content))


def json_of(content: Column, schema: str) -> Column:
    """The parsed value, null where it can't be parsed."""
    return F.from_json(unfenced(content), schema)


def triplets(content: Column) -> Column:
    """The lists of exactly three strings in a JSON list; anything else gives none."""
    parsed = F.coalesce(json_of(content, "array<array<string>>"), F.array().cast("array<array<string>>"))
    return F.filter(parsed, lambda x: F.size(x) == 3)


def evaluation(content: Column) -> Column:
    """The verdict on an answer; one that can't be parsed is insufficient."""
    parsed = json_of(content, EVALUATION)
    return F.struct(F.coalesce(parsed["sufficient"], F.lit(False)).alias("sufficient"), F.coalesce(parsed["reason"], F.lit("")).alias("reason"), parsed["sub_question"].alias("sub_question"))


def judge_label(content: Column) -> Column:
    label = F.lower(F.trim(F.get_json_object(unfenced(content), "$.label")))
    return F.when(label.isin(*JUDGE_LABELS), label).otherwise(F.lit("incomplete"))


def says_correct(content: Column) -> Column:
    found = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.get_json_object(found, "$.label") == "correct", F.lit(False))


def question_type(content: Column, kinds: list[str] = QUESTION_TYPES) -> Column:
    """The type that is the answer, else the first of all that is in it, else the default."""
    low = F.lower(F.trim(content))
    out = F.when(low.isin(*kinds), low)
    for kind in kinds:
        out = out.when(F.contains(low, F.lit(kind)), F.lit(kind))
    return out.otherwise(F.lit(DEFAULT_TYPE))
