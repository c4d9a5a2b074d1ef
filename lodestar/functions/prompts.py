"""Messages for language models, as array<struct<role, content>> columns.

The wording is our own; what goes in, and how much of it, is fixed by the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_CHARS = 2000
SUMMARY_CHARS = 800
CHAIN_CHARS = 500


def messages(system: str, user: Column) -> Column:
    part = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(part("system", F.lit(system)), part("user", user))


def _with(head: str, *fields: tuple[str, Column]) -> Column:
    return F.concat(F.lit(head), *(x for name, value in fields for x in (F.lit(f"\n{name}: "), F.coalesce(value, F.lit("")))))


def entities(question: Column) -> Column:
    return messages("List the named entities of the question as a JSON list of strings.", _with("Extract.", ("Question", question)))


def triplets(text: Column) -> Column:
    return messages("Return a JSON list of [subject, relation, object].", _with("Extract the facts.", ("Text", text)))


def direct(question: Column) -> Column:
    return messages("Answer briefly from what you know.", _with("Answer.", ("Question", question)))


def grounded(question: Column, context: Column) -> Column:
    return messages("Answer from the context alone; say that you cannot answer if it does not hold the answer.", _with("Answer.", ("Context", context), ("Question", question)))


def sufficient(question: Column, answer: Column, context: Column) -> Column:
    return messages("Return JSON with sufficient, reason and sub_question.", _with("Judge.", ("Question", question), ("Answer", answer), ("Context", F.substring(context, 1, CONTEXT_CHARS))))


def label(question: Column, expected: Column, answer: Column) -> Column:
    return messages("Return JSON with label (correct, incorrect or incomplete) and reason.", _with("Compare.", ("Question", question), ("Expected", expected), ("Answer", answer)))


def single_hop(document: Column) -> Column:
    return messages("Write one question that this document answers, as JSON with question and answer.", _with("Write.", ("Document", document)))


def _numbered(documents: Column, most: int) -> Column:
    return F.array_join(F.transform(documents, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(x, 1, most))), "\n")


def summary(entity: Column, documents: Column) -> Column:
    return messages('Write a question over all documents, as JSON; {"discard": true} if they don\'t belong together.', _with("Write.", ("Entity", entity), ("Documents", _numbered(documents, SUMMARY_CHARS))))


def multi_hop(documents: Column, bridges: Column) -> Column:
    return messages("Write one question that needs all documents, as JSON with question, answer and reasoning.", _with("Write.", ("Hops", (F.size(documents) - 1).cast("string")), ("Bridges", F.array_join(bridges, ", ")), ("Documents", _numbered(documents, CHAIN_CHARS))))


def two_hop(first: Column, second: Column, bridge: Column) -> Column:
    return multi_hop(F.array(first, second), F.array(bridge))
