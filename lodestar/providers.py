"""Stand-ins for language models: deterministic rules.

Most take and give columns, so a real model can take the place of one as a pandas UDF of the
same shape.  The embedders take a table, a key and a text column; the extractor takes chunks
and gives triplets, and the one who asks takes chunks and gives questions: models that are
called with bounds and retries take their places by ``graph.extractor`` and
``generate.asker``.  Scores made with the stand-ins can't be compared with those of real models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions.text import capitalised, is_refusal, sentences, tokens
from .functions.vectors import TokenEmbedder, embedded, embedded_names, letters
from .operators.graph import extract


def overlap(sentence: Column, question: Column) -> Column:
    """How many different tokens of the question a sentence has."""
    return F.size(F.array_intersect(F.array_distinct(tokens(F.lower(sentence))), tokens(F.lower(question))))


def extractive(question: Column, context: Column) -> Column:
    """The first sentence of the context with most tokens of the question; blank contexts are refused."""
    rows = F.transform(sentences(context), lambda s, i: F.struct(overlap(s, question).alias("n"), (-i).alias("first"), s.alias("s")))
    return F.when(F.trim(F.coalesce(context, F.lit(""))) == "", F.lit(DEFAULT.refusal)).otherwise(F.coalesce(F.array_max(rows)["s"], F.lit(DEFAULT.refusal)))


def from_memory(question: Column) -> Column:
    """Without a context there is nothing to answer from."""
    return F.when(question.isNotNull(), F.lit(DEFAULT.refusal))


def rule_judge(expected: Column, answer: Column) -> Column:
    held = F.contains(F.lower(answer), F.lower(F.trim(expected)))
    return F.when(is_refusal(answer) | (F.trim(answer) == ""), F.lit("incomplete")).when(held, F.lit("correct")).otherwise(F.lit("incorrect"))


def rule_type(question: Column) -> Column:
    """By the question's length: short ones ask for a fact, long ones for reasoning."""
    n = F.size(tokens(question))
    return F.when(n < 12, F.lit("distributed")).when(n < 30, F.lit("full_context")).otherwise(F.lit("query_focused"))


def about_names(samples: DataFrame) -> DataFrame:
    """``doc_id, chunk_idx, question, answer, text``: about the first name of a chunk; the first sentence with it answers."""
    name = F.get(capitalised(F.col("text")), F.lit(0))
    rows = samples.withColumn("name", name).where("name is not null")
    found = F.get(F.filter(sentences(F.col("text")), lambda s: F.contains(s, F.col("name"))), F.lit(0))
    return rows.select("doc_id", "chunk_idx", F.concat(F.lit("What is said about "), "name", F.lit("?")).alias("question"), found.alias("answer"), "text")


@dataclass(frozen=True)
class Providers:
    embed: Callable[[DataFrame, str, str], DataFrame] = embedded
    embed_names: Callable[[DataFrame, str, str], DataFrame] = embedded_names
    extract_entities: Callable[[Column], Column] = capitalised
    answer: Callable[[Column, Column], Column] = extractive
    answer_directly: Callable[[Column], Column] = from_memory
    judge: Callable[[Column, Column], Column] = rule_judge
    classify: Callable[[Column], Column] = rule_type
    extract_triplets: Callable[[DataFrame], DataFrame] = extract
    ask: Callable[[DataFrame], DataFrame] = about_names
    embed_tokens: TokenEmbedder = letters


RULES = Providers()
