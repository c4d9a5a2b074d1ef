"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def tokens(text: Column) -> Column:
    """White-space tokens; null and blank texts have none."""
    parts = F.split(F.trim(text), r"\s+")
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x != "")


def chunks(docs: DataFrame, config: Config = DEFAULT, text: str = "text") -> DataFrame:
    """Sliding token windows of each document: ``doc_id, chunk_idx, text``.

    Windows start at every stride below the number of tokens, so the last one may lie wholly
    in the one before it.  A text without tokens gives no chunk.
    """
    split = docs.select("doc_id", tokens(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    starts = split.select("doc_id", "_t", F.posexplode(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(config.stride))).alias("chunk_idx", "_s"))
    return starts.select("doc_id", "chunk_idx", F.array_join(F.slice("_t", F.col("_s") + 1, config.chunk_tokens), " ").alias("text"))


def corpus(raw: DataFrame) -> DataFrame:
    """``doc_id, text`` of records with id or doc_id and title/context, text or content.

    Records without an id or a text are dropped; the last record of an id holds (by ``pos``).
    """
    body = F.coalesce(F.when(F.col("context").isNotNull(), F.concat_ws("\n\n", "title", "context")), "text", "content")
    kept = raw.select(F.coalesce("id", "doc_id").alias("doc_id"), body.alias("text"), "pos").where("doc_id is not null and text <> ''")
    return kept.groupBy("doc_id").agg(F.max_by("text", "pos").alias("text"))


def estimated_tokens(text: Column, config: Config = DEFAULT) -> Column:
    return F.coalesce(F.floor(F.length(text) / config.chars_per_token), F.lit(0)).cast("long")


SENTENCE_END = "\u0001"
WHITE = " \t\n\x0b\f\r"


def sentences(text: Column) -> Column:
    """Sentences end with . ! or ? before white space; they are stripped, blank ones dropped."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", f"$1{SENTENCE_END}"), SENTENCE_END)
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def is_refusal(answer: Column) -> Column:
    return answer.isNull() | (answer == "") | F.contains(F.lower(answer), F.lit("cannot answer"))


def is_validator_refusal(answer: Column) -> Column:
    low = F.lower(F.trim(answer))
    return F.contains(low, F.lit("cannot answer")) | F.contains(low, F.lit("i don't know"))


def valid_name(name: Column) -> Column:
    return name.isNotNull() & (F.trim(name) != "")


def capitalised(text: Column) -> Column:
    """The rule that stands in for a language model's entities: capitalised words of four letters or more."""
    return F.regexp_extract_all(text, F.lit("[A-Z][a-z]{3,}"), F.lit(0))


def query_id(kind: Column, number: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.format_string("%04d", number))


def join_texts(texts: Column, config: Config = DEFAULT) -> Column:
    return F.array_join(F.filter(texts, lambda x: x != ""), config.separator)
