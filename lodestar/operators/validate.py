"""Checks of generated benchmark questions, and what is counted about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaks(questions: DataFrame) -> DataFrame:
    """``id, exact_match, leak_type``: whether the answer stands in the question or is known without context.

    ``questions`` has ``id, question, answer, llm_knows``.  An empty answer always leaks.
    """
    exact = F.contains(F.lower("question"), F.lower(F.trim("answer")))
    kind = F.when(exact & F.col("llm_knows"), F.lit("both")).when(exact, F.lit("exact_match")).when(F.col("llm_knows"), F.lit("llm_knowledge")).otherwise(F.lit("none"))
    return questions.select("id", exact.alias("exact_match"), kind.alias("leak_type"))


def shortcuts(facts: DataFrame) -> DataFrame:
    """``id, n_docs, n_single, passed``: whether any single supporting text holds the answer.

    ``facts`` has ``id, answer, text``; the rule judge finds an answer that stands in a text.
    """
    alone = F.contains(F.lower("text"), F.lower("answer"))
    seen = facts.groupBy("id").agg(F.count("*").alias("n_docs"), F.count_if(alone).alias("n_single"))
    return seen.withColumn("passed", F.col("n_single") == 0)


def statistics(checks: DataFrame) -> DataFrame:
    """Totals and pass rates by type and over all (type ``all``)."""
    rate = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 2).alias(f"pct_{c}")
    tests = ["answerable", "shortcut", "leak", "overall"]
    rows = checks.groupingSets([["type"], []], "type").agg(F.count("*").alias("total"), *(F.count_if(c).alias(f"n_{c}") for c in tests), *map(rate, tests))
    return rows.withColumn("type", F.coalesce("type", F.lit("all")))


def failures(checks: DataFrame) -> DataFrame:
    """One row: passed, failed, and which test the failed ones failed; a missing verdict is a pass."""
    failed = ~F.coalesce("overall", F.lit(True))
    broke = lambda c: F.count_if(failed & ~F.coalesce(c, F.lit(True))).alias(f"failed_{c}")
    return checks.agg(F.count("*").alias("total"), F.count_if(~failed).alias("passed"), F.count_if(failed).alias("failed"), *map(broke, ("answerable", "shortcut", "leak")))


def passed(queries: DataFrame) -> DataFrame:
    """Queries that passed; all multi-hop types are named ``multi_hop``."""
    kind = F.when(F.startswith("type", F.lit("multi_hop")), F.lit("multi_hop")).otherwise(F.col("type"))
    return queries.where("overall").withColumn("type", kind)


def type_shares(typed: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``type, n, pct`` over all typed rows, null types too; ``kinds`` adds types without rows."""
    counts = typed.groupBy("type").agg(F.count("*").alias("n"))
    if kinds is not None:
        wanted = typed.sparkSession.createDataFrame([(k,) for k in kinds], "type string")
        counts = wanted.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
    total = typed.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("type", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))
