"""Benchmark questions from samples, by rule, and their checks.

A real generator takes the prompts of ``functions.prompts`` and returns the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import prompts
from ..functions.calls import Limits, Model, called, is_object
from ..functions.parsing import json_of
from ..functions.text import is_validator_refusal, join_texts, query_id, sentences
from ..providers import RULES, Providers
from ..storage import cut, together
from . import index, validate

GENERATED = "struct<question: string, answer: string, reasoning: string, discard: boolean>"


def parsed(rows: DataFrame, content: str) -> DataFrame:
    """``question, answer, reasoning`` from a model's JSON; rows that are broken, discarded or blank are dropped."""
    made = rows.withColumn("g", json_of(F.col(content), GENERATED))
    kept = made.where("g.question <> '' and g.answer <> '' and not coalesce(g.discard, false)")
    return kept.select(*(c for c in rows.columns if c != content), "g.question", "g.answer", "g.reasoning")


def numbered(rows: DataFrame, kind: str, order: list[str], first: int = 1) -> DataFrame:
    """Add ``id`` and ``type``: the kind and a number in ``order``, from ``first``; for the few rows that were drawn."""
    number = F.row_number().over(Window.orderBy(*order)) + (first - 1)
    return rows.withColumn("id", query_id(F.lit(kind), number)).withColumn("type", F.lit(kind))


def single_hop(samples: DataFrame, providers: Providers = RULES) -> DataFrame:
    """``doc_id, chunk_idx, question, answer, text`` of what the provider asks about chunks."""
    return providers.ask(samples)


def asker(model: Model, limits: Limits = Limits()) -> Callable[[DataFrame], DataFrame]:
    """The provider ``ask`` by a model: a question for each chunk; failed, discarded and blank ones are dropped.

    A reply that is no JSON object is tried again.
    """

    def run(samples: DataFrame) -> DataFrame:
        rows = samples.select("doc_id", "chunk_idx", "text", F.to_json(prompts.single_hop(F.col("text"))).alias("prompt"))
        replies = cut(called(rows, "prompt", model, limits, is_object).where("status = 'done'"))
        return parsed(replies.select("doc_id", "chunk_idx", "text", "reply"), "reply").select("doc_id", "chunk_idx", "question", "answer", "text")

    return run


def multi_hop(chains: DataFrame, n_docs: int) -> DataFrame:
    """``doc_ids, bridges, question, answer`` for chains: the answer names all bridges and where they lead, which no document does."""
    docs = F.array(*(f"doc_{k}" for k in range(1, n_docs + 1)))
    bridges = F.array(*(f"bridge_{k}" for k in range(1, n_docs)))
    question = F.concat(F.lit("Which names lead from document "), F.col("doc_1").cast("string"), F.lit(" to document "), F.col(f"doc_{n_docs}").cast("string"), F.lit("?"))
    answer = F.concat(F.array_join(bridges, " and "), F.lit(" lead through documents "), F.array_join(docs, ", "))
    return chains.select(docs.alias("doc_ids"), bridges.alias("bridges"), question.alias("question"), answer.alias("answer"))


def summary(clusters: DataFrame, texts: DataFrame) -> DataFrame:
    """``entity, doc_ids, question, answer, facts`` for clusters (``entity, doc_id, chunk_idx, place``).

    ``texts`` has ``doc_id, chunk_idx, text``.  The answer is the first sentence with the
    entity in each document; a cluster with such a sentence in fewer than two is discarded.
    """
    held = clusters.join(texts, ["doc_id", "chunk_idx"])
    said = F.get(F.filter(sentences(F.col("text")), lambda s: F.contains(s, F.col("entity"))), F.lit(0))
    rows = held.select("entity", F.struct("place", "doc_id", "text", said.alias("said")).alias("x")).groupBy("entity").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a few documents a cluster
    kept = rows.withColumn("said", F.filter(F.transform("x", lambda x: x["said"]), lambda s: s.isNotNull())).where(F.size("said") > 1)
    question = F.concat(F.lit("What do the documents say about "), "entity", F.lit("?"))
    return kept.select("entity", F.transform("x", lambda x: x["doc_id"]).alias("doc_ids"), question.alias("question"), F.array_join("said", " ").alias("answer"), F.transform("x", lambda x: x["text"]).alias("facts"))


def until(pool: DataFrame, target: int, passes: Callable[[DataFrame], DataFrame], order: list[str], batch: int = 1000) -> DataFrame:
    """The first ``target`` rows of ``pool``, in ``order``, that ``passes`` keeps.

    The pool is tried a batch at a time and no further than needed: what is costly runs in
    ``passes``.  A batch is as large as the target at least, since not all of it will pass.
    """
    batch = max(batch, target)
    placed = cut(pool.withColumn("_place", F.row_number().over(Window.orderBy(*order))))  # a drawn pool, a few times the target
    total, begin, out, n = placed.count(), 0, placed.limit(0), 0
    while begin < total and n < target:
        tried = placed.where(F.col("_place").between(begin + 1, begin + batch))
        out = cut(together(out, passes(tried).select(placed.columns)))
        n, begin = out.count(), begin + batch
    return out.orderBy("_place").limit(target).drop("_place")


def without_shortcut(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of ``queries`` (``doc_ids, answer``) whose answer no single document holds; ``facts`` has ``doc_id, text``."""
    key = F.array_join("doc_ids", ",")
    rows = queries.select(key.alias("id"), "answer", F.explode("doc_ids").alias("doc_id")).join(facts, "doc_id")
    good = validate.shortcuts(rows).where("passed").select("id")
    return queries.withColumn("_id", key).join(good.withColumnRenamed("id", "_id"), "_id", "left_semi").drop("_id")


@dataclass(frozen=True)
class Samples:
    """What questions are made from."""

    single_hop: DataFrame
    chains: dict[int, DataFrame]
    clusters: DataFrame


def samples(held: DataFrame, chunks: DataFrame, n_single: int, n_summary: int, config: Config = DEFAULT) -> Samples:
    """Samples of all types from the entity index: drawn chunks, chains of two and of three documents, clusters."""
    return Samples(index.single_hop_samples(held, chunks, n_single, config=config), {n: index.chains(held, n, config) for n in (2, 3)}, index.summary_clusters(held, n_summary, config=config))


QUERY = ["id", "type", "question", "answer", "doc_ids", "facts", "bridges", "entity", "num_hops"]


def generated(drawn: Samples, chunks: DataFrame, n_single: int, n_multi: int, n_summary: int, first: dict[str, int] | None = None, multiplier: int = 5, providers: Providers = RULES) -> DataFrame:
    """Questions of all types with ids that go on from ``first``: ``QUERY`` columns.

    Half of the multi-hop questions have two documents, the rest three; each kind tries up to
    ``multiplier`` times as many chains until enough have no shortcut.
    """
    first = first or {}
    texts = chunks.select("doc_id", "chunk_idx", "text")
    whole = texts.groupBy("doc_id").agg(F.max_by("text", -F.col("chunk_idx")).alias("text"))
    none = F.lit(None)
    fill = lambda rows: rows.select("id", "type", "question", "answer", *(c if c in rows.columns else none.cast(t).alias(c) for c, t in (("doc_ids", "array<long>"), ("facts", "array<string>"), ("bridges", "array<string>"), ("entity", "string"), ("num_hops", "int"))))
    single = single_hop(drawn.single_hop.select("doc_id", "chunk_idx").join(texts, ["doc_id", "chunk_idx"]), providers).limit(n_single)
    single = single.withColumns({"doc_ids": F.array("doc_id"), "facts": F.array("text")})
    out = fill(numbered(single, "single_hop", ["doc_id", "chunk_idx"], first.get("single_hop", 0)))
    for n_docs, n in zip((2, 3), split(n_multi), strict=True):
        kind = f"multi_hop_{n_docs}"
        pool = multi_hop(drawn.chains[n_docs], n_docs).withColumn("_draw", F.md5(F.array_join("doc_ids", "|"))).orderBy("_draw").limit(n * multiplier)
        made = until(pool, n, lambda tried: without_shortcut(tried, whole), ["_draw"])
        facts = made.select(F.array_join("doc_ids", ",").alias("_id"), F.posexplode("doc_ids").alias("p", "doc_id")).join(whole, "doc_id").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("p", "text"))).alias("f"))
        made = made.withColumn("_id", F.array_join("doc_ids", ",")).join(facts, "_id").withColumns({"facts": F.transform("f", lambda x: x["text"]), "num_hops": F.lit(n_docs)})
        out = out.unionByName(fill(numbered(made, kind, ["_draw"], first.get(kind, 0))))
    told = summary(drawn.clusters, texts).limit(n_summary)
    return out.unionByName(fill(numbered(told, "summary", ["entity"], first.get("summary", 0))))


def split(n: int) -> tuple[int, int]:
    """How many of ``n`` multi-hop questions have two documents, and how many three."""
    return n // 2, n - n // 2


def matches(question: Column, expected: Column, answer: Column, providers: Providers = RULES) -> Column:
    """Whether an answer is right: both are there, it is no refusal, and the judge says so."""
    there = (F.coalesce(expected, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != "")
    return F.coalesce(there & ~is_validator_refusal(answer) & (providers.judge(expected, answer) == "correct"), F.lit(False))


def checked(queries: DataFrame, config: Config = DEFAULT, providers: Providers = RULES) -> DataFrame:
    """``id, type`` and the verdicts ``answerable, shortcut, leak, overall``.

    ``queries`` has ``id, type, question, answer, facts`` (array of texts).  Answerable: the
    answer from all facts is judged correct.  Shortcut (multi-hop only): no single fact holds
    the answer.  Leak: the answer is not in the question and is not known without facts.
    """
    right = lambda answer: matches(F.col("question"), F.col("answer"), answer, providers)
    rows = queries.withColumn("answerable", right(providers.answer(F.col("question"), join_texts(F.col("facts"), config))))
    leaks = validate.leaks(queries.withColumn("llm_knows", right(providers.answer_directly(F.col("question")))))
    alone = validate.shortcuts(queries.where(F.startswith("type", F.lit("multi_hop"))).select("id", "answer", F.explode("facts").alias("text")))
    rows = rows.join(leaks, "id").join(alone.select("id", "passed"), "id", "left")
    rows = rows.withColumn("shortcut", F.coalesce("passed", F.lit(True))).withColumn("leak", F.col("leak_type") == "none")
    return rows.select("id", "type", "answerable", "shortcut", "leak", (F.col("answerable") & F.col("shortcut") & F.col("leak")).alias("overall"))
