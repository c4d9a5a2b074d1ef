"""Merging ranked lists of passages, and the rounds of iterative retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..storage import together


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Alternate two ranked lists of the questions in both: ``qid, pos, doc_id, chunk_idx, text``.

    A passage counts where it is first seen: by document and chunk, or by its text if it has
    no document.  Empty texts are skipped.  Ranks (``pos``) start at 0.  Lists without ``text``
    have ``mark``, which tells texts apart, and ``some``, whether there is one.
    """
    given = [c for c in first.columns if c not in ("qid", "pos", "doc_id", "chunk_idx")]
    there, other = ("text <> ''", F.md5("text")) if "text" in given else ("some", F.col("mark").cast("string"))
    both = first.select("qid").distinct().join(second.select("qid").distinct(), "qid")
    place = lambda df, k: df.select("qid", (2 * F.col("pos") + k).alias("pos"), "doc_id", "chunk_idx", *given)
    rows = together(place(first, 0), place(second, 1)).join(both, "qid").where(there)
    key = F.when(F.col("doc_id").isNotNull(), F.concat_ws(":", "doc_id", "chunk_idx")).otherwise(other)
    seen = F.row_number().over(Window.partitionBy("qid", "key").orderBy("pos"))
    return rows.withColumn("key", key).withColumn("seen", seen).where("seen = 1").drop("key", "seen")


def add_round(held: DataFrame, found: DataFrame) -> DataFrame:
    """Held passages and those found that are not held yet, by question, document and chunk.

    Repeats inside ``found`` stay, and passages without a document never block others.
    """
    new = found.join(held.select("qid", "doc_id", "chunk_idx").distinct(), ["qid", "doc_id", "chunk_idx"], "left_anti")
    return together(held, new.select(held.columns))


def rounds(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Iterative answering: ``qid, rounds, sufficient`` from verdicts on each round's answer.

    ``turns`` has ``qid, round`` (from 0), ``sufficient, sub_question``.  Work on a question
    ends at its first round that is sufficient, has no sub-question, or repeats one; else
    after ``config.iterative_rounds`` rounds beyond round 0.  Each round takes only the
    questions that are still open.
    """
    known = turns.where(F.col("round") <= config.iterative_rounds)
    earlier = F.collect_set("sub_question").over(Window.partitionBy("qid").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    ends = F.col("sufficient") | F.coalesce(F.col("sub_question") == "", F.lit(True)) | F.array_contains(earlier, F.col("sub_question"))
    marked = known.withColumn("ends", ends)
    first = marked.groupBy("qid").agg(F.min(F.when(F.col("ends"), F.col("round"))).alias("stop"), F.max("round").alias("last"))
    stop = first.select("qid", F.coalesce("stop", "last").alias("round"))
    return marked.join(stop, ["qid", "round"]).select("qid", F.col("round").alias("rounds"), "sufficient")


def unanswered(questions: DataFrame, answers: DataFrame, key: str = "qid") -> DataFrame:
    """Questions without an answer so far; a null answer is none, so failures are tried again."""
    done = answers.where("answer is not null").select(key).distinct()
    return questions.where(F.col(key).isNotNull() & (F.coalesce("question", F.lit("")) != "")).join(done, key, "left_anti")


def update_answers(answers: DataFrame, new: DataFrame, key: str = "qid") -> DataFrame:
    """Answers by key, replaced where ``new`` has one; null answers in ``new`` replace nothing.

    Of several new answers that with the greatest ``pos`` holds, or the greatest text where
    ``new`` has no ``pos``.
    """
    given = new.where("answer is not null")
    latest = given.groupBy(key).agg((F.max_by("answer", "pos") if "pos" in new.columns else F.max("answer")).alias("new_answer"))
    return answers.join(latest, key, "left").withColumn("answer", F.coalesce("new_answer", "answer")).drop("new_answer")


def next_number(ids: DataFrame) -> DataFrame:
    """For each type, one more than the largest number at the end of an id."""
    number = F.substring_index("id", "_", -1).try_cast("int")
    return ids.groupBy("type").agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next"))


def latest_types(old: DataFrame, new: DataFrame) -> DataFrame:
    """``qid, scheme, type``: what is new wins, by question and scheme."""
    rows = together(old.withColumn("age", F.lit(1)), new.withColumn("age", F.lit(0)))
    return rows.groupBy("qid", "scheme").agg(F.min_by("type", "age").alias("type"))
