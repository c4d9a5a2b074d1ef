"""Incremental answering: new question files are answered as they come, each batch exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources import log
from ..storage import cut, together

QUEUE = "qid string, question string, attempts int"


def questions(spark: SparkSession, folder: str, within: str = "7 days") -> DataFrame:
    """A stream of JSON-lines questions, each id once ``within`` that time of its file's arrival.

    Ids are remembered no longer than that, so the state is bounded by the questions of that time.
    """
    rows = spark.readStream.schema(schemas.QUESTIONS).json(folder).withColumn("arrived", F.col("_metadata.file_modification_time"))
    kept = rows.where("id is not null and question <> ''").withColumnRenamed("id", "qid")
    return kept.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["qid"])


def answer_batch(batch: DataFrame, number: int, answer: Callable[[DataFrame], DataFrame], out: str, name: str = "answers", attempts: int = 5) -> log.Version:
    """Answer a batch and what earlier ones left without an answer, and publish both in one version.

    A batch that was published already is left alone, so a replay brings no id twice, and a
    batch that died before is answered anew; nothing that was answered is read for that.  A
    null answer puts its question into the queue ``failed``, which the next batch takes up,
    ``attempts`` times in all; after that a null answer is written as the last word.
    """
    spark = batch.sparkSession
    held = log.version(spark, out)
    if held is not None and held.streams.get(name, -1) >= number:
        return held
    fresh = batch.select(F.col("qid").cast("string"), "question", F.lit(0).alias("attempts"))
    queue = log.side(spark, out, "failed", QUEUE)
    todo = cut(together(fresh.join(queue.select("qid"), "qid", "left_anti"), queue))
    made = cut(todo.join(answer(todo.select("qid", "question")).select("qid", "answer"), "qid", "left"))
    failed = made.where("answer is null").select("qid", "question", (F.col("attempts") + 1).cast("int").alias("attempts"))
    done = made.where(F.col("answer").isNotNull() | (F.col("attempts") + 1 >= attempts))
    rows = done.select(F.col("qid").alias("id"), F.col("answer").alias("rag_answer"))
    return log.append(rows, out, stream=(name, number), sides={"failed": failed.where(F.col("attempts") < attempts)})


def answer_stream(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, name: str = "answers") -> StreamingQuery:
    """Append ``id, rag_answer`` rows for each batch of questions.

    ``answer`` takes ``qid, question`` and gives ``qid, answer``.
    """
    write = lambda batch, number: answer_batch(batch, number, answer, out, name)
    return stream.writeStream.foreachBatch(lambda b, n: write(b, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
