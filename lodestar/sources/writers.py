"""Writing results and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from . import log, store


def place(root: str, stage: str, method: str = "", model: str = "", dataset: str = "") -> str:
    """The folder of a result: stage, method, model, dataset; empty parts are left out."""
    return "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate((root, stage, method, model, dataset)) if x)


def append_rows(rows: DataFrame, path: str) -> None:
    """Records behind those there; the log numbers the batch."""
    log.append(rows, path)


def replace_rows(rows: DataFrame, path: str) -> None:
    """Records in place of those there, which hold until all new ones are written."""
    log.rewrite(rows, path)


def put_rows(rows: DataFrame, path: str, mode: str) -> None:
    (append_rows if mode == "append" else replace_rows)(rows, path)


def write_embeddings(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors of chunks in buckets of documents, behind those there or in their place; many batches are made one."""
    (store.append if mode == "append" else store.rewrite)(rows, path, "doc_id")
    store.compact_when_many(rows.sparkSession, path, "chunk_idx")


def write_index(rows: DataFrame, path: str) -> None:
    """Vectors with their metadata, in buckets of row ids, published at once; a search reads back what it needs."""
    store.rewrite(rows.select("row_id", "doc_id", "chunk_idx", "text", "embedding"), path, "row_id")
    log.vacuum(rows.sparkSession, path)


def write_graph(vertices: DataFrame, edges: DataFrame, triplets: DataFrame, vectors: DataFrame, path: str) -> None:
    for name, rows in (("vertices", vertices), ("edges", edges), ("triplets", triplets), ("vectors", vectors)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


STATEMENT = ("subject", "relation", "object", "chunk_idx")  # with its document


def write_triplets(triplets: DataFrame, path: str, mode: str = "append") -> None:
    """Statements in buckets of documents.

    Nothing of what is stored is read: a statement that is written again is found as one when
    it is read, where it lies, and goes with the next compaction.
    """
    fields = StructType.fromDDL(schemas.TRIPLETS).fields
    rows = triplets.select(*((F.col(f.name) if f.name in triplets.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    (store.append if mode == "append" else store.rewrite)(rows, path, "doc_id")
    store.compact_when_many(triplets.sparkSession, path, *STATEMENT)


def write_done(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Ids of documents that are done, in buckets."""
    (store.append if mode == "append" else store.rewrite)(rows.select("doc_id").distinct(), path, "doc_id")


def write_subgraphs(nodes: DataFrame, triplets: DataFrame, sources: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``id, nodes, triplets, source_sentences`` of each question that has nodes; ``sources`` has ``qid, chunks``."""
    node = F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("place"), "entity", "similarity", "rank", "is_seed")
    of_nodes = nodes.groupBy("qid").agg(F.array_sort(F.collect_list(node)).alias("n"))
    of_triplets = triplets.groupBy("qid").agg(F.array_sort(F.collect_list(F.array("subject", "relation", "object"))).alias("triplets"))
    rows = of_nodes.join(of_triplets, "qid", "left").join(sources, "qid", "left")
    shown = F.transform("n", lambda x: F.struct(x["rank"].alias("rank"), x["entity"].alias("entity"), x["similarity"].alias("similarity"), x["is_seed"].alias("is_seed")))
    none = F.array().cast("array<array<string>>")
    made = rows.select(F.col("qid").cast("string").alias("id"), shown.alias("nodes"), F.coalesce("triplets", none).alias("triplets"), F.col("chunks").alias("source_sentences"))
    put_rows(made, path, mode)


def write_history(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``id, history`` of iterative answering, rounds in order."""
    verdict = F.struct("sufficient", F.lit("").alias("reason"), "sub_question").alias("evaluation")
    item = F.struct("round", "query", "answer", "context", verdict, "new_chunks_count")
    put_rows(history.groupBy(F.col("qid").cast("string").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("history")), path, mode)


def write_comparison(labels: DataFrame, compared: DataFrame, a: str, b: str, path: str) -> None:
    """The labels of both methods and how they meet, in three folders."""
    for method in (a, b):
        labels.where(F.col("method") == method).write.mode("overwrite").json(f"{path}/{method}")
    compared.write.mode("overwrite").json(f"{path}/comparison")


def write_failed(rows: DataFrame, path: str) -> None:
    """Only what still failed is kept, so a failed retry is tried again."""
    rows.where("status = 'failed'").drop("status").write.mode("overwrite").json(path)


def write_queries(queries: DataFrame, path: str) -> None:
    """Sorted by type and id over all files, as JSON lines (an array would be one file from one task)."""
    queries.orderBy("type", "id").write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_types(types: DataFrame, path: str) -> None:
    """One line for each question: {qid, types: {scheme: type}}."""
    made = types.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scheme", "type")))).alias("types"))
    made.orderBy("qid").write.mode("overwrite").json(path)


def write_partitioned(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("method", "model", "dataset").parquet(path)
