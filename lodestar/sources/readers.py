"""Reading corpora, questions, triplets, answers and retrievals, all by explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.text import corpus
from . import log, store


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or one JSON array or object: told apart by the first character, blank lines skipped."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    whole = bool(first) and first[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", whole).option("mode", "FAILFAST").json(path)


def placed_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a log, a file or a folder, with ``pos``: a later one was written later."""
    if log.files(spark, path) != [path]:
        return log.read(spark, path, schema).withColumnRenamed(log.AT, "pos")
    return json_rows(spark, path, schema).withColumn("pos", log.position())


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text``; later records of an id replace earlier ones."""
    return corpus(placed_rows(spark, path, schemas.CORPUS))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    rows = json_rows(spark, path, schemas.QUESTIONS)
    return rows.where("id is not null and question <> ''").withColumnRenamed("id", "qid")


def split_keys(rows: DataFrame) -> DataFrame:
    """``key`` of the form subject|||relation|||object to three columns; other keys are dropped."""
    parts = F.split("key", r"\|\|\|", -1)
    kept = rows.withColumn("_p", parts).where(F.size("_p") == 3)
    return kept.select(F.col("_p")[0].alias("subject"), F.col("_p")[1].alias("relation"), F.col("_p")[2].alias("object"), *(c for c in rows.columns if c != "key"))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """The stored map from triplets to sources, one row for each source."""
    stored = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schemas.SOURCES)).alias("key", "sources"))
    return split_keys(stored.select("key", F.explode("sources").alias("s")).select("key", "s.doc_id", "s.chunk_idx", "s.source_text"))


def triplets_by_doc(triplets: DataFrame) -> DataFrame:
    """How many triplets each document states."""
    return triplets.groupBy("doc_id").agg(F.count("*").alias("n_triplets"), F.countDistinct("chunk_idx").alias("n_chunks"))


def regrouped(triplets: DataFrame) -> DataFrame:
    """``doc_id, triplets``: what each document states, once a chunk, by chunk and name."""
    item = F.struct("chunk_idx", "subject", "relation", "object")
    return triplets.groupBy("doc_id").agg(F.array_sort(F.collect_set(item)).alias("triplets"))


def from_records(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, subject, relation, object, doc_id, chunk_idx, source_text`` of records in ``content``.

    A record is the JSON of an object with ``triplet, doc_id, chunk_idx, source_text`` or of
    the bare list of three; a bare one belongs to the document of its key, to chunk 0, and
    has no text.  Lists of another length are dropped.
    """
    shape = "struct<triplet: array<string>, doc_id: long, chunk_idx: int, source_text: string>"
    bare = F.from_json("content", "array<string>")
    rows = records.withColumn("_r", F.from_json("content", shape)).withColumn("_t", F.coalesce(F.col("_r.triplet"), bare)).where(F.size("_t") == 3)
    none = F.lit(None)
    return rows.select(
        F.col(key).alias("key"), F.col("_t")[0].alias("subject"), F.col("_t")[1].alias("relation"), F.col("_t")[2].alias("object"),
        F.coalesce("_r.doc_id", F.col(key).cast("long")).alias("doc_id"), F.coalesce("_r.chunk_idx", none.cast("int"), F.lit(0)).alias("chunk_idx"), F.coalesce("_r.source_text", F.lit("")).alias("source_text"),
    )


def first_answer(*columns: str) -> Column:
    """The first column that is neither null nor empty, else ''."""
    return F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in columns), F.lit(""))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """``qid, answer, rounds``; the last row of an id holds; a missing answer is ''."""
    rows = placed_rows(spark, path, schemas.ANSWERS)
    rows = rows.select(F.col("id").alias("qid"), first_answer("rag_answer", "answer", "final_answer", "llm_answer").alias("answer"), "rounds", "pos")
    return rows.groupBy("qid").agg(F.max_by(F.struct("answer", "rounds"), "pos").alias("a")).select("qid", "a.*")


def passages(found: Column) -> Column:
    """``array<struct<doc_id, chunk_idx, text>>`` of a JSON list of objects or of plain texts (whose ids are null)."""
    kind = schemas.TEXT_REF
    objects = F.transform(F.from_json(found, f"array<{kind}>"), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["chunk_idx"].alias("chunk_idx"), F.coalesce(x["text"], F.lit("")).alias("text")))
    plain = F.transform(F.from_json(found, "array<string>"), lambda x: F.struct(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("chunk_idx"), x.alias("text")))
    return F.when(F.rlike(found, F.lit(r"^\s*\[\s*\{")), objects).otherwise(plain)


def retrieved_texts() -> Column:
    """The texts of whichever list a row has; of a history, the context of the last round."""
    last = F.try_element_at(F.from_json("history", schemas.HISTORY), F.lit(-1))["context"]
    context = F.when(F.col("history").isNotNull(), F.when(last != "", F.array(last)))
    lists = (F.transform(passages(F.col(c)), lambda x: x["text"]) for c in ("source_sentences", "chunks", "retrieved_chunks"))
    return F.coalesce(*lists, context, F.array().cast("array<string>"))


def _last(rows: DataFrame, *columns: str) -> DataFrame:
    """The last row of an id holds."""
    return rows.groupBy("qid").agg(F.max_by(F.struct(*columns), "pos").alias("a")).select("qid", "a.*")


def read_retrievals(spark: SparkSession, path: str) -> DataFrame:
    """``qid, retrieved``: the texts of whichever shape a row has; the last row of an id holds."""
    rows = placed_rows(spark, path, schemas.RETRIEVALS)
    return _last(rows.select(F.col("id").alias("qid"), retrieved_texts().alias("retrieved"), "pos"), "retrieved")


def read_passages(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``qid, pos, doc_id, chunk_idx, text`` of the list ``column`` of each question; the last row of an id holds."""
    rows = placed_rows(spark, path, schemas.RETRIEVALS)
    kept = rows.select(F.col("id").alias("qid"), passages(F.col(column)).alias("found"), "pos")
    return _last(kept, "found").select("qid", F.posexplode("found").alias("pos", "p")).select("qid", "pos", "p.*")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, schemas.QUERIES)


def read_validations(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, f"{schemas.QUERIES}, validation {schemas.VALIDATION}")


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    return placed_rows(spark, path, schemas.EVALUATIONS).drop("pos")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, schemas.FAILED)


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """``qid, scheme, type`` of a stored {qid: {scheme: type}} object."""
    stored = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("qid", "m"))
    return stored.select("qid", F.explode("m").alias("scheme", "type"))


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """The same of lines {qid, types: {scheme: type}}, as they are written."""
    rows = spark.read.schema("qid string, types map<string, string>").json(path)
    return rows.select("qid", F.explode("types").alias("scheme", "type"))


def embedded_types(questions: DataFrame, scheme: str) -> DataFrame:
    """``qid, scheme, type`` of questions that have a ``question_type`` with them."""
    return questions.where("question_type <> ''").select("qid", F.lit(scheme).alias("scheme"), F.col("question_type").alias("type"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written report of an embedding space or of a graph."""
    return json_rows(spark, path, schema)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, doc_id, chunk_idx, text, embedding``: vectors with what they stand for."""
    return store.rows(spark, path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of chunks as they are kept: of each chunk the last ones."""
    return store.last(spark, path, "chunk_idx")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements as they are kept, each once."""
    return store.last(spark, path, "subject", "relation", "object", "chunk_idx").select(*(f.name for f in StructType.fromDDL(schemas.TRIPLETS)))


def held_answers(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and all fields of the last record of each id, as they are stored: failed answers are null."""
    return log.last(placed_rows(spark, path, schemas.ANSWERS).withColumnRenamed("pos", log.AT), "id")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``vertices, edges, triplets, vectors``: a graph, its provenance and its entities' vectors.

    A part that is missing is an error that names all missing ones.
    """
    parts = {"vertices": schemas.VERTICES, "edges": schemas.EDGES, "triplets": schemas.TRIPLETS, "vectors": schemas.VECTORS}
    if lacking := [p for p in parts if not exists(spark, f"{path}/{p}")]:
        raise FileNotFoundError(f"{path} has no {', '.join(lacking)}")
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in parts.items()}
