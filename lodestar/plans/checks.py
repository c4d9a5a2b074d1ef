"""Checks of benchmark questions, resuming, and updating."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import QUESTION_TYPES
from ..operators import merge, validate
from ..sources import log, readers, store, writers
from ..storage import folder, table
from . import query


@query(
    """WITH q AS (SELECT conv_id, turn, text AS question, split_part(text, ' ', 1 + (turn * 40)::INTEGER) AS answer, conv_id % 4 = 0 AS knows FROM conversations WHERE text IS NOT NULL)
SELECT conv_id * 1000 + turn AS id, contains(lower(question), lower(trim(answer))) AS exact_match,
  CASE WHEN contains(lower(question), lower(trim(answer))) AND knows THEN 'both' WHEN contains(lower(question), lower(trim(answer))) THEN 'exact_match' WHEN knows THEN 'llm_knowledge' ELSE 'none' END AS leak_type FROM q"""
)
def leak_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer is one of the question's words, or empty where it has too few."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    answer = F.coalesce(F.get(F.split("text", " "), (F.col("turn") * 40).cast("int")), F.lit(""))
    return validate.leaks(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), answer.alias("answer"), (F.col("conv_id") % 4 == 0).alias("llm_knows")))


#: Facts are the documents of a source and language, the answer is the shortest one's first word.
@query(
    """WITH f AS (SELECT source || ':' || lang AS id, text, lower(first_value(split_part(text, ' ', 1)) OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id)) AS answer FROM documents)
SELECT id, count(*) AS n_docs, count(*) FILTER (contains(lower(text), answer)) AS n_single, count(*) FILTER (contains(lower(text), answer)) = 0 AS passed FROM f GROUP BY id"""
)
def shortcut_single_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("id"), "text", "n_chars", "doc_id")
    first = docs.groupBy("id").agg(F.min_by(F.lower(F.element_at(F.split("text", " "), 1)), F.struct("n_chars", "doc_id")).alias("answer"))
    return validate.shortcuts(docs.select("id", "text").join(first, "id"))


#: Labels stand in for verdicts: quality for answerable, toxic for leak.
VERDICTS = "v AS (SELECT doc_id, lang AS type, quality = 1 AS answerable, doc_id % 5 <> 0 AS shortcut, toxic = 0 AS leak, quality = 1 AND doc_id % 5 <> 0 AND toxic = 0 AS overall FROM labels JOIN documents USING (doc_id))"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    tests = {"answerable": F.col("quality") == 1, "shortcut": F.col("doc_id") % 5 != 0, "leak": F.col("toxic") == 0}
    return rows.withColumns(tests).withColumn("overall", F.col("answerable") & F.col("shortcut") & F.col("leak")).select("doc_id", F.col("lang").alias("type"), *tests, "overall")


@query(
    f"""WITH {VERDICTS} SELECT coalesce(type, 'all') AS type, count(*) AS total, {", ".join(f"count(*) FILTER ({c}) AS n_{c}, round(100.0::DOUBLE * count(*) FILTER ({c}) / count(*), 2) AS pct_{c}" for c in ("answerable", "shortcut", "leak", "overall"))}
FROM v GROUP BY GROUPING SETS ((type), ())"""
)
def validation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.statistics(_verdicts(spark, sf_dir))


@query(
    f"""WITH {VERDICTS} SELECT count(*) AS total, count(*) FILTER (overall) AS passed, count(*) FILTER (NOT overall) AS failed, {", ".join(f"count(*) FILTER (NOT overall AND NOT {c}) AS failed_{c}" for c in ("answerable", "shortcut", "leak"))} FROM v"""
)
def validation_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.failures(_verdicts(spark, sf_dir))


@query(
    f"""WITH {VERDICTS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'multi_hop' ELSE type END AS type FROM v WHERE overall"""
)
def filter_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("multi_hop_"), (F.col("doc_id") % 3).cast("string"))).otherwise(F.col("type"))
    return validate.passed(rows.withColumn("type", kind)).select("doc_id", "type")


@query("SELECT event_type AS type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 2) AS pct FROM events GROUP BY event_type")
def question_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.type_shares(table(spark, sf_dir, "events").select(F.col("event_type").alias("type")))


@query(
    """WITH k(type) AS (VALUES ('distributed'), ('full_context'), ('query_focused')), t AS (SELECT CASE WHEN turn % 3 = 0 THEN 'distributed' WHEN turn % 3 = 1 THEN 'full_context' END AS type FROM conversations)
SELECT k.type, count(t.type) AS n, round(100.0::DOUBLE * count(t.type) / (SELECT count(*) FROM t), 2) AS pct FROM k LEFT JOIN t ON t.type = k.type GROUP BY k.type"""
)
def question_type_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types without a question are listed with zero; questions without a type count in the total."""
    kind = F.when(F.col("turn") % 3 == 0, F.lit(QUESTION_TYPES[0])).when(F.col("turn") % 3 == 1, F.lit(QUESTION_TYPES[2]))
    return validate.type_shares(table(spark, sf_dir, "conversations").select(kind.alias("type")), QUESTION_TYPES)


@query("SELECT o_orderkey AS qid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) AND o_orderkey IS NOT NULL")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are questions, their large lines answers; small lines are failed (null) answers."""
    questions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("question"))
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("answer"))
    return merge.unanswered(questions, answers).select("qid")


@query("SELECT source AS type, max(doc_id) + 1 AS next FROM documents GROUP BY source")
def next_query_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("type"), F.concat("source", F.lit("_"), F.format_string("%04d", "doc_id")).alias("id"))
    return merge.next_number(rows).withColumn("next", F.col("next").cast("long"))


@query("SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' || o_orderstatus ELSE o_orderpriority END AS answer FROM orders")
def update_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    new = rows.where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("qid"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("new "), "o_orderstatus")).alias("answer"))
    return merge.update_answers(rows.select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("answer")), new)


#: Answers of all orders, then of every third without one, then of every fifth: the last written holds.
WRITTEN = """SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 5 = 0 THEN 'third ' || o_orderpriority WHEN o_orderkey % 3 = 0 THEN '' ELSE 'first ' || o_orderstatus END AS answer,
  CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS rounds FROM orders"""


def _log(spark: SparkSession, sf_dir: str) -> str:
    rows = table(spark, sf_dir, "orders")
    path = f"{folder(spark)}/log-{uuid.uuid4().hex}"
    made = ((rows, F.concat(F.lit("first "), "o_orderstatus")), (rows.where("o_orderkey % 3 = 0"), F.lit(None).cast("string")), (rows.where("o_orderkey % 5 = 0"), F.concat(F.lit("third "), "o_orderpriority")))
    for n, (batch, answer) in enumerate(made):
        writers.append_rows(batch.select(F.col("o_orderkey").cast("string").alias("id"), answer.alias("rag_answer"), F.lit(n + 1).alias("rounds")), path)
    return path


@query(WRITTEN)
def record_log_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends of different sizes to a log; a missing answer is read as ''."""
    return readers.read_answers(spark, _log(spark, sf_dir)).withColumn("qid", F.col("qid").cast("long"))


@query(f"SELECT qid, CASE WHEN answer = '' THEN 'again' ELSE answer END AS answer, rounds FROM ({WRITTEN})")
def record_log_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed answers are tried again, and the log is rewritten from itself in one version."""
    path = _log(spark, sf_dir)
    held = readers.held_answers(spark, path)
    writers.replace_rows(held.withColumn("rag_answer", F.coalesce("rag_answer", F.lit("again"))), path)
    log.vacuum(spark, path, 1)
    return readers.read_answers(spark, path).withColumn("qid", F.col("qid").cast("long"))


@query(
    """WITH two AS (SELECT l_orderkey, l_linenumber, 1 AS n, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'N'
UNION ALL SELECT l_orderkey, l_linenumber, 2, l_discount FROM lineitem WHERE l_linestatus = 'O'),
three AS (SELECT * FROM two UNION ALL SELECT l_orderkey, l_linenumber, 3, l_tax FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM two)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY n DESC, price DESC) AS place FROM three)
SELECT l_orderkey, l_linenumber, n, price FROM ranked WHERE place = 1"""
)
def bucketed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in buckets of orders: two batches, made one, then the lines of orders that have none."""
    path = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "lineitem")
    shown = lambda rows, n, price: rows.select("l_orderkey", "l_linenumber", F.lit(n).alias("n"), F.col(price).alias("price"))
    store.append(shown(lines.where("l_returnflag = 'N'"), 1, "l_extendedprice"), path, "l_orderkey", 4)
    store.append(shown(lines.where("l_linestatus = 'O'"), 2, "l_discount"), path, "l_orderkey")
    store.compact_when_many(spark, path, "l_linenumber", after=1)
    store.append(shown(store.without(lines, path), 3, "l_tax"), path, "l_orderkey")
    return store.last(spark, path, "l_linenumber")


@query("SELECT user_id AS qid, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS scheme, arg_max(event_type, event_id) AS type FROM events GROUP BY ALL")
def question_type_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of a user and scheme is the new type, the first the old one."""
    scheme = F.when(F.col("event_id") % 2 == 0, F.lit("a")).otherwise(F.lit("b"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("qid"), scheme.alias("scheme"))
    of = lambda f: rows.agg(f("event_type", "event_id").alias("type"))
    return merge.latest_types(of(F.min_by), of(F.max_by))


@query("SELECT lang AS type, count(*) AS n FROM documents GROUP BY lang")
def query_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("type")).agg(F.count("*").alias("n"))


@query("SELECT round(avg(n), 6) AS avg_rounds, max(n) AS max_rounds FROM (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id)")
def average_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    return n.agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("avg_rounds"), F.max("n").alias("max_rounds"))
