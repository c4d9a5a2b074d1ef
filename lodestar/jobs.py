"""Jobs over folders: each reads what earlier jobs wrote, does what is still to do, and writes.

    out/chunks, out/embeddings, out/index, out/statements, out/failed, out/graph
    out/answers/METHOD, out/retrievals/METHOD, out/scores/METHOD, out/semantic, out/structure
    out/questions (raw), out/validated, out/final, out/types

A job that is run again goes on where it ended: documents that are embedded or extracted
and questions that are answered or scored are left out by anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import DEFAULT, Config
from .functions.text import chunks as chunked
from .operators import evaluate, generate, graph, index, merge, strategies, validate
from .providers import RULES, Providers
from .sources import readers, store, writers
from .storage import cut, together

METHODS = ["llm_direct", "naive", "graph", "hybrid", "iterative"]
BASES = ["graph", "naive"]  # what iterative answering retrieves by


def stored_as(method: str, base: str = "graph") -> str:
    """The folder's name of a method: iterative answering over another base than the graph has its own."""
    return f"{method}-{base}" if method == "iterative" and base != "graph" else method


def chunk(spark: SparkSession, corpus: str, out: str, config: Config = DEFAULT) -> None:
    rows = chunked(readers.read_corpus(spark, corpus), config).withColumn("row_id", F.xxhash64("doc_id", "chunk_idx"))
    rows.write.mode("overwrite").parquet(f"{out}/chunks")


def _without(rows: DataFrame, path: str, key: str) -> DataFrame:
    """``rows`` whose key ``path`` does not hold yet."""
    spark = rows.sparkSession
    return rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if readers.exists(spark, path) else rows


def embed(spark: SparkSession, out: str, resume: bool = True, providers: Providers = RULES) -> None:
    """Vectors of the chunks whose document has none yet, appended."""
    rows, path = spark.read.parquet(f"{out}/chunks"), f"{out}/embeddings"
    todo = cut(store.without(rows, path) if resume else rows)
    made = providers.embed(todo, "row_id", "text")
    writers.write_embeddings(todo.join(made, "row_id").select("row_id", "doc_id", "chunk_idx", "text", "embedding"), path, "append" if resume else "overwrite")


def build_index(spark: SparkSession, out: str) -> None:
    writers.write_index(readers.read_stored(spark, f"{out}/embeddings"), f"{out}/index")


def extract(spark: SparkSession, out: str, resume: bool = True, providers: Providers = RULES) -> None:
    """Statements of the chunks whose document has none yet, appended; chunks that failed are tried again.

    The extractor takes chunks and gives statements; if it adds a ``status``, the rows that
    failed go to ``out/failed`` and are taken up by the next run.
    """
    rows, path, failed = spark.read.parquet(f"{out}/chunks"), f"{out}/statements", f"{out}/failed"
    todo = rows
    if resume and readers.exists(spark, f"{out}/extracted"):
        todo = store.without(rows, f"{out}/extracted")
        if readers.exists(spark, failed):
            again = rows.join(readers.read_failed(spark, failed).select("doc_id", "chunk_idx"), ["doc_id", "chunk_idx"], "left_semi")
            todo = todo.unionByName(again).distinct()
    todo = cut(todo)
    made = cut(providers.extract_triplets(todo))
    if "status" in made.columns:
        bad = made.where("status = 'failed'").select("doc_id", "chunk_idx", F.col("source_text").alias("chunk_text"), (F.col("error") if "error" in made.columns else F.lit("unparsed")).alias("error"), "status")
        writers.write_failed(bad, failed)
        made = made.where("status <> 'failed'").drop("status", "error")
    writers.write_triplets(graph.valid(made), path, "append" if resume else "overwrite")
    writers.write_done(todo, f"{out}/extracted", "append" if resume else "overwrite")


def build_graph(spark: SparkSession, out: str, providers: Providers = RULES) -> None:
    world = strategies.graph_of(readers.read_statements(spark, f"{out}/statements"), providers)
    writers.write_graph(world.names, world.edges, world.triplets, world.vectors, f"{out}/graph")


def process(spark: SparkSession, corpus: str, out: str, resume: bool = True, providers: Providers = RULES) -> None:
    chunk(spark, corpus, out)
    embed(spark, out, resume, providers)
    build_index(spark, out)
    extract(spark, out, resume, providers)
    build_graph(spark, out, providers)


def world_of(spark: SparkSession, out: str) -> strategies.Graph:
    parts = readers.read_graph(spark, f"{out}/graph")
    return strategies.Graph(parts["triplets"], parts["vertices"], parts["edges"], parts["vectors"])


def _append_answers(made: DataFrame, out: str, method: str) -> None:
    name = "llm_answer" if method == "llm_direct" else "rag_answer"
    rows = made.select(F.col("qid").cast("string").alias("id"), F.col("answer").alias(name), *([F.col("rounds").cast("int")] if "rounds" in made.columns else []))
    writers.append_rows(rows, f"{out}/answers/{method}")


def retrieve(spark: SparkSession, method: str, out: str, questions: str, resume: bool = True, config: Config = DEFAULT, providers: Providers = RULES, base: str = "graph") -> None:
    """Answers of a method, and what it retrieved, for the questions that have none yet; ``base`` is what iterative answering retrieves by."""
    name = stored_as(method, base)
    asked, path = readers.read_questions(spark, questions).select("qid", "question"), f"{out}/answers/{name}"
    if resume and readers.exists(spark, path):
        asked = merge.unanswered(asked, readers.held_answers(spark, path).select(F.col("id").alias("qid"), F.coalesce("rag_answer", "llm_answer").alias("answer")))
    asked = cut(asked)
    if asked.isEmpty():
        return
    if method == "llm_direct":
        return _append_answers(strategies.direct(asked, providers), out, method)
    rows, found = spark.read.parquet(f"{out}/chunks"), f"{out}/retrievals/{name}"
    if method == "naive":
        vectors = readers.read_index(spark, f"{out}/index").select(F.col("row_id").alias("item_id"), "embedding")
        near = cut(strategies.naive_passages(asked, rows, config.top_k, config, providers, vectors))
        writers.append_rows(strategies.ranked(near).select(F.col("qid").alias("id"), "chunks"), found)
        return _append_answers(strategies.answered(asked, near, method, config, providers), out, method)
    if method == "graph":
        seen = strategies.graph_search(asked, world_of(spark, out), config, providers)
        passages = cut(strategies.source_passages(seen.sources, rows))
        writers.write_subgraphs(seen.nodes, seen.triplets, strategies.ranked(passages), found, "append")
        return _append_answers(strategies.answered(asked, passages, method, config, providers), out, method)
    if method == "hybrid":
        lists = {m: f"{out}/retrievals/{m}" for m in ("naive", "graph")}
        if lacking := [m for m, p in lists.items() if not readers.exists(spark, p)]:
            raise FileNotFoundError(f"no retrievals of {', '.join(lacking)}")
        near, by_graph = (readers.read_passages(spark, lists[m], c).join(asked.select("qid"), "qid", "left_semi") for m, c in (("naive", "chunks"), ("graph", "source_sentences")))
        merged = cut(merge.interleave(near, by_graph))
        both = asked.join(merged.select("qid").distinct(), "qid")
        writers.append_rows(strategies.ranked(merged.withColumn("similarity", F.lit(None).cast("double"))).select(F.col("qid").alias("id"), F.col("chunks").alias("retrieved_chunks")), found)
        return _append_answers(strategies.answered(both, merged, method, config, providers), out, method)
    if base == "naive":
        vectors = readers.read_index(spark, f"{out}/index").select(F.col("row_id").alias("item_id"), "embedding")
        passages = lambda q: strategies.naive_passages(q, rows, config.top_k, config, providers, vectors)
    else:
        world = world_of(spark, out)
        passages = lambda q: strategies.graph_passages(q, world, rows, config, providers)
    made, history = strategies.iterative(asked, passages, config, providers)
    writers.write_history(history, found, "append")
    return _append_answers(made, out, name)


def retry(spark: SparkSession, method: str, out: str, questions: str) -> None:
    """Null answers again, from the stored passages; the answers are rewritten at once, with all their fields."""
    asked, path = readers.read_questions(spark, questions).select("qid", "question"), f"{out}/answers/{method}"
    held = cut(readers.held_answers(spark, path))
    given = held.select(F.col("id").alias("qid"), F.coalesce("rag_answer", "llm_answer").alias("answer"))
    again = strategies.retried(asked, given, readers.read_retrievals(spark, f"{out}/retrievals/{method}"))
    new = again.where("answer is not null").select(F.col("qid").alias("id"), F.col("answer").alias("new"))
    rows = held.join(new, "id", "left").withColumn("rag_answer", F.coalesce("rag_answer", "llm_answer", "new")).drop("new")
    writers.replace_rows(rows.withColumn("rag_answer", F.when(F.col("llm_answer").isNull(), F.col("rag_answer"))), path)


def evaluate_answers(spark: SparkSession, method: str, out: str, questions: str, resume: bool = True, labels_only: bool = False, providers: Providers | None = None, labels: bool = True, base: str = "graph") -> None:
    """Scores of a method's answers against what it retrieved, for those without scores; appended.  Without ``labels`` none are judged."""
    method = stored_as(method, base)
    asked = readers.read_questions(spark, questions).select("qid", F.col("answer").alias("reference"))
    given = readers.read_answers(spark, f"{out}/answers/{method}").select("qid", F.col("answer").alias("prediction"))
    path, kept = f"{out}/scores/{method}", f"{out}/retrievals/{method}"
    retrieved = readers.read_retrievals(spark, kept) if method != "llm_direct" and readers.exists(spark, kept) else None
    done = readers.read_evaluations(spark, path).select(F.col("id").alias("qid")) if resume and readers.exists(spark, path) else None
    pairs = cut(evaluate.to_evaluate(asked, given, retrieved, done))
    made = evaluate.judged(pairs) if labels_only else evaluate.all_metrics(pairs, providers=providers, labels=labels)
    made = made.withColumnRenamed("qid", "id").withColumn("llm_reason", F.lit(""))
    writers.put_rows(made, path, "append" if resume else "overwrite")


def compare(spark: SparkSession, a: str, b: str, out: str) -> None:
    labels = None
    for method in (a, b):
        own = readers.read_evaluations(spark, f"{out}/scores/{method}").select(F.col("id").alias("qid"), F.lit(method).alias("method"), "llm_label")
        labels = own if labels is None else together(labels, own)
    writers.write_comparison(labels, evaluate.compared(labels, a, b), a, b, f"{out}/comparisons/{a}-{b}")


def evaluate_semantic(spark: SparkSession, out: str, k: int = DEFAULT.hub_neighbours) -> None:
    vectors = readers.read_index(spark, f"{out}/index").select(F.col("row_id").alias("item_id"), "embedding")
    writers.write_metrics(evaluate.semantic_report(cut(vectors), k), f"{out}/semantic")


def evaluate_structure(spark: SparkSession, out: str) -> None:
    parts = readers.read_graph(spark, f"{out}/graph")
    writers.write_metrics(evaluate.structure_report(parts["vertices"].select(F.col("entity_id").alias("node")), parts["edges"]), f"{out}/structure")


def generate_questions(spark: SparkSession, out: str, n_single: int, n_multi: int, n_summary: int, append: bool = False, providers: Providers = RULES) -> None:
    """Step 1: raw questions; appended ones go on in the numbers of those there."""
    rows, path = spark.read.parquet(f"{out}/chunks"), f"{out}/questions"
    held = cut(index.entity_chunks(readers.read_statements(spark, f"{out}/statements")))
    first = {r["type"]: r["next"] for r in merge.next_number(spark.read.parquet(path)).collect()} if append and readers.exists(spark, path) else {}  # a row a type
    made = generate.generated(generate.samples(held, rows, n_single, n_summary), rows, n_single, n_multi, n_summary, first, providers=providers)
    made.write.mode("append" if append else "overwrite").parquet(path)


def validate_questions(spark: SparkSession, out: str, resume: bool = True) -> None:
    """Step 2: verdicts on the raw questions that have none; appended."""
    path = f"{out}/validated"
    raw = spark.read.parquet(f"{out}/questions")
    todo = cut(_without(raw, path, "id") if resume else raw)
    verdicts = generate.checked(todo.select("id", "type", "question", "answer", "facts"))
    todo.join(verdicts.drop("type"), "id").write.mode("append" if resume else "overwrite").parquet(path)


def filter_questions(spark: SparkSession, out: str) -> None:
    """Step 3: the questions that passed, as JSON lines by type and id."""
    rows = validate.passed(spark.read.parquet(f"{out}/validated"))
    facts = F.transform(F.arrays_zip("doc_ids", "facts"), lambda x: F.struct(x["doc_ids"].alias("doc_id"), x["facts"].alias("text")))
    writers.write_queries(rows.select("id", "question", "answer", facts.alias("supporting_facts"), "type", F.lit("").alias("reasoning"), "bridges", "entity", "num_hops"), f"{out}/final")


def classify(spark: SparkSession, out: str, questions: str, scheme: str, providers: Providers = RULES) -> None:
    """Types of all questions: those that come with the questions are taken over; else what has none is classified."""
    asked, path = readers.read_questions(spark, questions), f"{out}/types"
    known = cut(readers.read_typed(spark, path)) if readers.exists(spark, path) else spark.createDataFrame([], "qid string, scheme string, type string")
    given = cut(readers.embedded_types(asked, scheme))
    if given.isEmpty():
        todo = asked.join(known.where(F.col("scheme") == scheme).select("qid"), "qid", "left_anti")
        given = todo.select("qid", F.lit(scheme).alias("scheme"), providers.classify(F.col("question")).alias("type"))
    writers.write_types(cut(merge.latest_types(known, given)), path)


def pipeline(spark: SparkSession, corpus: str, questions: str, out: str, methods: list[str], skip_process: bool = False, skip_eval: bool = False, resume: bool = True, labels: bool = True, base: str = "graph") -> None:
    """Processing, retrieval and evaluation one after another; hybrid needs naive and graph before."""
    if not skip_process:
        process(spark, corpus, out, resume)
    for method in (m for m in METHODS if m in methods):
        retrieve(spark, method, out, questions, resume, base=base)
        if not skip_eval:
            evaluate_answers(spark, method, out, questions, resume, labels=labels, base=base)
    if not skip_eval:
        evaluate_semantic(spark, out)
        evaluate_structure(spark, out)
