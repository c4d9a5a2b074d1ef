"""The commands, from a corpus file to scores, run twice and resumed."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestar import __main__ as commands
from lodestar import jobs, schemas
from lodestar.config import DEFAULT
from lodestar.operators import strategies
from lodestar.providers import RULES
from lodestar.sources import readers, store


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    names = ["Anna", "Bertram", "Carla", "Doris", "Emil", "Frieda"]
    docs = [{"id": i, "title": f"T{i}", "context": f"{a} lives near {b}. {b} has known {a} for {i} years. " + "Nothing else is told of the two, who keep to themselves in winter. " * 2} for i, (a, b) in enumerate(zip(names, names[1:] + names[:1], strict=True))]
    (root / "corpus.json").write_text("\n".join(map(json.dumps, docs)))
    asks = [{"id": str(i), "question": f"Who lives near {names[i]}?", "answer": f"{names[i - 1]} lives near {names[i]}.", "question_type": None} for i in range(4)]
    (root / "questions.json").write_text("\n".join(map(json.dumps, asks)))
    return root


def run(spark, *args):
    commands.run(spark, commands.parser().parse_args([str(a) for a in args]))


def test_from_corpus_to_scores(spark, files):
    out, asks = files / "out", files / "questions.json"
    run(spark, "pipeline", files / "corpus.json", asks, out, "--method", "all")
    for method in jobs.METHODS:
        answers = {r["qid"]: r["answer"] for r in readers.read_answers(spark, f"{out}/answers/{method}").collect()}
        assert len(answers) == 4, method
        scores = spark.read.schema(schemas.EVALUATIONS).json(f"{out}/scores/{method}").collect()
        assert len(scores) == 4
        if method not in ("llm_direct",):
            assert any("lives near" in a for a in answers.values()), method
            assert any(r["faithfulness_soft"] is not None for r in scores), method
    before = store.rows(spark, f"{out}/embeddings").count()
    with (files / "corpus.json").open("a") as more:
        more.write("\n" + json.dumps({"id": 50, "text": "Gustav lives near Anna."}))
    run(spark, "process", "all", files / "corpus.json", out)  # only the new document is embedded and extracted
    assert store.rows(spark, f"{out}/embeddings").count() == before + 1 == readers.read_index(spark, f"{out}/index").count()
    stated = store.rows(spark, f"{out}/statements")
    assert stated.where("doc_id = 50").count() == 1 and stated.count() == stated.dropDuplicates(["subject", "relation", "object", "doc_id", "chunk_idx"]).count()
    run(spark, "retrieve", "naive", out, asks)
    assert spark.read.json(f"{out}/answers/naive").count() == 4
    run(spark, "evaluate", "result", "naive", out, asks)
    assert spark.read.json(f"{out}/scores/naive").count() == 4
    report = readers.read_report(spark, f"{out}/semantic", schemas.SEMANTIC).first()
    assert report["status"] == "success" and report["total_embeddings"] == before
    assert readers.read_report(spark, f"{out}/structure", schemas.STRUCTURE).first()["basic_stats"]["n_nodes"] > 5
    run(spark, "compare", "naive", "graph", out)
    assert spark.read.json(f"{out}/comparisons/naive-graph/comparison").count() == 4


def test_iterative_over_chunks_without_labels(spark, files):
    out, asks = files / "out", files / "questions.json"
    run(spark, "retrieve", "iterative", out, asks, "--retriever-type", "naive")
    assert readers.read_answers(spark, f"{out}/answers/iterative-naive").count() == 4
    run(spark, "evaluate", "result", "iterative", out, asks, "--retriever-type", "naive", "--skip-llm")
    scores = readers.read_evaluations(spark, f"{out}/scores/iterative-naive").collect()
    assert len(scores) == 4 and all(r["llm_label"] is None and r["coverage"] is not None for r in scores)


def test_hybrid_refuses_a_blank_context_itself(spark):
    asked = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", "q")], "qid string, question string")
    passages = spark.createDataFrame([("a", 0, "a text"), ("b", 0, " \n ")], "qid string, pos int, text string")
    model = replace(RULES, answer=lambda question, context: F.concat(F.lit("asked with "), context))
    found = {r["qid"]: r["answer"] for r in strategies.answered(asked, passages, "hybrid", providers=model).collect()}
    assert found == {"a": "asked with a text", "b": DEFAULT.refusal, "c": DEFAULT.refusal}


def test_retry_of_null_answers(spark, files):
    out, asks = files / "out", files / "questions.json"
    path = f"{out}/answers/graph"
    rows = spark.read.schema("id string, rag_answer string").json(path).collect()
    spark.createDataFrame([(r["id"], None if r["id"] == "2" else r["rag_answer"]) for r in rows], "id string, rag_answer string").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    run(spark, "retry", "graph", out, asks)
    after = {r["id"]: r["rag_answer"] for r in spark.read.schema("id string, rag_answer string").json(path).collect()}
    assert after == {r["id"]: r["rag_answer"] for r in rows} and after["2"]


def test_benchmark_questions(spark, files):
    out = files / "out"
    run(spark, "questions", "all", out, "--single-hop", "3", "--multi-hop", "4", "--summary", "2")
    raw = spark.read.parquet(f"{out}/questions").collect()
    assert len({r["id"] for r in raw}) == len(raw) and sum(r["type"] == "single_hop" for r in raw) == 3
    verdicts = spark.read.parquet(f"{out}/validated")
    assert verdicts.count() == len(raw)
    run(spark, "questions", "validate", out)
    assert verdicts.count() == len(raw)
    assert readers.read_queries(spark, f"{out}/final").count() == verdicts.where("overall").count()
    run(spark, "questions", "generate", out, "--append", "--single-hop", "2", "--multi-hop", "0", "--summary", "0")
    ids = [r["id"] for r in spark.read.parquet(f"{out}/questions").collect()]
    assert len(set(ids)) == len(ids) == len(raw) + 2


def test_question_types(spark, files):
    out, asks = files / "out", files / "questions.json"
    for _ in range(2):
        run(spark, "classify", "length", out, asks)
        assert {(r["qid"], r["scheme"]) for r in readers.read_typed(spark, f"{out}/types").collect()} == {(str(i), "length") for i in range(4)}
    typed = files / "typed.json"
    typed.write_text(json.dumps({"id": "0", "question": "q", "answer": "a", "question_type": "full_context"}))
    run(spark, "classify", "length", out, typed)
    found = {r["qid"]: r["type"] for r in readers.read_typed(spark, f"{out}/types").collect()}
    assert found["0"] == "full_context" and len(found) == 4


def test_a_graph_with_a_missing_part(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="vertices, edges, triplets, vectors"):
        readers.read_graph(spark, str(tmp_path))
