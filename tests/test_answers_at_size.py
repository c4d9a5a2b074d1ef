"""Answers over whole tables: what is asked, and what the steps behind it hold."""

import random

import pytest

from lodestar import plans
from lodestar.config import Config
from lodestar.functions import vectors
from lodestar.operators import graph, search, strategies

QUERIES, SQL = plans.load()


@pytest.fixture
def tables(spark, tmp_path):
    """Two conversations of three questions each, and documents that answer them."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{'Who' if t % 2 == 0 else 'Because'} Anna Bertram word{c}{t}?") for c in (1, 2) for t in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rnd = random.Random(5)
    names = ["Anna", "Bertram", "Carla", "Doris", "Emil", "Frieda"]
    docs = [(d, " ".join(rnd.choice(names) if rnd.random() < 0.3 else f"word{rnd.randrange(40)}." for _ in range(rnd.randrange(1, 900)))) for d in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_naive_answers_all_questions(spark, tables):
    made = QUERIES["answer_naive"](spark, tables)
    assert sorted(r["qid"] for r in made.collect()) == [1000, 1002, 1004, 2000, 2002, 2004]
    assert "qid % 100 = 0" not in SQL["answer_naive"] and "qid % 100 = 0" in SQL["naive_chunks"]


def test_edges_are_copied_for_each_task_not_for_each_block(spark):
    rnd = random.Random(3)
    edges = spark.createDataFrame([(rnd.randrange(90), rnd.randrange(90)) for _ in range(300)], "src long, dst long")
    seeds = spark.createDataFrame([(q, q, 1.0) for q in range(80)], "qid long, node long, weight double")
    made = graph.pagerank_best(edges, seeds, 3, 5, 1e-5, cells=100)  # a question at a time
    assert made.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert made.select("qid").distinct().count() > 60


def test_triplets_hold_no_texts(spark, tables):
    from lodestar.plans import answers

    assert "source_text" not in answers._world(answers._chunks(spark, tables)).triplets.columns


def test_hubs_send_their_edges_to_no_question(spark, monkeypatch):
    """Edges among many questions' nodes, all of which hold a hub: the same as from the hub's end, and with odd ends."""
    rnd = random.Random(4)
    edges = [(0, i, "r") for i in range(1, 300)] + [(rnd.randrange(300), rnd.randrange(300), "s") for _ in range(600)] + [(None, 3, "t"), (4, None, "t"), (5, 5, "l"), (1, 2, "r"), (1, 2, "r")]
    edges = spark.createDataFrame(edges, "src long, dst long, relation string")
    nodes = spark.createDataFrame([(q, n) for q in range(40) for n in {0, 5, *rnd.sample(range(300), 12)}], "qid long, node long")
    found = lambda: sorted(map(tuple, graph.induced(edges, nodes).select("qid", "src", "dst", "relation").collect()))
    want = found()
    monkeypatch.setattr(graph, "FRONT", 1)
    kept = []
    monkeypatch.setattr(graph, "looked_up", lambda rows, column, known, f=graph.looked_up: kept.append(column) or f(rows, column, known))
    assert found() == want and kept == ["src", "dst"]


@pytest.mark.parametrize("tokens", [90, 1200])
def test_passages_that_the_budget_reaches(spark, tables, tokens):
    """Answers from what the budget can reach are those from all passages, repeated chunks and empty budgets too."""
    from lodestar.plans import answers

    config = Config(context_tokens=tokens)
    chunks = answers._chunks(spark, tables).localCheckpoint()
    asked = spark.createDataFrame([(1, "Who is Anna?"), (2, "Does Carla know Doris or Emil?"), (3, "nothing of that")], "qid long, question string")
    world = strategies.graph_of(graph.extract(chunks))
    whole, naive = strategies.graph_passages(asked, world, chunks, config, rounds=4).localCheckpoint(), strategies.naive_passages(asked, chunks, 30, config).localCheckpoint()
    few, near = strategies.graph_marked(asked, world, chunks, config, rounds=4).localCheckpoint(), strategies.naive_marked(asked, chunks, 30, config).localCheckpoint()
    shown = lambda rows: sorted(map(tuple, search.contexts(rows, "qid", config).collect()))
    assert shown(strategies.within_budget(few, chunks, config)) == shown(whole)
    assert shown(strategies.within_budget(near, chunks, config)) == shown(naive)
    if tokens == 90:
        assert few.count() < whole.count()
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(strategies.hybrid(asked, near, few, config, chunks=chunks), strategies.hybrid(asked, naive, whole, config))
    a, _ = strategies.iterative(asked, lambda q: strategies.graph_passages(q, world, chunks, config, rounds=4), config)
    b, _ = strategies.iterative(asked, lambda q: strategies.graph_marked(q, world, chunks, config, rounds=4), config, chunks=chunks)
    assert same(a, b)


def test_texts_are_embedded_where_they_lie(spark):
    """No row for a token is shuffled; repeated keys share a vector, null ones have none, whatever white space parts the words."""
    rows = [(1, "a b\ta"), (2, None), (None, "a"), (3, "É x İ"), (3, "y"), (4, "  ")]
    df = spark.createDataFrame(rows, "k long, t string")
    made = vectors.embedded(df, "k", "t")

    plain = {}
    for r in vectors.token_counts(df.where("k is not null"), ["k"], "t").collect():
        plain.setdefault(r["k"], [0.0] * 64)[r["bucket"]] = r["value"]
    got = sorted(((r["k"], r["embedding"]) for r in made.collect()), key=repr)
    assert got == sorted(((k, plain.get(k, [0.0] * 64)) for k, _ in rows), key=repr)
    one = vectors.embedded(df.where("k = 1"), "k", "t")
    assert not {"Generate", "Window"} & set(one._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split())
