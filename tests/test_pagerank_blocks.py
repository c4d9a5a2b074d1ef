"""PageRank by blocks of questions: against the rounds that have a row for each node and question."""

import random

import pytest

from lodestar.operators import graph, strategies


@pytest.mark.parametrize("cells", [60, 700, 1_000_000])
def test_blocks_give_the_best_of_the_rounds(spark, cells):
    rnd = random.Random(3)
    pairs = {(rnd.randrange(200), rnd.randrange(200)) for _ in range(400)} | {(0, i) for i in range(200, 260)} | {(7, 7)}
    edges = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")
    seeds = [(f"q{q}", n, w) for q in range(12) for n, w in ((0, 0.5), (q, 0.25), (rnd.randrange(200), 1.0), (10_000, 1.0))] + [("gone", 10_000, 1.0)]
    seeds = spark.createDataFrame([(q, n, w) for (q, n), w in {(q, n): w for q, n, w in seeds}.items()], "qid string, node long, weight double")
    want = {(r["qid"], r["node"]): r["score"] for r in graph.pagerank(edges, seeds, 12).collect()}
    got = {(r["qid"], r["node"]): r["score"] for r in graph.pagerank_best(edges, seeds, 12, 30, 1e-5, cells=cells).collect()}
    assert all(s == pytest.approx(want[k], abs=1e-14) for k, s in got.items())
    for q in {k[0] for k in want}:
        ranked = sorted(((-round(s, 12), n) for (p, n), s in want.items() if p == q and s >= 1e-5))[:30]
        assert {n for _, n in ranked} <= {n for p, n in got if p == q}
        assert len([n for p, n in got if p == q]) < 120  # not a row for each of the 260 nodes
    assert "gone" not in {q for q, _ in got}


def test_no_edges_give_no_scores(spark):
    edges, seeds = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1, 0, 1.0)], "qid long, node long, weight double")
    assert graph.pagerank_best(edges, seeds, 3, 10, 0.0001).count() == 0


def test_answers_hold_no_row_for_each_node(spark, monkeypatch):
    monkeypatch.setattr(graph, "pagerank", lambda *a, **k: pytest.fail("a row for each question and node"))
    chunks = spark.createDataFrame([(1, 0, "Anna Bert Carla Doris. Emil Anna")], "doc_id long, chunk_idx int, text string")
    asked = spark.createDataFrame([(1, "Who is Anna?")], "qid long, question string")
    assert strategies.graph_search(asked, strategies.graph_of(graph.extract(chunks)), rounds=12).nodes.count() > 1
