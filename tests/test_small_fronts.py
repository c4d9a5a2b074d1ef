"""Small fronts are sent out to the edges: these are not dealt by node for a few questions; large fronts give the same."""

import pytest

from lodestar.operators import graph

PAIRS = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 3), (4, 5), (None, 1)]


@pytest.fixture()
def tables(spark):
    edges = spark.createDataFrame(PAIRS, "src long, dst long")
    return edges, spark.createDataFrame([(1, 0, 1.0), (2, 3, 1.0), (3, 9, 1.0)], "qid int, node long, weight double")


WITHIN = {(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 3, 0), (2, 2, 1), (2, 1, 2), (3, 9, 0)}


def test_neighbourhoods_and_scores_look_nothing_up_for_all_edges(tables, monkeypatch):
    monkeypatch.setattr(graph, "looked_up", lambda *a: pytest.fail("the edges are joined with a table of all nodes"))
    edges, seeds = tables
    assert {tuple(r) for r in graph.within(edges, seeds).collect()} == WITHIN
    assert {r["node"] for r in graph.pagerank(edges, seeds, 2).where("qid = 1").collect()} == {0, 1, 2}


def test_large_fronts_give_the_same(tables, monkeypatch):
    edges, seeds = tables
    want = {(r["qid"], r["node"]): r["score"] for r in graph.pagerank(edges, seeds, 4).collect()}
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in graph.within(edges, seeds).collect()} == WITHIN
    got = {(r["qid"], r["node"]): r["score"] for r in graph.pagerank(edges, seeds, 4).collect()}
    assert got == pytest.approx(want) and {q for q, _ in got} == {1, 2}
