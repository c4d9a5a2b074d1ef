"""Clustering shuffles numbers for its candidates, not names."""

from lodestar import storage
from lodestar.operators import graph


def test_candidates_are_numbers(spark, monkeypatch):
    kinds = {}
    monkeypatch.setattr(graph, "stored", lambda df, name: kinds.setdefault(name, dict(df.dtypes)) and storage.stored(df, name))
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "d"), (None, "a")], "src string, dst string")
    vertices = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "node string")
    found = graph.clustering(vertices, edges).first()
    assert tuple(found) == (round((1 + 1 + 1 / 3) / 5, 6), 5)
    assert kinds["pairs"] == {"a": "bigint", "b": "bigint"}
    assert tuple(graph.clustering(vertices.limit(0), edges.limit(0)).first()) == (None, 0)
