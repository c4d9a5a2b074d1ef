"""Components by contraction and PageRank by push: against plain Python, on paths, and on hubs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar import storage
from lodestar.operators import graph


def reach(pairs):
    low = {x: x for p in pairs for x in p}

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {x: root(x) for x in low}


@pytest.mark.parametrize("large", [False, True])
def test_components_of_random_graphs(spark, monkeypatch, large):
    if large:  # as if no map could be sent out
        monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randrange(900)}", f"n{rnd.randrange(900)}") for _ in range(500)] + [("x", "x"), ("y", "y"), ("y", "n1"), ("hub", "n2")]
    pairs += [("hub", f"leaf{i}") for i in range(2500)]
    edges = spark.createDataFrame([*pairs, (None, "n3"), ("n4", None)], "src string, dst string")
    rows = graph.components(edges).collect()
    assert {r["node"]: r["component"] for r in rows} == reach(pairs) and len(rows) == len(reach(pairs))
    assert graph.components(edges.limit(0)).count() == 0


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(graph, "stored", lambda df, name: steps.append(name) or storage.stored(df, name))
    path = spark.range(1, 100_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graph.components(path).agg(F.count("*").alias("n"), F.max("component").alias("c")).first()
    assert tuple(found) == (100_000, 1) and steps.count("step") < 30


def exact(pairs, start, rounds=400, alpha=0.85):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start = {n: w for n, w in start.items() if n in near}
    total = sum(start.values())
    score = {n: start.get(n, 0) / total for n in near}
    for _ in range(rounds):
        new = {n: (1 - alpha) * start.get(n, 0) / total for n in near}
        for n, s in score.items():
            for m in near[n]:
                new[m] += alpha * s / len(near[n])
        score = new
    return score, near


@pytest.mark.parametrize("epsilon", [1e-2, 1e-4])
def test_push_is_within_its_bound(spark, epsilon):
    rnd = random.Random(8)
    pairs = {(rnd.randrange(120), rnd.randrange(120)) for _ in range(260)} | {(0, i) for i in range(60)} | {(500, 501)}
    starts = {1: {3: 0.5, 0: 0.25, 999: 1.0}, 2: {7: 1.0}, 3: {500: 2.0}, 4: {999: 1.0}}
    edges = spark.createDataFrame(list(pairs), "src long, dst long")
    seeds = spark.createDataFrame([(q, n, w) for q, s in starts.items() for n, w in s.items()], "qid int, node long, weight double")
    got = {(r["qid"], r["node"]): (r["score"], r["bound"]) for r in graph.push_pagerank(edges, seeds, epsilon=epsilon, piece=8).collect()}
    assert {q for q, _ in got} == {1, 2, 3}
    for q in (1, 2, 3):
        want, near = exact(pairs, starts[q])
        for n, s in want.items():
            low, bound = got.get((q, n), (0.0, epsilon * len(near[n])))
            assert bound == pytest.approx(epsilon * len(near[n])) and low - 1e-12 <= s
        missing = sum(want.values()) - sum(s for (p, _), (s, _) in got.items() if p == q)
        assert -1e-9 <= missing <= epsilon * 2 * len(pairs)


def test_push_stays_around_its_seeds(spark):
    path = spark.range(0, 30_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seeds = spark.createDataFrame([(1, 500, 1.0)], "qid int, node long, weight double")
    got = graph.push_pagerank(path, seeds, epsilon=1e-5)
    assert 20 < got.count() < 400


def test_a_hub_is_dealt_over_many_tasks(spark):
    star = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    links = graph.adjacency(star)
    most = links.groupBy("src", "piece").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("pieces")).first()
    assert most["n"] < 2 * graph.PIECE and most["pieces"] > 1_000_000
    seeds = spark.createDataFrame([(1, 5, 1.0)], "qid int, node long, weight double")
    got = {r["node"]: r["score"] for r in graph.push_pagerank(star, seeds, epsilon=1e-3).where("node in (0, 5)").collect()}
    assert got[5] > 0.15 and 0.12 < got[0] < 0.5
