"""Shortest paths by searches that share the bits of numbers: against a search from each node."""

import random
from collections import deque

import pytest

from lodestar.config import Config
from lodestar.operators import graph


def searched(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best, seen = set(), set()
    for n in sorted(near):
        if n not in seen:
            part, todo = {n}, [n]
            while todo:
                for m in near[todo.pop()] - part:
                    part.add(m)
                    todo.append(m)
            seen |= part
            best = max(best, part, key=len)
    far = []
    for n in best:
        d, todo = {n: 0}, deque([n])
        while todo:
            x = todo.popleft()
            for m in near[x]:
                if m not in d:
                    d[m] = d[x] + 1
                    todo.append(m)
        far += [v for v in d.values() if v]
    return round(sum(far) / len(far), 4), max(far), len(best)


def graphs():
    rnd = random.Random(11)
    yield [(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(190)] + [("n1", "n1"), ("n1", "n2"), ("n2", "n1")]
    yield [(f"p{i:03}", f"p{i + 1:03}") for i in range(12)] + [("x", "y")]
    yield [("hub", f"leaf{i}") for i in range(130)] + [("hub", "hub")]


@pytest.mark.parametrize("pairs", list(graphs()))
def test_path_metrics_are_those_of_single_searches(spark, pairs):
    got = graph.path_metrics(spark.createDataFrame(pairs, "src string, dst string")).first()
    assert (got["avg_path"], got["diameter"], got["n_nodes"]) == pytest.approx(searched(pairs))


def test_limit_loop_and_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert tuple(graph.path_metrics(edges, Config(path_nodes=2)).first()) == (-1.0, -1, 3)
    assert tuple(graph.path_metrics(edges.limit(0)).first()) == (-1.0, -1, 0)
    assert tuple(graph.path_metrics(spark.createDataFrame([("a", "a")], edges.schema)).first()) == (0.0, 0, 1)
