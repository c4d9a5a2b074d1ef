"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    Each round maps a node to the smallest of itself and its neighbours, follows that map
    twice, and contracts the edges; a round shrinks paths by half or better.  Minima are
    aggregated before the shuffle, so a hub costs no more than its edges.  The maps shrink
    with the edges; as soon as one is small it is sent out, so a large component's label
    does not gather its nodes in one task.

    Returns ``node, label``.  Null ends are dropped; an empty table gives no rows.
    """
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        step = cut(step)
        jump = small(step).select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = small(cut(step.join(jump, "to", "left").select("node", F.coalesce("to2", "to").alias("to"))))
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = step.select(F.col("node").alias("label"), "to")
            labels = cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        ends_a = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        ends_b = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        e = e.join(ends_a, "a").join(ends_b, "b").where("x <> y")
        e = cut(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
