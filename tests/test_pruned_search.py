"""Search by cells gives the rows of the search in blocks, and leaves most cells out where vectors are clustered."""

import numpy as np
import pytest

from lodestar.operators import search

SHAPE = "item_id long, embedding array<double>"


def table(spark, vectors):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], SHAPE).repartition(4)


def both(spark, vectors, k, cell, skip_self, queries=None):
    items = table(spark, vectors)
    asked = (items.where("item_id % 5 = 0") if queries is None else table(spark, queries)).withColumnRenamed("item_id", "qid")
    made = search.pruned_top_k(asked, items, k, skip_self=skip_self, cell=cell)
    rows = lambda df: sorted((r["qid"], r["item_id"], round(r["similarity"], 9), r["rank"]) for r in df.collect())
    assert rows(made.found) == rows(search.block_top_k(asked, items, k, skip_self=skip_self))
    return made


@pytest.mark.parametrize("skip_self", [False, True])
def test_clustered_vectors(spark, skip_self):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = np.concatenate([c + 0.05 * rng.normal(size=(60, 16)) for c in centres])
    made = both(spark, vectors, 5, 64, skip_self)
    assert made.compared < 0.2 * made.pairs


def test_equal_and_zero_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(500, 6))
    vectors[100:300] = vectors[7]  # more than a cell
    vectors[300:340] = 0
    made = both(spark, vectors, 4, 32, False, np.concatenate([vectors[:40], vectors[295:310]]))
    assert made.compared <= made.pairs


def test_fewer_items_than_are_asked_for(spark):
    rng = np.random.default_rng(7)
    both(spark, rng.normal(size=(6, 4)), 10, 2, False)
    both(spark, np.zeros((5, 4)), 3, 2, False)
    items = table(spark, np.ones((3, 2)))
    assert search.pruned_top_k(items.withColumnRenamed("item_id", "qid"), items.limit(0), 2).found.count() == 0


def test_where_nothing_can_be_left_out_a_query_goes_once_to_each_block(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 32))  # all about equally far apart
    written = []

    def noted(df, name, put=search.stored):
        made = put(df, name)
        written.append((name, made.count()))
        return made

    put, search.stored = search.stored, noted
    try:
        items = table(spark, vectors)
        asked = items.withColumnRenamed("item_id", "qid")
        made = search.pruned_top_k(asked, items, 3, skip_self=True, cell=16, block=300)
    finally:
        search.stored = put
    assert made.compared > 0.9 * made.pairs
    blocks = -(-900 // 300)
    assert [n for name, n in written if name == "asked"][1] <= 900 * (blocks + 1)  # not once for each cell
    rows = lambda df: sorted((r["qid"], r["item_id"], round(r["similarity"], 9), r["rank"]) for r in df.collect())
    assert rows(made.found) == rows(search.block_top_k(asked, items, 3, skip_self=True))


def test_few_rows_meet_many_cells_at_once():
    from lodestar.operators.search import AT_ONCE, _slices
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000))], ["qid"])
    parts = list(_slices([batch], 4000))
    assert max(p.num_rows for p in parts) * 4000 <= AT_ONCE and sum(p.num_rows for p in parts) == 10_000


def test_near_ties_are_told_in_doubles(spark):
    """Items that differ by less than a float's error keep the order of ``block_top_k``."""
    base = np.random.default_rng(9).normal(size=8)
    rows = [(i, [float(x) for x in base + 1e-8 * (i % 37) * np.eye(8)[i % 8]]) for i in range(400)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>").localCheckpoint()
    asked = items.where("item_id % 40 = 0").withColumnRenamed("item_id", "qid")
    shown = lambda found: sorted((r["qid"], r["rank"], r["item_id"]) for r in found.collect())
    assert shown(search.pruned_top_k(asked, items, 9, cell=16, block=50).found) == shown(search.block_top_k(asked, items, 9))
