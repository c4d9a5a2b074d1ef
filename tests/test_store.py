"""Stores in buckets: plans without a shuffle of what is stored, the last row of a key, versions that hold."""

import re

import pytest
from pyspark.sql import functions as F

from lodestar.sources import log, store


def rows(spark, *values):
    return spark.createDataFrame(list(values), "doc_id long, chunk_idx int, text string")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def path(spark, tmp_path):
    p = f"{tmp_path}/store"
    store.append(rows(spark, (1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "n")), p, "doc_id", 4)
    store.append(rows(spark, (2, 0, "A"), (3, 0, None)), p, "doc_id")
    return p


def test_last_row_of_a_key(spark, path):
    want = [(1, 0, "a"), (1, 1, "b"), (2, 0, "A"), (3, 0, None), (None, 0, "n")]
    assert of(store.last(spark, path, "chunk_idx")) == sorted(want, key=repr)
    assert len(of(store.rows(spark, path))) == 6
    store.append(rows(spark, *((2, 0, f"old {i}") for i in range(500))), path, "doc_id")
    store.append(rows(spark, (2, 0, "0 new")), path, "doc_id")
    assert (2, 0, "0 new") in of(store.last(spark, path, "chunk_idx"))  # by batch, not by text


def test_stored_rows_are_not_shuffled(spark, path):
    store.append(rows(spark, *((i, 0, "x" * 50) for i in range(10, 5000))), path, "doc_id")
    many = spark.range(0, 6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("t"))
    todo = store.without(many, path)
    text = plan(todo)
    assert todo.count() == 6000 - 4993  # 1, 2, 3 and 10 to 4999 are held
    final = text.split("== Initial Plan ==")[0]
    assert "Bucketed: true" in final and "BroadcastExchange" not in final
    assert len(re.findall(r"\bExchange\b", final)) == 1  # of the new rows
    grouped = plan(store.last(spark, path, "chunk_idx"))
    assert "Exchange" not in grouped.split("== Initial Plan ==")[0]


def test_null_and_new_keys(spark, path):
    asked = spark.createDataFrame([(None, "x"), (1, "y"), (9, "z")], "doc_id long, t string")
    assert of(store.without(asked, path)) == [(9, "z"), (None, "x")]
    assert of(store.without(asked.withColumnRenamed("doc_id", "other"), path, "other")) == [(9, "z"), (None, "x")]
    assert of(store.without(asked, f"{path}-none")) == of(asked)


def test_compaction_and_a_write_that_dies(spark, path):
    before = of(store.last(spark, path, "chunk_idx"))

    def broken(_):
        raise ValueError("dies")

    bad = rows(spark, (7, 7, "x")).select("doc_id", "chunk_idx", F.udf(broken, "string")("text").alias("text"))
    with pytest.raises(Exception, match="dies"):
        store.append(bad, path, "doc_id")
    assert of(store.last(spark, path, "chunk_idx")) == before
    store.compact(spark, path, "chunk_idx")
    assert of(store.rows(spark, path)) == before and len(log.version(spark, path).batches) == 1
    assert log.vacuum(spark, path, kept=1) >= 2
    assert of(store.rows(spark, path)) == before and of(store.last(spark, path, "chunk_idx")) == before


def test_compaction_when_there_are_many_batches(spark, path):
    assert not store.compact_when_many(spark, path, "chunk_idx")
    assert store.compact_when_many(spark, path, "chunk_idx", after=1)
    assert len(log.version(spark, path).batches) == 1
    before = of(store.rows(spark, path))
    assert store.compact_when_many(spark, path, "chunk_idx", bucket_bytes=200) and log.version(spark, path).layout["buckets"] > 4
    assert of(store.rows(spark, path)) == before and of(store.last(spark, path, "chunk_idx")) == before


def test_a_batch_that_comes_during_compaction(spark, path):
    held, seen = log.version(spark, path), of(store.last(spark, path, "chunk_idx"))
    slow = store.last(spark, path, "chunk_idx")
    store.append(rows(spark, (5, 0, "meanwhile")), path, "doc_id")
    with pytest.raises(log.Moved):
        store._put(slow, path, "doc_id", 4, True, held.number)
    assert (5, 0, "meanwhile") in of(store.last(spark, path, "chunk_idx")) and len(of(store.last(spark, path, "chunk_idx"))) == len(seen) + 1


def test_other_columns_and_empty_stores(spark, path, tmp_path):
    with pytest.raises(ValueError, match="holds"):
        store.append(spark.createDataFrame([(1, 2)], "doc_id long, other int"), path, "doc_id")
    with pytest.raises(ValueError, match="own column"):
        store.append(rows(spark).withColumn("batch", F.lit(1)), path, "doc_id")
    with pytest.raises(FileNotFoundError):
        store.read(spark, f"{tmp_path}/none")
    none = f"{tmp_path}/empty"
    store.append(rows(spark), none, "doc_id", 4)
    assert of(store.last(spark, none, "chunk_idx")) == [] and store.without(rows(spark, (1, 0, "a")), none).count() == 1
