"""No group of the packing grows with how often one id, or none, stands in the table."""

import pytest
from pyspark.sql import functions as F

from lodestar.llm import packing
from lodestar.storage import cut


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_rows_of_one_id_are_dealt_over_the_groups(spark, doc_id):
    n = 40_000
    one = spark.range(n, numPartitions=8).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 700 + 1).alias("length"))
    packed = cut(packing.pack(cut(one), group=4000))
    groups = packed.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in groups) == n
    assert len(groups) > 5 and max(r["n"] for r in groups) < n / 2
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.max("sequence_tokens").alias("s"))
    assert full.where("t <> s or t > 1024").count() == 0
    assert full.agg(F.avg("t")).first()[0] > 950


def test_pieces_of_a_document_stay_in_few_groups(spark):
    rows = spark.range(2000, numPartitions=1).select(F.floor(F.col("id") / 20).alias("doc_id"), (F.col("id") % 20 * 1024).alias("start"), F.lit(1000).cast("long").alias("length"))
    packed = packing.pack(cut(rows), group=100)
    groups = packed.groupBy("doc_id").agg(F.countDistinct(F.shiftright("sequence_id", 32)).alias("n")).agg(F.max("n")).first()[0]
    assert groups <= 2
