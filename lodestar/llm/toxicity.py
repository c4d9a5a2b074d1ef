"""Toxicity by a linear classifier over character n-grams that naive Bayes ratios scale.

Every n-gram of code points of the lower-cased text falls into one of ``2 ** BITS`` hash
buckets; a document has or has not a bucket.  On labelled rows, the log-count ratio of a
bucket compares how often toxic and other documents have it.  The buckets whose ratio is
best supported are kept, the ratio is their feature's value, and logistic regression is
fitted on those.  Scoring adds up one weight for each bucket that a text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, slices

BITS = 18
ORDERS = (3, 4, 5)
ROWS = 16_000  # at most so many labelled rows are fitted on
FEATURES = 4096
SMOOTH = 1.0
REGULARISATION = 1e-4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str | None, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The bucket of each n-gram of the text, with repeats; runs of white space count as one space."""
    codes = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in orders:
            out.append(((h ^ np.uint64(n)) * GOLDEN) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``doc_id, label``, the first in the order of a hash of the id."""
    keyed = labelled.withColumn("draw", F.xxhash64("doc_id", F.lit("toxicity")))
    return keyed.orderBy("draw", "doc_id").limit(rows).select("doc_id", "label")


class Model:
    """``slot`` maps a bucket to its feature (or the last one, of weight zero)."""

    def __init__(self, slot: np.ndarray, weights: np.ndarray, intercept: float, bits: int, orders: tuple[int, ...]) -> None:
        self.slot, self.weights, self.intercept, self.bits, self.orders = slot, weights, intercept, bits, orders

    def score(self, text: str | None) -> float:
        has = np.zeros(len(self.weights), bool)
        has[self.slot[buckets(text, self.bits, self.orders)]] = True
        with np.errstate(over="ignore"):
            return float(1 / (1 + np.exp(-(self.intercept + self.weights[has].sum()))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, features: int = FEATURES, bits: int = BITS, orders: tuple[int, ...] = ORDERS, smooth: float = SMOOTH) -> Model:
    """Fit on ``docs`` (``doc_id, text``) joined with ``labels`` (``doc_id, label`` of 0 or 1).

    Rows with a null id or label are left out; an id that has both labels counts as 1.  With
    rows of one class only the model gives every text the score of that class, and 0 with no
    rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    drawn = _sample(known, rows)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "text"]).repartition(12))  # drawn: at most ``rows`` rows
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    slot, n = np.full(1 << bits, features, np.int64), sum(totals.values())
    if len(totals) < 2:
        share = totals.get(1, 0) / n if n else 0.0
        return Model(slot, np.zeros(features + 1), -np.inf if share == 0 else np.inf, bits, orders)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
                seen[label.as_py(), np.unique(buckets(text.as_py(), bits, orders))] += 1
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["bucket", "clean", "toxic"])

    counts = sample.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + smooth) / (totals[1] + 2 * smooth)) - F.log((F.col("clean") + smooth) / (totals[0] + 2 * smooth))
    support = F.abs("ratio") / F.sqrt(1 / (F.col("toxic") + smooth) + 1 / (F.col("clean") + smooth))
    best = counts.withColumn("ratio", ratio).withColumn("support", support).orderBy(F.desc("support"), "bucket").limit(features).collect()
    slot[[r["bucket"] for r in best]] = np.arange(len(best))
    ratios = np.array([r["ratio"] for r in best])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [np.unique(slot[buckets(x.as_py(), bits, orders)]) for x in batch.column("text")]
            has = [x[x < len(ratios)] for x in has]
            sparse = pa.StructArray.from_arrays(
                [pa.array([0] * len(has), pa.int8()), pa.array([len(ratios)] * len(has), pa.int32()), pa.array([x.astype(np.int32) for x in has], pa.list_(pa.int32())), pa.array([ratios[x] for x in has], pa.list_(pa.float64()))],
                ["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.float64()), sparse], ["label", "features"])

    points = sample.select("text", "label").mapInArrow(encode, StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))
    fitted = LogisticRegression(maxIter=60, regParam=REGULARISATION, standardization=False, tol=1e-7).fit(points)
    weights = np.zeros(features + 1)
    weights[: len(ratios)] = np.asarray(fitted.coefficients) * ratios
    return Model(slot, weights, float(fitted.intercept), bits, orders)


def score(docs: DataFrame, model: Model, to: str = "toxicity") -> DataFrame:
    """Add ``to`` (0 to 1) to every row of ``docs``, in place of a column of that name; only ``text`` is read.

    A null text counts as empty and gets what the model gives an empty text.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # its size is fixed by ``bits`` and ``features``
    docs = docs.drop(to)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{to}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value)
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            scores = pa.array([model.score(x.as_py()) for x in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, to])

    return docs.mapInArrow(run, schema)
