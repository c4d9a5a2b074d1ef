"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, small, stored, table, together

__all__ = ["cut", "fold", "light_batches", "slices", "small", "spread_join", "stored", "table", "together", "unused"]

BATCH_BYTES = 4 << 20  # of an Arrow batch
HOT = 10_000  # a key with over one in so many rows is hot, so there are at most as many hot keys


def unused(df: DataFrame, stem: str) -> str:
    """A column name with which no name in ``df`` begins, in either case."""
    taken = [c.lower() for c in df.columns]
    return next(p for p in (f"_{stem}{i}_" for i in range(10_000)) if not any(c.startswith(p) for c in taken))


def fold(doc_id: str = "doc_id") -> F.Column:
    """Fold 0 is held out; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def light_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Send rows to Python in batches of about ``most`` bytes for the rest of the session, whatever their number.

    Otherwise a batch has 10,000 rows: whole texts, of which a task holds several copies, in
    buffers that double and that neither the JVM nor a worker gives back between stages.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bytes_of(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def bytes_of(size: str) -> int:
    """A setting's bytes: a number and perhaps a unit; one without a bound is below zero and counts as endless."""
    number = size.lower().rstrip("bkmgt")
    n = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(size.lower()[len(number) : len(number) + 1], 0)
    return n if n >= 0 else 1 << 62


def slices(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about ``most`` bytes of text (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def spread_join(many: DataFrame, keys: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join with a table of distinct keys that are not null, whose hot ones shuffle nothing.

    ``keys`` has in ``n`` how many rows of ``many`` hold the key.  A key with more than one in
    ``HOT`` of those rows is hot: there are fewer than ``HOT`` such keys, which are broadcast.
    Both inputs are read twice and should be cut or stored.
    """
    total = keys.agg(F.sum(n).alias("total")).first()["total"] or 0
    hot = keys.where(F.col(n) > max(total / HOT, 1000))
    if hot.isEmpty():
        return many.join(keys, on)
    hot = cut(hot)
    rest = many.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(F.col(n) <= max(total / HOT, 1000)), on)
    return together(many.join(F.broadcast(hot), on), rest)
