"""Tables in buckets that grow by batches: what is stored is not shuffled again to be joined or merged.

A store is a log (``log.py``) of Parquet whose batches are all dealt into the same buckets by a
hash of one key, so Spark joins and groups it by that key where it lies: resuming shuffles only
the new rows, the last row of a key is found without a shuffle, and an append reads nothing of
what is stored.  Key, buckets and columns stand in the version, which is published at once.

The catalogue's entry is made anew at each read from the version that holds; it is external,
and dropping it deletes no file.  A bucket is read by one task and holds all rows of its keys, so
the key should be one whose rows are bounded: a document's chunks, say.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import WRITTEN, _delete, stored
from . import log

BATCH = "batch"
BUCKET_BYTES = 256 << 20  # of a bucket; compaction deals larger ones into more
BUCKET_ROWS = 1_000_000  # of a bucket: a task sorts and groups them, however few bytes they are
COMPACT_AFTER = 8  # batches: a bucket of a table has one file a batch


def _quoted(*names: str) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _bucketed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """One file a bucket, sorted by key, as a table of its own whose entry is dropped again."""
    name = f"lodestar_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")


def _enough(buckets: int, rows: int) -> int:
    """``buckets``, doubled until they hold at most ``BUCKET_ROWS`` on average."""
    while rows > BUCKET_ROWS * buckets:
        buckets *= 2
    return buckets


def _first(rows: DataFrame, path: str, key: str, buckets: int | None, anew: bool) -> log.Version:
    """``_put`` for a store's first batch: the rows are written and counted before they are dealt."""
    spark = rows.sparkSession
    draft = stored(rows, "batch")
    where = WRITTEN.pop()
    try:
        return _put(draft, path, key, _enough(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), draft.count()), anew)
    finally:
        _delete(spark, where)


def _put(rows: DataFrame, path: str, key: str, buckets: int, anew: bool, base: int | None = None) -> log.Version:
    held = log.version(rows.sparkSession, path)
    if BATCH in rows.columns:
        raise ValueError(f"{BATCH} is the store's own column")
    layout = {"key": key, "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)}
    if held is not None and held.layout:
        if not anew and held.layout["schema"] != layout["schema"]:
            raise ValueError(f"{path} holds {held.layout['schema']}, not {layout['schema']}")
        if not anew:
            layout = held.layout
    elif not anew and (held is not None or log.holds_files(rows.sparkSession, path)):
        raise ValueError(f"{path} holds files without buckets; rewrite them as a store")
    return log.write(rows, path, anew, "parquet", save=lambda r, p: _bucketed(r, p, layout["key"], layout["buckets"]), layout=layout, base=base)


def append(rows: DataFrame, path: str, key: str, buckets: int | None = None) -> log.Version:
    """Publish ``rows`` behind all that is there; a store that exists keeps its key and buckets, and its columns must be given.

    A new store has as many buckets as shuffles have partitions, unless told otherwise, and more if
    these would hold over ``BUCKET_ROWS``.
    """
    if exists(rows.sparkSession, path):
        return _put(rows, path, key, 0, False)
    return _first(rows, path, key, buckets, False)


def rewrite(rows: DataFrame, path: str, key: str, buckets: int | None = None) -> log.Version:
    """Publish ``rows`` in place of all that is there; they may be read from ``path`` itself."""
    return _first(rows, path, key, buckets, True)


def exists(spark: SparkSession, path: str) -> bool:
    held = log.version(spark, path)
    return held is not None and bool(held.layout)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the version that holds, with the name of their ``batch``; later batches have greater names."""
    held = log.version(spark, path)
    if held is None or not held.layout:
        raise FileNotFoundError(f"{path} holds no store")
    name, layout = f"lodestar_{hashlib.md5('|'.join((path, *held.batches)).encode()).hexdigest()}", held.layout
    root = path.rstrip("/").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({layout['schema']}, {BATCH} string) USING parquet PARTITIONED BY ({BATCH}) CLUSTERED BY ({_quoted(layout['key'])}) INTO {layout['buckets']} BUCKETS LOCATION '{root}'")
    for folder in held.batches:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({BATCH} = '{folder.removeprefix('batch=')}') LOCATION '{root}/{folder}'")
    return spark.table(name)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The same without ``batch``."""
    return read(spark, path).drop(BATCH)


def without(new: DataFrame, path: str, column: str | None = None) -> DataFrame:
    """``new`` rows whose key (``column``, else the store's own name of it) the store does not hold, and those without a key; only they are shuffled."""
    spark = new.sparkSession
    if not exists(spark, path):
        return new
    key = log.version(spark, path).layout["key"]
    held = read(spark, path).select(F.col(key).alias("_held"))
    # not sent out, however small it looks, and sorted, which may spill, not hashed
    return new.join(held.hint("merge"), F.col(column or key) == F.col("_held"), "left_anti")


def last(spark: SparkSession, path: str, *rest: str, order: Column | None = None, buckets: int = 0) -> DataFrame:
    """Of each key (the store's, and ``rest``) the row of the last batch; of several in it the greatest by ``order``, else by all fields.

    Grouped where it lies, as the store's key is among the columns grouped by; a store of fewer
    than ``buckets`` is dealt into so many first.
    """
    table, layout = read(spark, path), log.version(spark, path).layout
    keys = [layout["key"], *rest]
    table = table.repartition(buckets, keys[0]) if buckets > layout["buckets"] else table
    others = [c for c in table.columns if c not in (*keys, BATCH)]
    fields = F.struct(*others)
    rank = F.struct(F.col(BATCH), fields if order is None else order)
    return table.groupBy(*keys).agg(F.max_by(fields, rank).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in others)).select(*(c for c in table.columns if c != BATCH))


def _size(spark: SparkSession, path: str, held: log.Version) -> int:
    """Bytes of all batches, as the file system has them."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(fs.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{b}")).getLength() for b in held.batches)


def compact(spark: SparkSession, path: str, *rest: str, order: Column | None = None, bucket_bytes: int = BUCKET_BYTES) -> log.Version:
    """Rewrite the store with the last row of each key; the old version holds until the new one is published.

    Buckets are doubled until they hold at most ``bucket_bytes`` and ``BUCKET_ROWS`` on average.  ``log.Moved`` if a
    batch came in between, which then is not lost.
    """
    held = log.version(spark, path)
    buckets, size = held.layout["buckets"], _size(spark, path, held)
    while size > bucket_bytes * buckets:
        buckets *= 2
    buckets = _enough(buckets, read(spark, path).count())
    return _put(last(spark, path, *rest, order=order, buckets=buckets), path, held.layout["key"], buckets, True, held.number)


def compact_when_many(spark: SparkSession, path: str, *rest: str, after: int = COMPACT_AFTER, bucket_bytes: int = BUCKET_BYTES) -> bool:
    """``compact`` a store of over ``after`` batches, or of buckets twice too large, and delete what no version names any more; whether it was done."""
    held = log.version(spark, path)
    fits = len(held.batches) <= after and _size(spark, path, held) <= 2 * bucket_bytes * held.layout["buckets"]
    if fits and read(spark, path).count() <= 2 * BUCKET_ROWS * held.layout["buckets"]:
        return False
    try:
        compact(spark, path, *rest, bucket_bytes=bucket_bytes)
    except log.Moved:  # the next write will do it
        return False
    log.vacuum(spark, path)
    return True
