"""Where intermediate tables lie, and how small ones are sent out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANY = 1_000_000
BROADCAST_ROWS = 200_000  # of a few short columns: some MB
HOT = 10_000  # a key with over one in so many rows is hot, so there are fewer than so many hot keys
TASK_ROWS = 500_000  # that a task groups or sorts
ROW_GROUP = 16 << 20  # bytes: what each task holds back in memory while it writes
WRITTEN: list[str] = []  # paths of stored tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all machines share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may lack it: it
    gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    A checkpoint goes on claiming the partitioning of the plan that made it, which adaptive
    execution may have changed since, and joins would trust the claim.  A coalesce to more
    partitions than there are moves nothing and claims nothing.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True).coalesce(MANY)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new path in the checkpoint folder and read it again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has written in this program, once no result that rests on them is needed; how many."""
    n = 0
    while WRITTEN:
        n += _delete(spark, WRITTEN.pop())
    return n


def in_turn(name: str) -> Callable[[DataFrame], DataFrame]:
    """A function for loops: it stores a table and deletes the one that it stored the time before.

    A checkpoint goes on estimating its size by the plan that made it, and estimates of joins
    multiply: after some dozen rounds planning takes longer than the work.  A stored table has
    the size of its files.
    """
    before: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        made = stored(df, name)
        path = WRITTEN[-1]
        for old in before:
            _delete(df.sparkSession, old)
            WRITTEN.remove(old)
        before[:] = [path]
        return made

    return put


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of at most ``rows`` rows, dealt by ``keys`` into parts of about ``TASK_ROWS`` rows; few rows are left as they are.

    Adaptive execution puts the parts of a shuffle together by their packed bytes, so a task may
    get millions of short rows, and more the larger the table is.  The keys' rows must be few each.
    """
    return df if rows <= 4 * TASK_ROWS else df.repartition(-(-rows // TASK_ROWS), *keys)


def together(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, by column name, without a claim on how they are dealt.

    A union of two tables dealt by the same key claims that key's partitioning, which adaptive
    execution may not keep; see ``cut``.
    """
    return first.unionByName(second).coalesce(MANY)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows; ``df`` should be cut or stored."""
    return F.broadcast(df) if df.count() <= rows else df


def looked_up(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``rows`` with what ``known`` says of ``column``: its columns beside the key ``node``, which is distinct; null where it says nothing.

    A small table is sent out.  Of a large one the hot keys' part is, and the rest is joined by
    shuffle, so no key brings more than one in ``HOT`` rows into a task.  Both are cut.
    """
    theirs = known.withColumnRenamed("node", column)
    if known.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(theirs), column, "left")
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    hot = F.broadcast(cut(counts.where(F.col("_n") > max(rows.count() / HOT, 1000)).select(column)))
    often = rows.join(hot, column, "left_semi").join(F.broadcast(theirs.join(hot, column, "left_semi")), column, "left")
    return together(often, rows.join(hot, column, "left_anti").join(theirs, column, "left"))


def mapped(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by ``to`` where ``to`` (``node, to``) has it; see ``looked_up``."""
    found = looked_up(rows, column, to.select("node", F.col("to").alias("_to")))
    return found.withColumn(column, F.coalesce("_to", column)).select(*rows.columns)
