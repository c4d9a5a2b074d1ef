"""Exact vector search, in blocks that no machine has to hold whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..storage import cut, stored, together

BLOCK = 16_384  # vectors on each side of a block, at most
LEAST = 1024
DIGITS = 12  # similarities are rounded to so many places, so that ties are ties in any order of adding up


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def _scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return np.round(a @ b.T, DIGITS)
    far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.round(-np.sqrt(np.maximum(0, far)), DIGITS)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest of each row, by score and then by column."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, -k, axis=1)[:, -k]
    r, c = np.nonzero(scores >= least[:, None])
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r, "left")
    return r[place < k], c[place < k]


def block_top_k(queries: DataFrame, items: DataFrame, k: int, block: int | None = None, skip_self: bool = False, metric: str = "cosine") -> DataFrame:
    """The ``k`` best items of every query: ``qid, item_id, similarity, rank``.

    ``queries`` has ``qid, embedding`` and ``items`` ``item_id, embedding``, of any length
    (the zero vector has similarity 0 to all).  Both are dealt into blocks by a hash; each
    pair of blocks is one matrix product, which keeps the best k of its block for each
    query, so what is shuffled afterwards is k rows for each query and item block.  Blocks
    grow with the input up to ``BLOCK`` rows, while there are enough pairs of them to keep
    all cores busy.  Ties go to the smaller item id.
    """
    count_q, count_i = queries.count(), items.count()
    if block is None:
        cores = queries.sparkSession.sparkContext.defaultParallelism
        block = int(min(BLOCK, max(LEAST, max(count_q, count_i) / max(1.0, cores**0.5))))
    n_q, n_i = max(1, -(-count_q // block)), max(1, -(-count_i // block))
    deal = lambda df, key, own, other, n, m: df.select(
        F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64(key), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
    )
    q, i = deal(queries, "qid", "qb", "ib", n_q, n_i), deal(items, "item_id", "ib", "qb", n_i, n_q)

    def best(part: pd.DataFrame) -> pd.DataFrame:
        out, left, right = [], part[part["side"] == 0], part[part["side"] == 1]
        if len(left) and len(right):
            right = right.sort_values("id", ignore_index=True)
            ids, matrix = right["id"].to_numpy(), np.stack(right["embedding"].to_numpy())
            matrix = _unit(matrix) if metric == "cosine" else matrix
            for begin in range(0, len(left), 128):
                part = left.iloc[begin : begin + 128]
                a = np.stack(part["embedding"].to_numpy())
                scores = _scores(_unit(a) if metric == "cosine" else a, matrix, metric)
                if skip_self:
                    scores[part["id"].to_numpy()[:, None] == ids[None]] = -np.inf
                r, c = _best(scores, k)
                out.append(pd.DataFrame({"qid": part["id"].to_numpy()[r], "item_id": ids[c], "similarity": scores[r, c]}))
        found = pd.concat(out) if out else pd.DataFrame({"qid": [], "item_id": [], "similarity": []}).astype({"qid": "int64", "item_id": "int64", "similarity": "float64"})
        return found[found["similarity"] > -np.inf]

    sides = together(q.withColumn("side", F.lit(0)), i.withColumn("side", F.lit(1)))
    found = sides.groupBy("qb", "ib").applyInPandas(best, "qid long, item_id long, similarity double")
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


PIVOTS = 1024  # at most
CELL = 4096  # items of a cell, and queries that meet it in one task
AT_ONCE = 1 << 20  # distances that a task holds at a time
FIRST = 4  # cells that a query meets before it has a bound
RINGS = 64  # bins of a distance of 1
_EDGE = 1e-6  # for rounding of distances


@dataclass(frozen=True)
class Rings:
    """What is known of each cell: a ring around a pivot."""

    pivots: np.ndarray
    pivot: np.ndarray  # of each cell; -1: the zero vectors
    least: np.ndarray  # distance of an item to the pivot
    most: np.ndarray
    size: np.ndarray

    def reach(self, vectors: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The highest similarity that each vector can have to an item of each cell (of those ``of``), by the triangle inequality."""
        pivot, most, least = self.pivot[of], self.most[of], self.least[of]
        known, at = np.unique(np.maximum(pivot, 0), return_inverse=True)
        far = np.sqrt(np.maximum(0, 2 - 2 * (vectors @ self.pivots[known].T))) if len(self.pivots) else np.zeros((len(vectors), 1))
        d = far[:, at.reshape(-1)]
        gap = np.maximum(0, np.maximum(d - most, least - d) - _EDGE)
        best = np.where(pivot < 0, 0.0, 1 - gap * gap / 2)
        return np.where((vectors * vectors).sum(1)[:, None] > 0.5, best, 1.0)  # a zero vector is equally near to all

    def likely(self, vectors: np.ndarray) -> np.ndarray:
        """About how similar each vector is to the items of each cell: as if they lay around the pivot in no special direction."""
        pivots = self.pivots if len(self.pivots) else np.zeros((1, vectors.shape[1]))
        to_pivot = (vectors @ pivots.T)[:, np.maximum(self.pivot, 0)]
        return np.where(self.pivot < 0, 0.0, to_pivot * (1 - ((self.least + self.most) / 2) ** 2 / 2))


@dataclass(frozen=True)
class Cells:
    """Items by cell: ``id, vector`` (of length one), ``cell``."""

    items: DataFrame
    rings: Rings


def _slices(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """The rows, in parts that make up to ``AT_ONCE`` values when each row meets ``wide`` others."""
    many = max(1, AT_ONCE // max(1, wide))
    for batch in batches:
        for begin in range(0, batch.num_rows, many):
            yield batch.slice(begin, many)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count or len(column.value_lengths().unique()) > 1:
        raise ValueError("vectors must have one length and must not be null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def cells(items: DataFrame, cell: int = CELL, most: int = PIVOTS) -> Cells:
    """Deal ``item_id, embedding`` into cells: each item goes to its nearest pivot, and there to a ring of like distance.

    Pivots are items drawn by hash, up to ``most``.  Rings are merged from bins of distance up
    to ``cell`` items; a bin with more is dealt by hash.  What the driver sees are the pivots
    and the counts of the bins, whose number is bounded.
    """
    items = items.select(F.col("item_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    n = items.count()
    drawn = items.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(min(most, int(np.ceil(2 * n**0.5)))).collect()
    pivots = _unit(np.array([r["vector"] for r in drawn], np.float64)) if drawn else np.zeros((0, 1))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(pivots)):
            unit = _unit(_matrix(batch.column("vector")))
            zero = (unit * unit).sum(1) < 0.5
            far = np.sqrt(np.maximum(0, 2 - 2 * (unit @ pivots.T))) if len(pivots) else np.zeros((len(unit), 1))
            near = far.argmin(1)
            d = far[np.arange(len(unit)), near]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(unit), pa.array(np.where(zero, -1, near)), pa.array(np.where(zero, 0.0, d)), pa.array(np.where(zero, 0, (d * RINGS).astype(np.int64)))], ["id", "vector", "pivot", "far", "bin"])

    placed = stored(items.mapInArrow(locate, "id long, vector array<double>, pivot long, far double, bin long"), "located")
    bins = placed.groupBy("pivot", "bin").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).orderBy("pivot", "bin").collect()
    made: list[list] = []  # pivot, least, most, n
    to: list[tuple[int, int, int, int]] = []  # pivot, bin, first cell, cells
    for b in bins:
        parts = -(-b["n"] // cell)
        if made and parts == 1 and made[-1][0] == b["pivot"] and made[-1][3] + b["n"] <= cell:
            made[-1][2:] = [b["most"], made[-1][3] + b["n"]]
            to.append((b["pivot"], b["bin"], len(made) - 1, 1))
        else:
            to.append((b["pivot"], b["bin"], len(made), parts))
            made += [[b["pivot"], b["least"], b["most"], b["n"] // parts] for _ in range(parts)]
    where = items.sparkSession.createDataFrame(to, "pivot long, bin long, first long, parts long")
    inside = placed.join(F.broadcast(where), ["pivot", "bin"]).select("id", "vector", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("cell"))
    columns = np.array(made, np.float64).reshape(len(made), 4)
    return Cells(inside, Rings(pivots, columns[:, 0].astype(np.int64), columns[:, 1], columns[:, 2], columns[:, 3].astype(np.int64)))


def _met(asked: DataFrame, inside: Cells, k: int, skip_self: bool, cell: int) -> DataFrame:
    """The best ``k`` of each query in each cell it is to meet: ``qid, item_id, similarity`` of ``qid, vector, cell``.

    Many queries of one cell are dealt over several tasks, each of which has the cell.
    """
    counts = cut(asked.groupBy("cell").agg(F.ceil(F.count("*") / cell).cast("long").alias("parts")))
    asks = asked.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")))
    held = inside.items.join(F.broadcast(counts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "item_id": [], "similarity": []}).astype({"qid": "int64", "item_id": "int64", "similarity": "float64"})]
        if len(left) and len(right):
            right = right.sort_values("id", ignore_index=True)
            ids, matrix = right["id"].to_numpy(), np.stack(right["vector"].to_numpy())
            for begin in range(0, len(left), 512):
                piece = left.iloc[begin : begin + 512]
                scores = _scores(np.stack(piece["vector"].to_numpy()), matrix, "cosine")
                if skip_self:
                    scores[piece["qid"].to_numpy()[:, None] == ids[None]] = -np.inf
                r, c = _best(scores, k)
                found = pd.DataFrame({"qid": piece["qid"].to_numpy()[r], "item_id": ids[c], "similarity": scores[r, c]})
                out.append(found[found["similarity"] > -np.inf])
        return pd.concat(out, ignore_index=True)

    keys = ["cell", "part"]
    return asks.select("qid", "vector", *keys).groupBy(*keys).cogroup(held.select("id", "vector", *keys).groupBy(*keys)).applyInPandas(best, "qid long, item_id long, similarity double")


def _among(met: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Which of the cells ``mine``, which follow each other, are in each row of ``met``."""
    made = np.zeros((len(met), len(mine)), bool)
    r, c = np.nonzero((met >= mine[0]) & (met <= mine[-1]))
    made[r, met[r, c].astype(np.int64) - mine[0]] = True
    return made


def _dots(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of the rows ``r`` of ``a`` and ``c`` of ``b``, rounded as ``_scores`` does."""
    out = np.empty(len(r))
    for i in range(0, len(r), LEAST * 16):
        at = slice(i, i + LEAST * 16)
        out[at] = np.einsum("ij,ij->i", a[r[at]], b[c[at]])
    return np.round(out, DIGITS)


def _rest(asked: DataFrame, inside: Cells, blocks: np.ndarray, k: int, skip_self: bool, block: int) -> DataFrame:
    """The best ``k`` of each query in each block of cells: ``qid, item_id, similarity`` of ``qid, vector, met, bound, block``.

    Queries of one block are dealt over tasks, each of which has the block.  A task compares
    only cells that a query can find something in; those it has ``met`` are left out, and so is
    what is below its ``bound``.  Products of floats, with room for their error, say which pairs
    are looked at; what counts is computed in doubles for these.
    """
    rings = inside.rings
    held = np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1) if len(blocks) else []  # the cells of each block
    counts = cut(asked.groupBy("block").agg(F.ceil(F.count("*") / min(block, BLOCK)).cast("long").alias("parts")))
    asks = asked.join(F.broadcast(counts), "block").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")))
    where = asked.sparkSession.createDataFrame([(c, int(b)) for c, b in enumerate(blocks.tolist())], "cell long, block long")
    items = inside.items.join(F.broadcast(where), "cell").join(F.broadcast(counts), "block")
    items = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    kind = pa.schema([("qid", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        right = right.sort_by([("cell", "ascending"), ("id", "ascending")])
        left = left.append_column("first", pc.list_element(left["met"], 0)).sort_by([("first", "ascending"), ("qid", "ascending")])  # those that are near each other meet the same cells
        mine = held[left["block"][0].as_py()]
        ids, matrix, place = right["id"].to_numpy(), _matrix(right["vector"]), right["cell"].to_numpy() - mine[0]
        rough, off = matrix.astype(np.float32), (matrix.shape[1] + 8) * 2.0**-23  # products of floats are off by less
        out = []
        step = max(1, AT_ONCE // max(len(ids), len(mine)))
        for begin in range(0, left.num_rows, step):
            piece = left.slice(begin, step)
            qids, least, vectors, met = piece["qid"].to_numpy(), piece["bound"].to_numpy(), _matrix(piece["vector"]), _among(_matrix(piece["met"]), mine)
            open_ = (rings.reach(vectors, mine) >= least[:, None] - 1e-9) & ~met
            columns = np.flatnonzero(open_.any(0)[place])
            of = place[columns]
            scores = vectors.astype(np.float32) @ (rough if len(columns) == len(ids) else rough[columns]).T
            bar = lambda: (least - 1e-9 - off).astype(np.float32)[:, None] - np.float32(1e-6)  # noqa: B023, E731
            r, c = np.nonzero(scores >= bar())
            if len(r) > 8 * k * len(qids) and len(columns) > k:  # the bound says little
                scores[met[:, of]] = -np.inf
                if skip_self:
                    scores[qids[:, None] == ids[columns][None]] = -np.inf
                least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k].astype(np.float64) - off - 1e-9)
                r, c = np.nonzero(scores >= bar())
            value = _dots(vectors, matrix, r, columns[c])
            good = (value >= least[r]) & ~met[r, of[c]]
            c = columns[c]
            if skip_self:
                good &= ids[c] != qids[r]
            r, c, value = r[good], c[good], value[good]
            order = np.lexsort((ids[c], -value, r))
            r, c, value = r[order], c[order], value[order]
            first = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
            out.append(pa.Table.from_arrays([pa.array(qids[r[first]]), pa.array(ids[c[first]]), pa.array(value[first])], schema=kind))
        return pa.concat_tables(out)

    keys = ["block", "part"]
    asks = asks.select("qid", "vector", "met", "bound", *keys).groupBy(*keys)
    return asks.cogroup(items.select("id", "vector", "cell", *keys).groupBy(*keys)).applyInArrow(best, "qid long, item_id long, similarity double")


@dataclass(frozen=True)
class Pruned:
    found: DataFrame  # qid, item_id, similarity, rank
    pairs: int  # of queries and cells
    compared: int


def pruned_top_k(queries: DataFrame, items: DataFrame, k: int, skip_self: bool = False, cell: int = CELL, inside: Cells | None = None, block: int | None = None) -> Pruned:
    """The rows of ``block_top_k`` by cosine, without comparing a query with cells that can't matter.

    Each query first meets the few cells that promise most, of those that hold over ``k`` items
    if there are any; its k-th similarity there is a lower bound.  After that it meets only cells to whose items it can
    be as similar as that, by the distances to the pivots; the bound is safe, so no row is
    lost.  Cells are put together to blocks of about ``block`` items, and a query goes once to
    each block that has a cell for it, however many; so where nothing can be left out, what is
    shuffled is that of ``block_top_k``.  ``inside`` are the items' ``cells`` if they were made
    before.
    """
    inside = inside or cells(items, cell)
    rings, sizes = inside.rings, inside.rings.size
    few = min(FIRST, len(sizes))
    block = block or int(min(4 * BLOCK, max(BLOCK, sizes.sum() // queries.sparkSession.sparkContext.defaultParallelism)))
    blocks = (np.cumsum(sizes) - sizes) // block  # of each cell
    blocks = np.unique(blocks, return_inverse=True)[1].reshape(-1)
    begins = np.flatnonzero(np.r_[True, np.diff(blocks) > 0]) if len(blocks) else np.zeros(0, np.int64)
    asked = queries.select("qid", F.col("embedding").cast("array<double>").alias("vector"))

    def promised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(sizes)):
            unit = _unit(_matrix(batch.column("vector")))
            best = rings.likely(unit) - 4.0 * (sizes <= k)
            met = np.argpartition(-best, few - 1, axis=1)[:, :few]
            met = np.take_along_axis(met, np.argsort(-np.take_along_axis(best, met, 1), axis=1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), _lists(unit), _lists(met)], ["qid", "vector", "met"])

    schema = "qid long, vector array<double>, met array<long>"
    first = stored(asked.mapInArrow(promised, schema) if few else asked.select("qid", "vector", F.array().cast("array<long>").alias("met")).where("false"), "asked")
    near = stored(_met(first.select("qid", "vector", F.explode("met").alias("cell")), inside, k, skip_self, cell), "near")
    bound = near.groupBy("qid").agg(F.get(F.sort_array(F.collect_list("similarity"), False), F.lit(k - 1)).alias("bound"))  # k of each of a few cells

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(sizes)):
            unit = _matrix(batch.column("vector"))
            met, least = _matrix(batch.column("met")).astype(np.int64), batch.column("bound").to_numpy(zero_copy_only=False)
            open_ = rings.reach(unit) >= least[:, None] - 1e-9
            np.put_along_axis(open_, met, False, 1)
            many = np.add.reduceat(open_, begins, axis=1, dtype=np.int64)
            for b in range(many.shape[1]):
                q = np.flatnonzero(many[:, b])
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(q)), _lists(unit[q]), _lists(met[q]), pa.array(least[q]), pa.array(np.full(len(q), b)), pa.array(many[q, b])], ["qid", "vector", "met", "bound", "block", "cells"])

    known = first.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    rest = stored(known.mapInArrow(left, f"{schema}, bound double, block long, cells long"), "asked")
    both = together(near, _rest(rest, inside, blocks, k, skip_self, block))
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "item_id")
    found = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    n = first.count()
    return Pruned(found, n * len(sizes), few * n + (rest.agg(F.sum("cells").alias("n")).first()["n"] or 0))


def nearest(queries: DataFrame, items: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """The ``k`` best items of every query by cosine: in blocks while one block holds the items, else by cells; the same rows."""
    if items.count() <= BLOCK:
        return block_top_k(queries, items, k, skip_self=skip_self)
    return pruned_top_k(queries, items, k, skip_self=skip_self).found


def thresholded(found: DataFrame, mode: str = "intent", least: float = DEFAULT.min_similarity) -> DataFrame:
    """Drop weak hits; ranks stay as they were.

    ``intent`` keeps similarities from ``least`` on; ``compat`` keeps what an inner product
    read as a distance keeps, that is 1 - similarity from ``least`` on.
    """
    value = F.col("similarity") if mode == "intent" else 1 - F.col("similarity")
    return found.where(value >= least)


def merged_seeds(found: DataFrame, config: Config = DEFAULT, least: float | None = None) -> DataFrame:
    """Seeds of questions with several query vectors: ``question, entity_id, similarity, rank``.

    ``found`` has ``question, item_id, similarity``; an entity keeps its best similarity, and
    the best ``config.seeds`` above the threshold stay.
    """
    least = config.seed_similarity if least is None else least
    merged = found.where(F.col("similarity") > least).groupBy("question", F.col("item_id").alias("entity_id")).agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("question").orderBy(F.desc("similarity"), "entity_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.seeds)


def token_budget(ranked: DataFrame, key: str, config: Config = DEFAULT, text: str = "text", pos: str = "pos", wide: bool = False) -> DataFrame:
    """The longest prefix of each key's texts, by ``pos``, whose estimated tokens fit the budget.

    Estimates are not negative, so a running sum is the rule that stops at the first
    overflow.  A key's list goes through one task; with ``wide`` it may have any length:
    lists are cut into ranges over all tasks, only the ranges that begin within the budget
    are summed up row by row, and only texts that are kept move.
    """
    from ..functions.text import estimated_tokens

    cost = estimated_tokens(F.col(text), config)
    upto = lambda value, *parts: F.sum(value).over(Window.partitionBy(*parts).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    if not wide:
        return ranked.withColumn("running_tokens", upto(cost, key)).where(F.col("running_tokens") <= config.context_tokens)
    dealt = cut(ranked.select(key, pos, cost.alias("_n")).repartitionByRange(key, pos).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(key, "_part").agg(F.sum("_n").alias("_sum"))  # a row for each key in each range
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = sums.withColumn("_before", before).where(F.col("_before") <= config.context_tokens).select(key, "_part", "_before")
    rows = dealt.join(begun, [key, "_part"]).withColumn("running_tokens", F.col("_before") + upto(F.col("_n"), key, "_part"))
    return ranked.join(rows.where(F.col("running_tokens") <= config.context_tokens).select(key, pos, "running_tokens"), [key, pos])


def contexts(ranked: DataFrame, key: str, config: Config = DEFAULT, text: str = "text", pos: str = "pos", wide: bool = False) -> DataFrame:
    """``key, context, n_texts``: the texts of a key in order, joined; a budget bounds what is gathered."""
    kept = token_budget(ranked, key, config, text, pos, wide)
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    gathered = kept.groupBy(key).agg(rows.alias("rows"))
    texts = F.filter(F.transform("rows", lambda x: x["t"]), lambda x: x != "")
    return gathered.select(key, F.array_join(texts, config.separator).alias("context"), F.size("rows").alias("n_texts"))

