"""Vector codes: product quantisation whose codebooks are fitted by cover-tree Lloyd.

Vectors become whole numbers and are cut into parts.  Blocks of vectors, in the partition they
lie in, are held as cover trees, one for each part: a node covers its points within a radius,
its children cover half the radius and stand further than that apart.  Points lie in the order
of a walk through the tree, so a node's points are a range and their sum is a difference of two
cumulative sums.

In a round of Lloyd's method a node whose nearest entry beats the second nearest by more than
twice the radius gives its whole range to it (triangle inequality); other nodes open their
children, and only points of small nodes that stay ambiguous are compared one by one.  Tasks
send sums by entry, so a round shuffles a fixed number of rows a task, and the codebooks that
go out are of fixed size.  Trees are built once and stored in the shared folder.

Numbers are whole and distances below 2**53, so results are exact and hang neither on blocks
nor on partitions; the bound on square roots leaves a margin for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
LARGEST = 1 << 20  # of a component, times the scale; further out it counts as this
ENTRIES = 256
PARTS = 4
ROUNDS = 4
BLOCK = 4096  # vectors of a tree
LEAF = 16  # points of a node that is not divided
_NODE = pa.struct([*((c, pa.list_(pa.int32())) for c in ("begin", "end", "child", "children")), ("radius", pa.list_(pa.float64()))])


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The points in tree order, and the nodes: range, first child, number of children, radius around the first point.

    Nodes stand level by level, children of a node together, the root first.
    """
    order = np.arange(len(points))
    begin, end, child, children, radius = [0], [len(points)], [], [], []
    node = 0
    while node < len(begin):
        lo, hi = begin[node], end[node]
        inside = order[lo:hi]
        far = np.sqrt(((points[inside] - points[inside[0]]) ** 2).sum(1))
        r = float(far.max())
        radius.append(r)
        if hi - lo <= leaf or r == 0:
            child.append(0)
            children.append(0)
        else:
            near = far <= r / 2
            groups, rest = [inside[near]], inside[~near]
            while len(rest):
                near = ((points[rest] - points[rest[0]]) ** 2).sum(1) <= r * r / 4
                groups.append(rest[near])
                rest = rest[~near]
            order[lo:hi] = np.concatenate(groups)
            ends = lo + np.cumsum([len(g) for g in groups])
            child.append(len(begin))
            children.append(len(groups))
            begin += [lo, *ends[:-1].tolist()]
            end += ends.tolist()
        node += 1
    columns = {"begin": begin, "end": end, "child": child, "children": children}
    return order, {**{k: np.array(v, np.int64) for k, v in columns.items()}, "radius": np.array(radius)}


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - begin
    return np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())


def assign(points: np.ndarray, tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For the points in tree order the nearest entry (the lower of equals), the ranges that went as a whole
    (``begin, end, entry``), and how many points were compared one by one."""
    own = (entries * entries).sum(1)

    def squared(x: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] - 2.0 * (x @ entries.T) + own

    label = np.empty(len(points), np.int64)
    whole, compared = [], 0
    front = np.zeros(1, np.int64)
    while len(front):
        begin, end, r = (tree[c][front] for c in ("begin", "end", "radius"))
        d = squared(points[begin])
        best = d.argmin(1)
        if len(entries) > 1:
            two = np.sqrt(np.partition(d, 1, axis=1)[:, :2])
            settled = (r == 0) | (two[:, 0] + 2 * r + 1e-9 * (1 + two[:, 1]) < two[:, 1])
        else:
            settled = np.ones(len(front), bool)
        label[_ranges(begin[settled], end[settled])] = np.repeat(best[settled], (end - begin)[settled])
        whole.append(np.stack([begin[settled], end[settled], best[settled]], 1))
        small = ~settled & (tree["children"][front] == 0)
        single = _ranges(begin[small], end[small])
        if len(single):
            label[single] = squared(points[single]).argmin(1)
            whole.append(np.stack([single, single + 1, label[single]], 1))
            compared += len(single)
        open_ = front[~settled & (tree["children"][front] > 0)]
        front = _ranges(tree["child"][open_], tree["child"][open_] + tree["children"][open_])
    return label, np.concatenate(whole), compared


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has components, none of them null and all finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size(column) > 0) & ~bad)


def whole(column: str, scale: int = SCALE) -> F.Column:
    """The vector's components as whole numbers: the floor of ``scale`` times each, within ``LARGEST``."""
    scaled = lambda x: x.cast("double") * scale
    return F.transform(column, lambda x: F.when(F.abs(scaled(x)) > LARGEST, F.signum(x) * LARGEST).otherwise(F.floor(scaled(x))).cast("int"))


def _forest(rows: DataFrame, dim: int, parts: int, carry: list[str], block: int) -> DataFrame:
    """One row for each block of vectors: the carried columns as lists, and the points and nodes of each part."""
    width = dim // parts

    def tree_of(points: np.ndarray) -> dict[str, object]:
        order, nodes = cover_tree(points.astype(np.float64))
        return {"order": order.astype(np.int32), "points": points[order].tobytes(), **{k: v if k == "radius" else v.astype(np.int32) for k, v in nodes.items()}}

    fields = [("order", pa.list_(pa.int32())), ("points", pa.binary()), *((f.name, f.type) for f in _NODE)]
    kind = pa.struct(fields)

    def made(table: pa.Table) -> pa.RecordBatch:
        n = len(table)
        points = table.column("whole").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, dim)
        trees = [tree_of(np.ascontiguousarray(points[:, p * width : (p + 1) * width])) for p in range(parts)]
        ends = pa.array([0, n], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in carry]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(kind))], [*carry, "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                while sum(b.num_rows for b in held) + piece.num_rows >= block:
                    take = block - sum(b.num_rows for b in held)
                    yield made(pa.Table.from_batches([*held, piece.slice(0, take)]))
                    held, piece = [], piece.slice(take)
                if piece.num_rows:
                    held.append(piece)
        if held:
            yield made(pa.Table.from_batches(held))

    types = dict(rows.dtypes)
    node = "order: array<int>, points: binary, begin: array<int>, end: array<int>, child: array<int>, children: array<int>, radius: array<double>"
    return rows.mapInArrow(run, ", ".join([*(f"{c} array<{types[c]}>" for c in carry), f"trees array<struct<{node}>>"]))


def _opened(tree: dict[str, object], width: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    points = np.frombuffer(tree["points"], np.int32).reshape(-1, width).astype(np.float64)
    nodes = {k: np.array(tree[k], np.int64) for k in ("begin", "end", "child", "children")} | {"radius": np.array(tree["radius"])}
    return points, np.array(tree["order"], np.int64), nodes


def _sums(forest: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count and the sum of the points of each entry of each part: as many numbers as the codebooks have."""
    parts, entries, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for row in batch.column("trees"):
                for p, tree in enumerate(row.as_py()):
                    points, _, nodes = _opened(tree, width)
                    before = np.zeros((len(points) + 1, width), np.int64)
                    np.cumsum(points.astype(np.int64), axis=0, out=before[1:])
                    begin, end, entry = assign(points, nodes, books[p])[1].T
                    np.add.at(count[p], entry, end - begin)
                    np.add.at(total[p], entry, before[end] - before[begin])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *(pa.array(total[p, e, i]) for i in range(width))], ["part", "entry", "n", *names])

    schema = "part long, entry long, n long, " + ", ".join(f"{c} long" for c in names)
    found = forest.select("trees").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).toPandas()
    count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    at = found["part"].to_numpy(np.int64), found["entry"].to_numpy(np.int64)
    count[at], total[at] = found["n"], found[names].to_numpy(np.int64)
    return count, total


def _encoded(forest: DataFrame, books: np.ndarray, carry: list[str], types: dict[str, str]) -> DataFrame:
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                trees = batch.column("trees")[i].as_py()
                n = len(trees[0]["order"])
                codes, error = np.empty((n, parts), np.int32), np.zeros(n, np.int64)
                for p, tree in enumerate(trees):
                    points, order, nodes = _opened(tree, width)
                    label = assign(points, nodes, books[p])[0]
                    codes[order, p] = label
                    error[order] += ((points - books[p][label]) ** 2).sum(1).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i].values for c in carry), lists, pa.array(error)], [*carry, "codes", "error"])

    return forest.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in carry), "codes array<int>, error long"]))


def compress(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", carry: tuple[str, ...] = (), entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """``key, carry, codes, error`` of each usable row, and the codebooks (parts, entries, width).

    Rows without a usable vector (null or empty, a null or non-finite component), or with
    another number of components than the first one by key, are left out.  The first codebook is the
    vectors of the smallest keys; null keys come last, equal keys go by their vectors.  With
    fewer vectors than entries there are as many entries as vectors; an empty table gives no
    rows and empty codebooks.  Rows that repeat are coded each.  A length that the parts do
    not divide is a ValueError.
    """
    rows = usable(vectors.select(key, *carry, column), column).select(key, *carry, whole(column).alias("whole"))
    smallest = lambda rows: [r["whole"] for r in rows.select(key, "whole").orderBy(F.asc_nulls_last(key), "whole").limit(entries).collect()]
    first = smallest(rows)
    dim = len(first[0]) if first else 0
    if dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
    names, types = [key, *carry], dict(rows.dtypes)
    rows = rows.where(F.size("whole") == dim)
    if any(len(v) != dim for v in first):
        first = smallest(rows)
    books = np.array(first, np.float64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2) if dim else np.zeros((parts, 0, 0))
    if not dim:
        return rows.select(*names, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    forest = stored(_forest(rows, dim, parts, names, block), "trees")
    for _ in range(rounds):
        count, total = _sums(forest, books)
        books = np.where(count[:, :, None] > 0, np.floor_divide(total, np.maximum(count, 1)[:, :, None]), books.astype(np.int64)).astype(np.float64)
    return _encoded(forest, books, names, types), books
