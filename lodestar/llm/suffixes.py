"""Exact removal of repeated substrings by blockwise suffix sorting with a difference cover.

Every window of ``length`` bytes has one anchor: the ``GRAM`` bytes in it with the smallest
hash, the first of equals.  Equal windows have equal anchors at equal places, so the suffixes
that can agree for ``length`` bytes fall into one bucket, that of their anchor's hash, and a
bucket needs no more of a text than its anchors' contexts: the bytes of the windows an anchor
stands for.  Buckets with one occurrence have no repeat and are dropped by a count.  Equal
contexts, by a digest of 128 bits, are merged by a count, too (their windows all repeat);
only buckets with several different contexts get the texts of these.

Buckets are sorted one block at a time.  In a block, suffixes are sorted by their first
``V`` bytes.  Longer ties are resolved by the ranks of a difference-cover sample, which prefix
doubling has ranked before: for any two suffixes there is a shift below ``V`` that takes both
to sample positions.  Neighbours in the order that agree for ``length`` bytes are repeats.

A bucket with more than ``MOST`` contexts is divided by the place of the window around the
anchor: windows in a smaller range of places share more bytes, whose hash is the new bucket.
Ranges end at one place, where all contexts of a bucket are equal, so no bucket stays large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, spread_join, stored

LENGTH = 400
GRAM = 64
MOST = 256  # contexts in a bucket
PARTS = 4  # into which a range of places is divided
BLOCK = 1 << 20  # bytes of context that are sorted at a time
V = 31
COVER = (1, 5, 11, 24, 25, 27)  # a perfect difference set modulo V: each residue is one difference
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


class Anchors:
    """Finds the anchors of a text; keeps powers of the hash's base."""

    def __init__(self, length: int) -> None:
        self.length, self.span = length, length - GRAM + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (BASE, UNBASE))

    def __call__(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(hash, anchor, first window, last window) in order of the text."""
        n = len(data)
        if n < self.length:
            return []
        self._powers(n + 1)
        sums = np.r_[np.uint64(0), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[:n], dtype=np.uint64)]
        g = (sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        span, last, out = self.span, n - self.length, []
        first, at = 0, int(g[: self.span].argmin())
        while True:
            low = g[at]
            ahead = g[first + span : min(at + span, last + span)] < low  # grams that come in while the anchor is in
            k = int(ahead.argmax()) if len(ahead) else 0
            if len(ahead) and ahead[k]:
                nxt = first + span + k
                begin = nxt - span + 1
            else:
                begin = at + 1
                nxt = begin + int(g[begin : begin + span].argmin()) if begin <= last else 0
            out.append((int(low), at, first, min(begin, last + 1) - 1))
            if begin > last:
                return out
            first, at = begin, nxt


def _shifts() -> np.ndarray:
    """[r, s]: the least shift that takes residues r and s both into the cover."""
    out = np.full((V, V), V, np.int64)
    for d in COVER:
        for e in COVER:
            for r in range(V):
                k = (d - r) % V
                s = (e - k) % V
                out[r, s] = min(out[r, s], k)
    return out


def _ranked(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Dense ranks of rows of keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_order(text: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort positions of ``text`` by the text from there on, at least by its first ``depth`` bytes.

    Returns the order and the 8-byte words of the text (for comparisons).
    """
    size = len(text)
    padded = np.r_[text, np.zeros(2 * depth + 4 * V + 8, np.uint8)].astype(np.uint64)
    words = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    head = lambda p: tuple(words[p + k] for k in (0, 8, 16, V - 8))  # noqa: E731  the first V bytes
    sampled = np.flatnonzero(np.isin(np.arange(size + V) % V, COVER))
    rank = np.zeros(len(padded), np.int64)
    rank[sampled] = 1 + _ranked(head(sampled))
    reach = V
    while reach < depth:
        rank[sampled] = 1 + _ranked((rank[sampled], rank[np.minimum(sampled + reach, len(rank) - 1)]))
        reach *= 2
    shifts, residue = _shifts(), suffixes % V
    group = _ranked(head(suffixes))
    order = np.lexsort((rank[suffixes + shifts[residue, residue]], group))
    g, r = group[order], residue[order]
    bounds = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    several = np.minimum.reduceat(r, bounds) != np.maximum.reduceat(r, bounds) if len(bounds) else []
    ends = np.r_[bounds[1:], len(order)]
    for i in np.flatnonzero(several):  # ties of different residues

        def compare(a: int, b: int) -> int:
            k = shifts[residue[a], residue[b]]
            return int(rank[suffixes[a] + k] - rank[suffixes[b] + k])

        order[bounds[i] : ends[i]] = sorted(order[bounds[i] : ends[i]].tolist(), key=cmp_to_key(compare))
    return order, words


def repeated(contexts: list[bytes], anchors: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its windows occur in another context, too."""
    at, parts, size = [], [], 0
    for c, a in zip(contexts, anchors, strict=True):
        pad = (-(size + a)) % V  # anchors fall on one residue, so repeats do, too
        parts += [bytes(pad), c]
        at.append(size + pad)
        size += pad + len(c)
    counts = np.array([len(c) - length + 1 for c in contexts])
    bounds = np.r_[0, np.cumsum(counts)]
    suffixes = np.repeat(np.array(at), counts) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
    order, words = suffix_order(np.frombuffer(b"".join(parts), np.uint8), suffixes, length)
    a, b = suffixes[order[:-1]], suffixes[order[1:]]
    alive = np.arange(len(a))
    for k in (*range(0, length - 7, 8), length - 8):
        alive = alive[words[a[alive] + k] == words[b[alive] + k]]
        if not len(alive):
            break
    found = np.zeros(len(suffixes), bool)
    found[order[alive]] = found[order[alive + 1]] = True
    return np.split(found, bounds[1:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _sorted_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``key``; whole buckets are sorted until a block is full."""

    def solve(part: pd.DataFrame) -> pa.RecordBatch:
        found = repeated(part["context"].tolist(), part["anchor"].tolist(), length)
        rows = [(row, start + a, start + b - 1 + length) for row, start, n, f in zip(part["row"], part["start"], part["n"], found, strict=True) if n == 1 for a, b in _runs(f)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], ["row", "begin", "end"])

    rest: pd.DataFrame | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            part = pa.Table.from_batches([batch]).to_pandas()
            rest = part if rest is None else pd.concat([rest, part], ignore_index=True)
        while rest is not None and len(rest):
            key = rest["key"].to_numpy()
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            closed = len(rest) if batch is None else int(new[-1])
            sizes = np.cumsum(rest["context"].str.len().to_numpy())
            ends = np.r_[new[1:], len(rest)]
            ends = ends[ends <= closed]
            if not len(ends):
                break
            stop = int(ends[max(0, np.searchsorted(sizes[ends - 1], BLOCK, "right") - 1)])
            yield solve(rest.iloc[:stop])
            rest = rest.iloc[stop:].reset_index(drop=True)


def _key(data: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def _same(data: bytes) -> bytes:
    """A digest of 128 bits that stands for the bytes; together with the bucket's key 192."""
    return xxhash.xxh3_128_digest(data)


def _divide(part: pd.DataFrame, length: int) -> Iterator[tuple]:
    """Rows of a large bucket, for each part of its range of places that the context has windows in."""
    for key, row, start, anchor, low, high, context in zip(*(part[c] for c in ("key", "row", "start", "anchor", "low", "high", "context")), strict=True):
        step = max(1, -(-(high - low + 1) // PARTS))
        for x in range(low, high + 1, step):
            y = min(x + step - 1, high)  # places: how many bytes of the window lie before the anchor
            first, last = max(0, anchor - y), min(len(context) - length, anchor - x)
            if first <= last:
                core = context[anchor - x : anchor - y + length]
                sub = context[first : last + length]
                yield _key(core, (key ^ x) & 0x7FFFFFFF), row, start + first, anchor - first, x, y, _same(sub), sub


NODE = "key long, row long, start long, anchor int, low int, high int, same binary, context binary"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written once: read again, the numbers stay what they are."""
    return stored(docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")), "rows")


def repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row, begin, end``: bytes of ``text`` that lie in repeated strings of ``length`` bytes.

    ``rows`` has ``row, text`` and is a stored table: it is read three times, and a row's
    number must be the same each time.  The ranges may overlap.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                out += ((g - (1 << 63), _same(data[s : e + length]), row, a, s, e) for g, a, s, e in anchors(data))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.int64()] + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["key", "same", "row", "anchor", "first", "last"])

    anchors = stored(rows.select("row", "text").mapInArrow(find, "key long, same binary, row long, anchor int, first int, last int"), "anchors")
    counts = anchors.groupBy("key").agg(F.count("*").alias("n"), (F.min("same") != F.max("same")).alias("mixed"))
    live = stored(spread_join(anchors, cut(counts.where("n > 1")), ["key"]).drop("n"), "live")
    contexts = live.groupBy("key", "same").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("row", "anchor", "first", "last")).alias("at"))
    contexts = stored(contexts.where("mixed or n > 1").select("key", "same", "n", "mixed", "at.*"), "contexts")
    equal = spread_join(live.drop("mixed"), contexts.where("n > 1").select("key", "same", "n"), ["key", "same"])
    equal = equal.select("row", F.col("first").cast("long").alias("begin"), (F.col("last") + length).cast("long").alias("end"))
    several = contexts.where("mixed")
    wanted = several.groupBy("row").agg(F.collect_list(F.struct("key", "same", "n", "anchor", "first", "last")).alias("at"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            out = []
            for row, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py().encode()
                out += ((x["key"], row, x["first"], x["anchor"] - x["first"], 0, length - GRAM, x["same"], data[x["first"] : x["last"] + length], x["n"]) for x in at)
            yield _node_batch(out, [pa.int64()])

    nodes = rows.select("row", "text").join(wanted, "row").mapInArrow(carry, f"{NODE}, n long")
    found = equal
    while True:
        nodes = stored(nodes, "nodes")
        hot = nodes.groupBy("key").count().where(F.col("count") > MOST).select("key")
        large = nodes.join(hot, "key", "left_semi")
        little = nodes.join(hot, "key", "left_anti")
        ready = little.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _sorted_blocks(b, length), "row long, begin long, end long")
        found = found.unionByName(ready)
        if hot.isEmpty():
            return found

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = pa.Table.from_batches([batch]).to_pandas()
                yield _node_batch([(*x, n) for x, n in _with_n(part, length)], [pa.int64()])

        parts = stored(large.mapInArrow(split, f"{NODE}, n long"), "parts")
        equal = stored(parts.groupBy("key", "same").agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.min(F.struct("row", "start")).alias("at")), "equal")
        again = spread_join(parts, equal.where("k > 1").select("key", "same", "k"), ["key", "same"], "k")
        found = found.unionByName(again.select("row", F.col("start").alias("begin"), (F.col("start") + F.length("context")).cast("long").alias("end")))
        mixed = equal.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")
        one = equal.join(mixed, "key").select("key", "same", "total", "at.row", "at.start")
        nodes = parts.drop("n").join(one, ["key", "same", "row", "start"]).withColumnRenamed("total", "n").select(*(c.split(" ")[0] for c in NODE.split(", ")), "n")


def _with_n(part: pd.DataFrame, length: int) -> Iterator[tuple[tuple, int]]:
    for i in range(len(part)):
        one = part.iloc[i : i + 1]
        for x in _divide(one, length):
            yield x, int(one["n"].iloc[0])


def _node_batch(out: list[tuple], more: list[pa.DataType]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary(), pa.binary(), *more]
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    names = [*(c.split(" ")[0] for c in NODE.split(", ")), "n"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else, too, in
    the same or another row.  ``n_spans`` counts the maximal runs that go; ``kept`` is what
    is left, as bytes.  Null texts are empty.  Rows that repeat are rows of their own (and
    repeats of each other), whatever their ids.  An empty table gives no rows; columns
    beside ``doc_id`` and ``text`` are not read.
    """
    rows = _numbered(docs)
    gone = repeats(rows, length).groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("gone"))  # no more than a text has anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            out = []
            for doc_id, text, ranges in zip(*(batch.column(c) for c in ("doc_id", "text", "gone")), strict=True):
                data = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for x in sorted(((x["begin"], x["end"]) for x in ranges.as_py() or ())):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                edges = [0, *chain.from_iterable(merged), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id.as_py(), len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(gone, "row", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
