"""SimHash near-duplicate groups by bit-sliced Hamming comparison.

Fingerprints are made in one pass over the texts.  Equal fingerprints are merged first, so
copies never meet each other again.  Two fingerprints that differ in at most ``radius`` bits
agree in one of ``radius + 1`` bands, so only the members of a band bucket are compared.  A
bucket over ``BLOCK`` fingerprints is divided by bands of the bits that are left, in which
two of its members that link agree in one again; so copies of a row grow with the depth of
the division, not with the bucket.  Where no more bits are left than the radius, all link.

A comparison holds 64 fingerprints as 64 bit planes: one word of a plane has one bit of each.
Differences are added into carry-save counters, and a block of lanes is abandoned once every
lane is beyond the radius.  A bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, spread_join, together
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 1024  # fingerprints in a bucket
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def majority(hashes: np.ndarray) -> int:
    """The signed number whose bits are set in over half the unsigned hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.ascontiguousarray(np.packbits(2 * ones > len(hashes), bitorder="little")).view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of one text; no words give zero."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, n)
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """(blocks, 64) fingerprints to (64, blocks) words: bit l of word [p, k] is bit p of lane l in block k."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(len(values), 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def _beyond(counts: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, in bit planes from the lowest, is over ``radius``."""
    far, same = over, ~over
    for k in range(len(counts) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counts[k]
        else:
            far, same = far | (same & counts[k]), same & ~counts[k]
    return far


def _near(planes: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (query, block) the lanes within ``radius``, as a word; blocks that are abandoned are left out."""
    at = np.arange(len(query))
    zero = np.zeros(len(query), np.uint64)
    counts, over = [zero] * radius.bit_length() or [zero], zero
    for p in range(0, 64, 2):
        d1 = planes[p, block] ^ (np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)))
        d2 = planes[p + 1, block] ^ (np.uint64(0) - ((query >> np.uint64(p + 1)) & np.uint64(1)))
        half = counts[0] ^ d1
        carry = (counts[0] & d1) | (half & d2)  # carry-save: three planes of weight one become one of one and one of two
        counts[0] = half ^ d2
        for k in range(1, len(counts)):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        over = over | carry
        if p % 8 == 6:
            alive = (_beyond(counts, over, radius) | ~lanes) != ALL
            if not alive.all():
                at, query, block, lanes, over, *counts = (x[alive] for x in (at, query, block, lanes, over, *counts))
                if not len(at):
                    break
    return at, ~_beyond(counts, over, radius) & lanes


def pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Places (a < b) of the fingerprints that differ in at most ``radius`` bits within each group.

    ``fps`` are unsigned and ``group`` is non-decreasing.
    """
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(bounds)
    if (sizes == 1).any():  # a fingerprint alone would take up a block of lanes
        several = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        if not len(several):
            return several, several
        a, b = pairs(fps[several], group[several], radius, at_once)
        return several[a], several[b]
    n_blocks = (sizes + 63) // 64
    first_block = np.r_[0, np.cumsum(n_blocks)]
    which = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(fps)) - bounds[which]
    slot = (first_block[which] * 64) + inside
    total = int(first_block[-1]) * 64
    lanes_of, row_of = np.zeros(total, np.uint64), np.full(total, -1, np.int64)
    lanes_of[slot], row_of[slot] = fps, np.arange(len(fps))
    planes = _planes(lanes_of.reshape(-1, 64))
    valid = np.ascontiguousarray(np.packbits((row_of >= 0).reshape(-1, 64), axis=1, bitorder="little")).view("<u8")[:, 0]
    later = np.where(sizes[which] > 1, n_blocks[which] - inside // 64, 0)  # blocks from a query's own on
    ends = np.cumsum(later)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = 0
    while begin < len(fps):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + at_once, "right")))
        q = np.repeat(np.arange(begin, stop), later[begin:stop])
        k = np.arange(len(q)) - np.repeat(ends[begin:stop] - later[begin:stop] - done, later[begin:stop])
        block = first_block[which[q]] + inside[q] // 64 + k
        hit, near = _near(planes, fps[q], block, valid[block], radius)
        some = near != 0
        hit, near = hit[some], near[some]
        bits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(bits)
        a, b = q[hit[i]], row_of[block[hit[i]] * 64 + lane]
        keep = a < b
        found_a.append(a[keep])
        found_b.append(b[keep])
        begin = stop
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller fingerprint) that join what links at ``radius`` within each group.

    ``fps`` are unsigned and ``group`` is non-decreasing.  Every fingerprint that has a link
    gets one row: the smallest one it can reach inside its group.
    """
    a, b = pairs(fps, group, radius)
    order = np.argsort(fps, kind="stable")
    rank = np.empty(len(fps), np.int64)
    rank[order] = np.arange(len(fps))
    label = rank.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            break
    moved = np.flatnonzero(label != rank)
    return fps[moved], fps[order[label[moved]]]


def stars(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that has a smaller one within ``radius`` in its group, and the smallest such."""
    a, b = pairs(fps, group, radius)
    order = np.argsort(fps, kind="stable")
    rank = np.empty(len(fps), np.int64)
    rank[order] = np.arange(len(fps))
    label = rank.copy()
    np.minimum.at(label, a, rank[b])
    np.minimum.at(label, b, rank[a])
    moved = np.flatnonzero(label != rank)
    return fps[moved], fps[order[label[moved]]]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows and the numbers of their groups, from batches sorted by ``keys``; no group is cut."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None:
            part = pa.Table.from_batches([batch]).to_pandas()
            rest = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if rest is None or not len(rest):
            continue
        ids = rest[keys].to_numpy()
        new = np.r_[True, (ids[1:] != ids[:-1]).any(1)]
        upto = len(rest) if batch is None else int(np.flatnonzero(new)[-1])  # the last group may go on
        if upto:
            yield rest.iloc[:upto], np.cumsum(new)[:upto]
        rest = rest.iloc[upto:].reset_index(drop=True)


def _divided(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """``fp, mask, path`` to ``radius + 1`` rows each: bands of the bits outside ``mask`` join it, and their number the path."""
    for batch in batches:
        fp, mask, path = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "mask", "path"))
        out = []
        for m in np.unique(mask):
            rows = np.flatnonzero(mask == m)
            left = [b for b in range(64) if not int(m) >> b & 1]
            for i, part in enumerate(np.array_split(left, radius + 1)):
                band = np.uint64(sum(1 << int(b) for b in part))
                out.append((fp[rows], np.full(len(rows), m | band), path[rows] * np.uint64(radius + 1) + np.uint64(i)))
        columns = [np.concatenate(x).view(np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "mask", "path"])


def _crowded(rows: DataFrame, n: int, block: int) -> DataFrame:
    """``path, key`` of the buckets with over ``block`` of the ``n`` rows, marked for broadcast if they are few.

    Nearly every bucket holds a row or two, so buckets are counted only where a cell, which
    many of them share, holds so many rows.
    """
    rows = rows.select("path", _key().alias("key"))
    cell = F.pmod(F.xxhash64("path", "key"), F.lit(max(1, 4 * n // block)))
    full = small(cut(rows.groupBy(cell.alias("cell")).count().where(F.col("count") > block).select("cell")))
    there = rows.withColumn("cell", cell).join(full, "cell", "left_semi")
    return small(cut(there.groupBy("path", "key").count().where(F.col("count") > block).select("path", "key")))


def _key() -> F.Column:
    """What the members of a bucket agree in; it follows from the row, so it is not shuffled."""
    return F.col("fp").bitwiseAND(F.col("mask"))


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, within: Callable = forest) -> DataFrame:
    """Links ``a, b`` (a > b as unsigned) among the distinct fingerprints of ``fp``, which is cut or stored.

    They are what ``within`` gives for each bucket: a ``forest`` of all links, or ``stars``.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, mask = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "mask"))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("path"), pa.array(fp & mask)], ["fp", "path", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in grouped(keyed(batches), ["path", "key"]):
            a, b = within(rows["fp"].to_numpy().astype(np.int64).view(np.uint64), group, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    schema, keys = "fp long, mask long, path long", ["path", "key"]
    zero = F.lit(0).cast("long")
    rows, found = fps.select("fp", zero.alias("mask"), zero.alias("path")), None
    while True:
        n = rows.count() * (radius + 1)
        rows = rows.mapInArrow(lambda b: _divided(b, radius), schema)  # cheap, so made twice rather than written
        hot = _crowded(rows, n, block)
        some = not hot.isEmpty()
        little = rows.withColumn("key", _key()).join(hot, keys, "left_anti").drop("key") if some else rows
        little = little.repartition("path", _key()).sortWithinPartitions("path", _key())
        made = little.mapInArrow(run, "a long, b long")
        found = made if found is None else together(found, made)
        if not some:
            return found
        large = rows.withColumn("key", _key()).join(hot, keys, "left_semi").drop("key")
        free = 64 - F.bit_count("mask")
        found = together(found, _all_linked(large.where(free <= radius)))
        rows = cut(large.where(free > radius))
        if rows.isEmpty():
            return found


def unsigned(fp: str) -> F.Column:
    """The same number turned so that signed order is the unsigned order of ``fp``; turning again gives ``fp``."""
    return F.col(fp).bitwiseXOR(F.lit(-(1 << 63)))


def _all_linked(rows: DataFrame) -> DataFrame:
    """Links of the rows that agree in all bits of their mask to the smallest one of them."""
    rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("same"))
    least = rows.groupBy("mask", "same").agg(F.min(unsigned("fp")).alias("b")).select("mask", "same", unsigned("b").alias("b"))
    return rows.join(least, ["mask", "same"]).where("fp <> b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Null texts count as empty and have fingerprint zero.  Rows that repeat, with equal or
    null ids too, stay rows of their own; the component id is the smallest id that is not
    null in the component (null if there is none).  An empty table gives no rows.  Columns
    beside ``doc_id`` and ``text`` are not read.
    """
    made = cut(fingerprints(docs, shingle, seed))
    nodes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    labels = components(links(nodes.select("fp"), radius))
    named = cut(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = cut(named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")))
    classes = cut(spread_join(named, least, ["label"], "members").select("fp", "component_id", "n"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return spread_join(made, classes, ["fp"]).select("doc_id", hexed.alias("fingerprint"), "component_id")
