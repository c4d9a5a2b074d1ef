"""Benchmark decontamination by greedy string tiling.

An item leaks into a document if tiles, equal runs of at least ``seed`` tokens, cover at
least ``threshold`` of the item's tokens.  Pairs are found by seeds, the runs of ``seed``
tokens, and only pairs are tiled:

1. The benchmark's seeds set bits in a filter of fixed size, which every task gets.  One
   pass over the documents keeps those with enough seeds in the filter, with these seeds.
2. Kept documents and items are joined by seed.  Tiles that cover enough hold at least one
   fifth as many seeds as tokens (for seeds of five), so of an item's seeds the commonest
   ones, one fewer than it must share, need not be joined.  What is common in the documents
   is dealt out by salts.
3. Each pair is tiled: running Karp-Rabin hashes of the current match length find the longest
   matches between tokens that are not yet marked, those are marked as tiles, and the length
   comes down until it is ``seed``.  Tiles may lie in any order, so a passage whose sentences
   were moved is found as well.

An item shorter than a seed is one seed, and is found where all its tokens stand in a row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, spread_join, stored

SEED = 5
THRESHOLD = 0.8
WORDS = 1 << 21  # of 64 bits in the filter: 16 MB
SALTED = 50_000  # documents with one seed that go to one place
TOGETHER = 32  # items that are held against a document at a time
WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
LEAKS = "doc_id long, item_id long, coverage double, covered_tokens long, item_tokens long, tiles array<struct<doc_start: int, item_start: int, length: int>>"


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of ``n`` ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    powers = np.multiply.accumulate(np.full(len(ids), BASE, np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)]
    return (sums[n:] - sums[:-n]) * powers[::-1][: len(ids) - n + 1]  # every run on the scale of the last power


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of ``n`` tokens of which none is marked."""
    taken = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(taken[n:] == taken[:-n]) if len(marked) >= n else np.empty(0, np.int64)


def _meet(doc: np.ndarray, item: np.ndarray, doc_marked: np.ndarray, item_marked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where unmarked runs of ``n`` tokens have equal hashes.

    Gives starts in the document, the starts in the item ordered by hash, and for each of the
    former the range of the latter.
    """
    own, other = _free(item_marked, n), _free(doc_marked, n)
    longest = max(len(doc), len(item))
    pad = lambda x: np.r_[x, np.zeros(longest - len(x), x.dtype)]  # noqa: E731  equal scale for both
    of_item, of_doc = rolling(pad(item), n)[own], rolling(pad(doc), n)[other]
    order = np.argsort(of_item, kind="stable")
    low, high = (np.searchsorted(of_item[order], of_doc, side) for side in ("left", "right"))
    some = high > low
    return other[some], own[order], low[some], high[some]


def _mark(doc: np.ndarray, item: np.ndarray, doc_marked: np.ndarray, item_marked: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Mark matches of ``n`` tokens (there are no longer ones) until none is left that overlaps no mark."""
    at, own, low, high = _meet(doc, item, doc_marked, item_marked, n)
    tiles = []
    for d, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
        if doc_marked[d] or doc_marked[d + n - 1]:
            continue
        for i in own[a:b].tolist():
            if not item_marked[i] and not item_marked[i + n - 1] and (item[i : i + n] == doc[d : d + n]).all():
                item_marked[i : i + n] = doc_marked[d : d + n] = True
                tiles.append((d, i, n))
                break
        if tiles and item_marked.all():
            break
    return tiles


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id arrays: (doc start, item start, length), longest first.

    Equal lengths go in the order of the document, then of the item.  The longest match is
    found by doubling the length while there is a match and halving the step on the way back.
    """
    doc_marked, item_marked = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles, most = [], min(len(doc), len(item))
    while most >= least:
        low, high, step = least - 1, most + 1, least  # runs of ``low`` tokens match, of ``high`` don't
        while low + 1 < high:
            n = min(max(low + 1, step), high - 1)
            if len(_meet(doc, item, doc_marked, item_marked, n)[0]):
                low, step = n, 2 * n
            else:
                high, step = n, (low + n) // 2
        if low < least:
            break
        tiles += _mark(doc, item, doc_marked, item_marked, low)
        most = low - 1
    return tiles


class Hashes(dict):
    """Tokens to 64-bit hashes; what is known is forgotten from time to time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seed_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` tokens."""
    many = max(0, len(ids) - n + 1)
    out = np.full(many, n, np.uint64)
    for k in range(n):
        out = out * BASE + ids[k : k + many]
    out = (out ^ (out >> np.uint64(32))) * BASE
    return out ^ (out >> np.uint64(29))


def needed(n_tokens: int, seed: int, threshold: float) -> int:
    """Seeds that tiles over ``threshold`` of an item's tokens hold at least."""
    if n_tokens < seed:
        return 1
    return max(1, -(-math.ceil(threshold * n_tokens - 1e-9) // seed))


def _item_seeds(items: DataFrame, seed: int, threshold: float) -> DataFrame:
    """``item, n, times, seed, spare``: how often an item has a seed, and how many seeds need not be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = tokens(text)
                if words:
                    n = min(seed, len(words))
                    found, times = np.unique(seed_hashes(hashes(words), n), return_counts=True)
                    spare = needed(len(words), seed, threshold) - 1
                    out += ((item, n, t, h, spare) for h, t in zip(found.view(np.int64).tolist(), times.tolist(), strict=True))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["item", "n", "times", "seed", "spare"])

    return items.select("item", "text").mapInArrow(run, "item long, n int, times int, seed long, spare int")


def _filter(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds: a word by the upper bits of a seed, in it one by the lowest six.  There are no more rows than words."""
    bit = F.expr("shiftleft(1L, cast(seed & 63 AS int))")
    held = seeds.groupBy(F.shiftrightunsigned("seed", 64 - WORDS.bit_length() + 1).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(WORDS, np.uint64)
    out[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _kept(docs: DataFrame, bits: np.ndarray, lengths: list[int], least: int) -> DataFrame:
    """``doc_id, text, seeds`` of the documents with at least ``least`` seeds in the filter."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, shift = Hashes(), held.value, np.uint64(64 - WORDS.bit_length() + 1)
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            rows, seeds = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = hashes(tokens(text))
                found = [h[(known[h >> shift] >> (h & np.uint64(63))) & np.uint64(1) > 0] for h in (seed_hashes(ids, n) for n in lengths)]
                if sum(map(len, found)) >= least:
                    rows.append(i)
                    seeds.append(np.unique(np.concatenate(found)).view(np.int64))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seeds, pa.list_(pa.int64()))], ["doc_id", "text", "seeds"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, seeds array<long>")


def _pairs(held: DataFrame, seeds: DataFrame) -> DataFrame:
    """``row, item`` that share a seed which counts; ``held`` has ``row, seed``."""
    common = cut(held.groupBy("seed").agg(F.count("*").alias("docs")))
    known = seeds.join(common, "seed").withColumn("upto", F.sum("times").over(Window.partitionBy("item").orderBy(F.desc("docs"), "seed")))
    joined = known.where(F.col("upto") > F.col("spare"))  # an item's seeds go to one task: there are no more than its tokens
    salts = F.ceil(F.col("docs") / SALTED).cast("int")
    hot = F.broadcast(cut(common.where(F.col("docs") > SALTED).select("seed", salts.alias("salts"))))  # one row for so many of a document's seeds
    salted = held.join(hot, "seed", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int"))
    dealt = joined.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(dealt.select("seed", "salt", "item"), ["seed", "salt"]).select("row", "item").distinct()


def _tiled(batches: Iterator[pa.RecordBatch], seed: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows with a document and some items to the items that leak."""
    names, kinds = [x.split(" ", 1)[0] for x in LEAKS.split(", ")[:5]] + ["tiles"], [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    kinds.append(pa.list_(pa.struct([(x, pa.int32()) for x in ("doc_start", "item_start", "length")])))
    for batch in chain.from_iterable(slices(b, "text", 1_000_000) for b in batches):
        out = []
        for doc_id, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
            vocab: dict[str, int] = {}
            split = [(x["item_id"], np.array([vocab.setdefault(w, len(vocab) + 1) for w in tokens(x["item_text"])], np.int64)) for x in items]
            words = tokens(text)
            ids = np.fromiter((vocab.get(w, 0) for w in words), np.int64, len(words))
            for item_id, item in split:
                tiles = tile(ids, item, min(seed, len(item)))
                covered = sum(n for _, _, n in tiles)
                if covered >= threshold * len(item) - 1e-9:
                    out.append((doc_id, item_id, covered / len(item), covered, len(item), [dict(zip(("doc_start", "item_start", "length"), x, strict=True)) for x in tiles]))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document row and a benchmark item that leaks into it, with the tiles found.

    ``docs`` has ``doc_id, text`` and ``benchmark`` ``item_id, text``; other columns are not
    read.  Null and empty texts, and texts without a token, match nothing.  Each of several
    equal document rows is reported; equal item rows count once; null ids stay null.  Empty
    tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = stored(_item_seeds(items, seed, threshold), "seeds")
    shape = seeds.groupBy("n").agg(F.min("spare").alias("spare")).collect()  # a row for each length of a seed
    if not shape:
        return docs.sparkSession.createDataFrame([], LEAKS)
    least = 1 + min(r["spare"] for r in shape)
    kept = _kept(docs, _filter(seeds), sorted(r["n"] for r in shape), least)
    kept = stored(kept.withColumn("row", F.monotonically_increasing_id()), "kept")
    pairs = cut(_pairs(kept.select("row", F.explode("seeds").alias("seed")), seeds))
    of_item = pairs.groupBy("item").agg(F.count("*").alias("n"))
    named = items.select("item", F.struct("item_id", F.col("text").alias("item_text")).alias("x"))
    told = spread_join(pairs, cut(of_item.join(named, "item")), ["item"]).select("row", "item", "x")
    many = pairs.groupBy("row").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    groups = told.join(many, "row").groupBy("row", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")).agg(F.collect_list("x").alias("items"))
    rows = kept.select("row", "doc_id", "text").join(groups, "row")
    return rows.mapInArrow(lambda b: _tiled(b, seed, threshold), LEAKS)
