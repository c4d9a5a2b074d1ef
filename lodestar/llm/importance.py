"""Importance resampling towards a target distribution, drawn by a distributed radix sort.

Texts become bags of hashed words and word pairs.  A pass counts the buckets of the corpus
(arrays of fixed size, summed up in each task), the target's are counted likewise, and a second
pass scores each document by its buckets' log gains and adds the noise that makes the highest
scores a weighted draw without replacement.

``radix_places`` sorts: from the lowest digit of the composite key to the highest, each pass is
a stable counting sort.  Rows lie in blocks of consecutive places.  Blocks count their digits;
sums over the blocks before, digit by digit, and over the digits below give where the rows of
each block and digit go; every block then deals its rows out.  A row moves once a pass, no task
sees more than a block, and the places after the last pass are the ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, stored

BUCKETS = 10_000
DIGIT = 11  # bits
BLOCK = 1 << 15  # rows
SEED = 7
_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def buckets(text: str | None, n: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each word and of each pair of words."""
    words = (text or "").encode().translate(_TABLE).split()
    if not words:
        return 0, np.zeros(0, np.int64)
    ones = list(map(zlib.crc32, words))
    pairs = map(zlib.crc32, words[1:], map(zlib.crc32, repeat(b" "), ones))  # the checksum goes on from the word before
    return len(words), np.r_[np.array(ones, np.int64), np.fromiter(pairs, np.int64, len(words) - 1)] % n


def bucket_counts(docs: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """How many features of ``text`` each bucket has: a fixed number of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(buckets(text.as_py(), n)[1], minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: thousandths of the log ratio of the smoothed shares, floored."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(map(float, corpus), map(float, target), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the id (a null id hashes as no text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight, score`` of ``row, doc_id, text``."""
    names = ["row", "doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, features, weights, scores = [], [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    n, found = buckets(text.as_py(), len(gain))
                    weight = int(gain[found].sum()) // len(found) if len(found) else 0
                    words.append(n)
                    features.append(len(found))
                    weights.append(weight)
                    scores.append(weight + noise(doc_id, seed))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (words, features, weights, scores))], names)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _gapless(rows: DataFrame, row: str) -> DataFrame:
    """``place``: places from 0 without gaps from written numbers (partition and place in it)."""
    part, inside = F.shiftright(row, 33), F.col(row).bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition that wrote
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = cut(counts.select("part", F.coalesce(before, F.lit(0)).alias("base")))
    return rows.withColumn("part", part).join(F.broadcast(base), "part").withColumn("place", F.col("base") + inside).drop("part", "base", row)


def _pass(rows: DataFrame, digit: F.Column, block: int) -> DataFrame:
    """One stable counting sort by ``digit``: the new ``place`` of each row."""
    rows = rows.withColumn("block", F.floor(F.col("place") / block)).withColumn("digit", digit.cast("int"))
    counts = cut(rows.groupBy("block", "digit").agg(F.count("*").alias("n")))
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))  # at most 2048 rows
    earlier = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    above = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).join(F.broadcast(base), "digit")
    starts = starts.select("block", "digit", (F.col("base") + F.col("above")).alias("start"))
    columns = [c for c in rows.columns if c not in ("block", "digit", "place")]

    def deal(held: pa.Table, to: pa.Table) -> pa.Table:
        place, d = (held.column(c).to_numpy() for c in ("place", "digit"))
        at = np.empty(len(place), np.int64)
        at[place - place.min()] = np.arange(len(place))  # places are gapless: back in order without comparisons
        order = at[np.argsort(d[at].astype(np.uint16), kind="stable")]
        kinds, first, count = np.unique(d[order], return_index=True, return_counts=True)
        start = np.zeros(int(d.max()) + 1, np.int64)
        start[to.column("digit").to_numpy()] = to.column("start").to_numpy()
        new = np.empty(len(place), np.int64)
        new[order] = np.repeat(start[kinds] - first, count) + np.arange(len(place))
        return held.select(columns).append_column("place", pa.array(new))

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*columns, "place").dtypes)
    return rows.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(deal, schema)


def radix_places(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``place`` of each row in the order of ``keys``, the first one leading: least significant digits first.

    ``rows`` has ``place``, distinct and gapless from 0, which orders equal keys; keys are
    longs without nulls, from 0 on.  Digits that are equal in all rows are passed over.
    """
    spread = rows.agg(*(F.max(k).alias(k) for k in keys)).first()
    for key in reversed(keys):
        for shift in range(0, int(spread[key] or 0).bit_length(), DIGIT):
            digit = F.shiftrightunsigned(key, shift).bitwiseAND((1 << DIGIT) - 1)
            rows = stored(_pass(rows, digit, block), "places")
    return rows


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = SEED, n_buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: of documents with enough words, ``percent`` in a hundred are drawn.

    Ranks go from 1 by falling score, equal scores by rising id; rows without rank are not
    drawn.  A null text counts as empty; a null id comes after all others of its score; rows
    that repeat are drawn each, in any order among equals.  An empty table gives no rows; an
    empty target leaves the smoothed shares.  Columns beside ``doc_id`` and ``text`` are not read.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    gain = gains(bucket_counts(docs, n_buckets), bucket_counts(target, n_buckets))
    rows = stored(weighed(texts, gain, seed), "weights")
    fits = F.col("n_words") >= least_words
    seen = rows.agg(F.count("*").alias("n"), F.count_if(fits).alias("fits"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("score").alias("worst"), F.max("score").alias("best")).first()
    drawn = percent * seen["fits"] // 100
    wide = seen["low"] is not None and seen["high"] - seen["low"] >= 1 << 62
    if wide:  # ids all over the range of longs: their two halves are keys of their own
        high, low = F.shiftright("doc_id", 32) + (1 << 31), F.col("doc_id").bitwiseAND((1 << 32) - 1)
        ids = {"id_high": F.coalesce(high, F.lit(1 << 32)), "id_low": F.coalesce(low, F.lit(0))}
    else:
        ids = {"id_low": F.coalesce(F.col("doc_id") - F.lit(seen["low"]).cast("long"), F.lit((seen["high"] or 0) - (seen["low"] or 0) + 1))}
    span = (seen["best"] or 0) - (seen["worst"] or 0) + 1
    order = {"by_score": F.lit(seen["best"]).cast("long") - F.col("score") + F.when(fits, 0).otherwise(span), **ids}
    keyed = _gapless(rows, "row").withColumns({k: v.cast("long") for k, v in order.items()})
    placed = radix_places(keyed.drop("n_words"), list(order), block)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
