"""Vectors as array columns, and deterministic stand-ins for embedding models."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..storage import cut, stored
from .text import tokens

KNOWN = 1_000_000  # tokens whose buckets a task remembers

WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
#: Takes a batch of texts and gives, for each, an array with a row for each of its tokens.
TokenEmbedder = Callable[[list[str]], list[np.ndarray]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def normalised(v: Column) -> Column:
    """Length one; the zero vector stays as it is."""
    scale = lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] > 0, s["n"]).otherwise(F.lit(1.0)))
    return _let(v, lambda w: _let(F.named_struct(F.lit("v"), w, F.lit("n"), norm(w)), lambda s: scale(s)))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Inner product of unit vectors, or the negative Euclidean distance."""
    if metric == "cosine":
        return dot(a, b)
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def bucket(token: Column, size: int = DEFAULT.embedding_size) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % size).cast("int")


def token_counts(df: DataFrame, keys: list[str], text: str, size: int = DEFAULT.embedding_size) -> DataFrame:
    """The hashed bag of words as rows: ``keys, bucket, value`` with the value divided by the length."""
    from pyspark.sql import Window

    words = df.select(*keys, F.explode(tokens(F.lower(text))).alias("w")).groupBy(*keys, bucket(F.col("w"), size).alias("bucket")).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))
    return words.select(*keys, "bucket", (F.col("n") / length).alias("value"))


def hashed(text: Column, size: int = DEFAULT.embedding_size) -> Column:
    """The same vector as an array in one expression, for short texts."""
    at = F.transform(tokens(F.lower(text)), lambda w: bucket(w, size))
    add = lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1).otherwise(v))
    return normalised(F.aggregate(at, F.array_repeat(F.lit(0.0), size), add))


class _Buckets(dict):
    """The bucket of each token, as ``bucket`` gives it, kept once it is known."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[token] = made = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.size
        return made


def embedded(df: DataFrame, key: str, text: str, size: int = DEFAULT.embedding_size) -> DataFrame:
    """``key, embedding`` for each row, for long texts; texts without a token get the zero vector.

    Rows of one key have the vector of all their texts, a null key the zero vector.  Tokens are
    counted where the text lies, so no row for a token or a bucket is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(size)
        for batch in batches:
            counts = np.zeros((batch.num_rows, size))
            for i, x in enumerate(batch.column(1)):
                words = WORD.findall(x.as_py() or "")
                counts[i] = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=size)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * size), pa.array(counts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "counts"])

    rows = df.select(F.col(key).alias("key"), F.lower(text))
    made = stored(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, counts array<double>"), "counts")
    counts = F.when(F.col("key").isNotNull(), F.col("counts")).otherwise(F.array_repeat(F.lit(0.0), size))
    several = cut(made.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if not several.isEmpty():
        each = made.join(several, "key", "left_semi").select("key", F.posexplode("counts").alias("at", "n")).groupBy("key", "at").agg(F.sum("n").alias("n"))
        sums = each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("sums"))
        made, counts = made.join(sums, "key", "left"), F.coalesce("sums", counts)
    return made.select(F.col("key").alias(key), normalised(counts).alias("embedding"))


def trigrams(name: Column) -> Column:
    """The letters of a name, three at a time, as tokens; white space counts as one letter."""
    low = F.regexp_replace(F.lower(name), r"\s+", "_")
    each = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) > 2, F.array_join(each, " ")).otherwise(low)


def embedded_names(df: DataFrame, key: str, name: str, size: int = DEFAULT.embedding_size) -> DataFrame:
    """``key, embedding`` for names: hashed trigrams, so that names spelt alike are near each other."""
    return embedded(df.select(key, trigrams(F.col(name)).alias("_name")), key, "_name", size)


def letters(texts: list[str]) -> list[np.ndarray]:
    """A stand-in for a token embedder: how often each of the letters a to z is in a token."""
    out = []
    for text in texts:
        words = WORD.findall(text.lower())
        rows = np.zeros((len(words), 26))
        for row, word in zip(rows, words, strict=True):
            at = np.frombuffer(word.encode("ascii", "replace"), np.uint8).astype(np.int64) - ord("a")
            np.add.at(row, at[(at >= 0) & (at < 26)], 1.0)
        out.append(rows)
    return out


def one_hot(texts: list[str]) -> list[np.ndarray]:
    """Equal tokens have similarity 1, others 0."""
    words = [WORD.findall(text.lower()) for text in texts]
    number = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    out = []
    for ws in words:
        rows = np.zeros((len(ws), len(number)))
        rows[np.arange(len(ws)), np.fromiter((number[w] for w in ws), np.int64, len(ws))] = 1.0
        out.append(rows)
    return out
