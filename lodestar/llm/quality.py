"""Quality rules: figures of each text, and lines that too many documents of a host share.

One pass measures every document and hashes its normalised lines (A-Z lowered, digits as 0,
white space squeezed).  A line's count is that of the distinct documents of a host that hold
it: documents with one text count once, so copies alone do not condemn what they say.  Lines
above the host's limit are removed, and a document that is depleted by that is rejected.

The counts are summed up before they are shuffled; the few lines above the limit go back to
the documents by a join that sends out its hot keys, as one line may stand in a third of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small, spread_join, stored, unused

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """A line goes if more than ``max(documents, share of the host's)`` distinct documents hold it; a
    document goes if less than ``left`` of its words stay."""

    documents: int = 10
    share: float = 0.001
    left: float = 0.5
    least_words: int = 20
    repeated_percent: int = 30


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    made = np.zeros(n, np.uint64)
    for i in range(window):
        made = (made ^ (made >> np.uint64(29))) * _K + hashes[i : i + n]
    _, which, times = np.unique(made, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    begin = np.flatnonzero(times[which] > 1)
    np.add.at(steps, begin, 1)
    np.add.at(steps, begin + window, -1)
    return int((np.cumsum(steps) > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[dict[str, object]]]:
    """The ``FIGURES`` of a text, and its normalised lines: ``key``, ``words`` and the ``places`` of the line."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = data.split(b"\n")
    normal: dict[int, dict] = {}
    seen: set[bytes] = set()
    filled = 0
    for place, (line, plain) in enumerate(zip(lines, data.translate(NORMAL).split(b"\n"), strict=True)):
        parts = plain.split()
        if parts:
            filled += 1
            seen.add(line)
            key = xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63)
            held = normal.setdefault(key, {"key": key, "words": 0, "places": []})
            held["words"] += len(parts)
            held["places"].append(place)
    chars = len(text) - sum(map(text.count, SPACES))
    return [len(words), chars, sum(map(text.count, SYMBOLS)), filled - len(seen), repeated_words(words)], list(normal.values())


def _measured(rows: DataFrame) -> DataFrame:
    """``row, doc_id, host, same``, the figures and ``lines`` of ``row, doc_id, text, host``."""
    line = pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int32()), ("places", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                made = [measure(t) for t in texts]
                same = pa.array([xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63) for t in texts], pa.int64())
                figures = [pa.array([m[0][i] for m in made], pa.int64()) for i in range(len(FIGURES))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "host")), same, *figures, pa.array([m[1] for m in made], line)], ["row", "doc_id", "host", "same", *FIGURES, "lines"])

    figures = ", ".join(f"{f} long" for f in FIGURES)
    return rows.mapInArrow(run, f"row long, doc_id long, host long, same long, {figures}, lines array<struct<key: long, words: int, places: array<int>>>")


def frequent(measured: DataFrame, limits: Limits) -> DataFrame:
    """``host, key, n``: lines above their host's limit, and how many documents hold them."""
    hosts = cut(measured.groupBy("host").agg(F.countDistinct("same").alias("documents")))
    lines = measured.select("host", "same", F.explode("lines").alias("line")).select("host", "same", "line.key")
    counts = lines.groupBy("host", "key").agg(F.countDistinct("same").alias("documents"), F.count("*").alias("n")).where(F.col("documents") > limits.documents)
    bound = hosts.select("host", (F.col("documents") * limits.share).alias("most"))
    return cut(counts.join(small(bound), "host").where(F.col("documents") > F.col("most")).select("host", "key", "n"))


def _judged(rows: DataFrame, limits: Limits) -> DataFrame:
    measured = stored(_measured(rows), "quality")
    often = frequent(measured, limits)
    lines = measured.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    gone = spread_join(lines, often, ["host", "key"]).groupBy("row").agg(F.sum("words").alias("removed_words"), F.flatten(F.collect_list("places")).alias("removed_lines"))
    out = measured.drop("lines", "host", "same").join(gone, "row", "left")
    n, removed = F.col("n_words"), F.coalesce("removed_words", F.lit(0))
    failed = (n < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeated_percent * n)
    depleted = n - removed < limits.left * n
    return out.select(
        "row", "doc_id", *FIGURES, removed.alias("removed_words"), F.array_sort(F.coalesce("removed_lines", F.array().cast("array<int>"))).alias("removed_lines"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )


def _rows(docs: DataFrame, host: str, row: F.Column) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("long"), "text", F.xxhash64(host).alias("host"))


def judge(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, the figures, ``removed_words``, ``removed_lines`` (places, from 0), ``base_failed, kept``.

    A null text counts as empty, which fails the rules; rows without a host are one host.
    Rows that repeat, with equal or null ids too, are judged each; an empty table gives no
    rows.  Columns beside ``doc_id``, ``text`` and ``host`` are not read.
    """
    return _judged(_rows(docs, host, F.monotonically_increasing_id()), limits).drop("row")


def clean(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, without the lines above the limit.

    Null and empty texts go; what is said of ``judge`` holds.
    """
    row = unused(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = _judged(_rows(numbered, host, F.col(row)), limits).where("kept").select(F.col("row").alias(row), F.col("removed_lines").alias(f"{row}gone"))
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(f"{row}gone", i))
    return numbered.join(found, row).withColumn("text", F.array_join(left, "\n")).select(*docs.columns)
