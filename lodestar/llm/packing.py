"""Packing of token sequences by first-fit decreasing over a tournament tree.

A document is cut into whole sequences of ``size`` tokens and one rest.  Pieces meet in
groups that a hash draws at random; the number of groups follows the number of pieces, so
no group grows with the corpus.  In a group the pieces go, longest first, into the first
bin with room.  The bins are the leaves of a tournament tree whose inner nodes hold the
largest room below, so finding that bin takes log2(bins) steps.

Texts are tokenised once: where a document is cut does not depend on how it is packed, so
the pass that tokenises it also makes the pieces' checksums, and no ids are shuffled.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

if TYPE_CHECKING:
    from tokenizers import Tokenizer

SIZE = 1024
END = 0
GROUP = 8192
# Fixed value: how byte-level BPE cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Ids:
    """Token ids of texts, by a file of the tokenizers library.

    A byte-level BPE whose merges are in the order of its ids is handed to tiktoken, which
    gives the same ids several times faster; any other model runs as it is.
    """

    def __init__(self, file: str) -> None:
        self.file, self.fast = file, None
        with open(file, encoding="utf-8") as spec:
            ranks = byte_ranks(json.load(spec))
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def model(self) -> Tokenizer:
        """Takes several times the memory of ``fast``, so it is only made for a text that needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.file)
        made.encode_special_tokens = True
        return made

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.array(self.fast(text), "<u4")
            except BaseException as error:  # the one kind that says its regular expression gave up, as on endless white space
                if type(error).__name__ != "PanicException":
                    raise
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=1)
def ids_of(file: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(file)


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes to id for a byte-level BPE that tiktoken can run, else None."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = not spec["normalizer"] and not model.get("dropout") and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not plain:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, the others for 256 on
    other = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    special = {x["id"] for x in spec["added_tokens"]}
    ranks = {t: i for t, i in ranks.items() if i not in special}
    in_order = None not in made and made == sorted(made) and len(ranks) == 256 + len(made)
    return ranks if in_order else None


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The cut documents: ``doc_id, start, length, ids_crc32, doc_tokens``; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        ids_in = ids_of(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, ids = doc_id.as_py(), np.append(ids_in(text.as_py() or ""), np.array([end], "<u4"))
                out += ((doc_id, at, min(size, len(ids) - at), zlib.crc32(ids[at : at + size]), len(ids)) for at in range(0, len(ids), size))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of equal length go in the order given."""
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths == size
    bins[full] = np.arange(full.sum())
    rest = np.flatnonzero(~full)
    rest = rest[np.argsort(-lengths[rest], kind="stable")]
    leaves = 1 << max(0, int(len(rest) - 1).bit_length())
    room = [size] * (2 * leaves)
    base = int(full.sum())
    for i, n in zip(rest.tolist(), lengths[rest].tolist(), strict=True):
        at = 1
        while at < leaves:  # the winner of a match is the leftmost bin with room
            at = 2 * at if room[2 * at] >= n else 2 * at + 1
        bins[i], offsets[i] = base + at - leaves, size - room[at]
        room[at] -= n
        while at > 1:
            at >>= 1
            left, right = room[2 * at], room[2 * at + 1]
            room[at] = left if left >= right else right
    return bins, offsets


def pack(cut_docs: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id, offset, sequence_tokens, padded_tokens`` to rows with ``doc_id, start, length``.

    ``group`` is the mean number of pieces in a group.  A sequence is padded to ``size``
    unless its tokens are a power of two.  The rows must be cut or stored: their places there
    take part in the draw.
    """
    groups = max(1, -(-cut_docs.count() // group))
    fields = [f.name for f in cut_docs.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_docs.schema)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "doc_id", "start", "length"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(np.int64), size)
        total = np.bincount(bins, part["length"].to_numpy(np.int64)).astype(np.int64)[bins]
        padded = np.where(total & (total - 1) == 0, total, size)
        return part[fields].assign(sequence_id=(part["_group"].to_numpy(np.int64) << 32) + bins, offset=offsets, sequence_tokens=total, padded_tokens=padded)

    # A huge document is dealt over many groups, and so are the pieces of many documents with one id or none.
    drawn = F.xxhash64("doc_id", F.floor(F.col("start") / (size * 1024)), F.floor(F.monotonically_increasing_id() / 1024))
    dealt = cut_docs.withColumn("_group", F.pmod(drawn, F.lit(groups))).withColumn("_order", F.xxhash64("doc_id", "start"))
    return dealt.groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long, sequence_tokens long, padded_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, group: int = GROUP) -> DataFrame:
    """Tokenise ``docs`` (``doc_id, text``), add ``end`` to each document, and pack all of it.

    One row for each piece.  A null or empty text is the end token alone.  Rows that repeat
    are packed once each; a null id stays null.  An empty table gives no rows.  Columns
    beside ``doc_id`` and ``text`` are not read.
    """
    return pack(cut(pieces(docs, tokenizer, size, end)), size, group)
