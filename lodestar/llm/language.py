"""Language identification of spans.

The script of a word's first letter narrows the languages that may have written it.  Each
of those gets the word's log-probability under naive Bayes over character n-grams.  Viterbi
over the words of a text, with a penalty for each switch, labels every word; runs of equal
labels are the spans, and the language of a text is the one with most labelled letters.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ROWS = 12_000  # at most so many labelled rows are learned from
LANGUAGES = 256  # and at most so many languages, the most frequent ones
BITS = 16
ORDERS = (1, 2, 3, 4)
PENALTY = 6.0
MOST = 8.0  # a word counts for no more than this, in nats, against a language
KEPT = 200_000
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())  # such as ½ and Ⅻ: word characters, but no letters
WORD = re.compile(rf"[^\W\d_{_NUMERALS}]+")
LETTERS = re.compile(r"[^\W\d_]+")  # the same but for numerals, without a long list of characters to go through
# First code point of each script block, and the script's name.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Latin"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x31F0, "Kana"),
    (0x3400, "Han"), (0xA000, "Yi"), (0xA720, "Latin"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({b for _, b in SCRIPTS})
CODES = np.array([NAMES.index(b) for _, b in SCRIPTS])
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def pattern(text: str) -> re.Pattern:
    """``WORD``, or what finds the same words faster in a text without numerals."""
    return LETTERS if "".join(LETTERS.findall(text)).isalpha() else WORD


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text)
    return found if "".join(found).isalpha() else WORD.findall(text)


def scripts(words: list[str]) -> np.ndarray:
    """The script code of each word's first letter."""
    return CODES[np.searchsorted(STARTS, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), "right") - 1]


def grams(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and word number of every n-gram of the words, each between two spaces."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = codes == 32
    word = np.cumsum(space) - 1  # of the space in front of it, too
    out, h, inner = [], np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n > 2:  # a space may only be first or last
            inner = inner[: len(h)] | space[n - 2 : n - 2 + len(h)]
        if n in ORDERS:
            keep = ~space if n == 1 else ~inner[: len(h)] & ~(space[: len(h)] & space[n - 1 :])
            out.append((((h[keep] ^ np.uint64(n)) * GOLDEN) >> np.uint64(64 - bits), word[: len(h)][keep]))
    bucket, owner = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    return bucket, owner


class Model:
    """Log-probabilities of buckets, and which languages write in which script."""

    def __init__(self, langs: list[str], log_p: np.ndarray, written: np.ndarray) -> None:
        self.langs, self.log_p, self.written = langs, log_p, written

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): nats against the best language, -MOST at least; 0 for all if no language has the script."""
        bucket, owner = grams(words)
        total = np.stack([np.bincount(owner, self.log_p[bucket, k], len(words)) for k in range(len(self.langs))], 1)
        may = self.written[scripts(words)]
        total[~may] = -np.inf
        known = may.any(1)
        total[~known] = 0
        return np.maximum(total - total.max(1, keepdims=True), -MOST).astype(np.float32)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word, for texts that lie one after another; all texts go in step."""
    order = np.argsort(-sizes, kind="stable")
    at, long = (np.cumsum(sizes) - sizes)[order], sizes[order]
    active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), "left")  # texts with more than t words
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    best = scores[at[: active[0]]] if len(active) else scores[:0]
    last = np.zeros(len(long), np.int16)
    for t in range(1, len(active)):
        k, before = active[t], active[t - 1]
        if k < before:
            last[k:before] = best[k:before].argmax(1)
        best = best[:k]
        top = best.max(1, keepdims=True) - penalty
        stay = best >= top
        back[at[:k] + t] = np.where(stay, own, best.argmax(1, keepdims=True))
        best = np.where(stay, best, top) + scores[at[:k] + t]
    if len(active):
        last[: active[-1]] = best.argmax(1)
    labels = np.zeros(len(scores), np.int16)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        where = at[:k] + t
        labels[where] = last[:k]
        last[:k] = back[where, last[:k]]
    return labels


class Labeller:
    """Labels texts; keeps the scores of at most ``kept`` words."""

    def __init__(self, model: Model, penalty: float, kept: int = KEPT) -> None:
        self.model, self.penalty, self.kept = model, penalty, kept
        self.clear()

    def clear(self) -> None:
        self.rows, self.table = {}, np.zeros((0, len(self.model.langs)), np.float32)

    def _add(self, words: set[str]) -> None:
        new = list(words.difference(self.rows))
        if len(self.rows) + len(new) > self.kept:
            self.clear()
            new = list(words)
        parts = [self.table]
        for i in range(0, len(new), 20_000):
            parts.append(self.model.scores(new[i : i + 20_000]))
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.table = np.concatenate(parts)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        lowered = [(x or "").lower() for x in texts]
        words = [words_of(x) for x in lowered]
        self._add(set(chain.from_iterable(words)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        letters = np.fromiter(map(len, chain.from_iterable(words)), np.int64, sizes.sum())
        labels = viterbi(self.table[rows], sizes, self.penalty)
        ends = np.cumsum(sizes)
        for text, low, a, b in zip(texts, lowered, ends - sizes, ends, strict=True):
            if a == b:
                yield "und", 0.0, []
                continue
            own = labels[a:b]
            shares = np.bincount(own, letters[a:b], len(self.model.langs))
            best = int(shares.argmax())
            yield self.model.langs[best], float(shares[best] / shares.sum()), self._spans(text or "", low, own)

    def _spans(self, text: str, low: str, own: np.ndarray) -> list[tuple[int, int, str]]:
        """Runs of one label: start and end in code points of the text."""
        cuts = np.flatnonzero(np.diff(own)) + 1
        if not len(cuts):
            word = pattern(text)
            first = word.search(text)
            return [(first.start(), len(text) - word.search(text[::-1]).start(), self.model.langs[own[0]])] if first else []
        at = [m.span() for m in pattern(low).finditer(low)]
        if len(text) != len(low):  # a letter may be lowered to several code points
            ends = np.cumsum([len(c.lower()) for c in text])
            place = lambda i: int(np.searchsorted(ends, i, "right"))
            at = [(place(i), place(j - 1) + 1) for i, j in at]
        starts = [0, *cuts.tolist()]
        return [(at[i][0], at[j - 1][1], self.model.langs[own[i]]) for i, j in zip(starts, [*starts[1:], len(own)], strict=True)]


def fit(docs: DataFrame, rows: int = ROWS, languages: int = LANGUAGES) -> Model:
    """Learn from ``docs`` (``doc_id, text, lang``); rows with a null text or lang are left out.

    At most ``rows`` rows count, the first in the order of a hash of the id, and at most
    ``languages`` languages, so the model has a bounded size.
    """
    keyed = docs.where("text is not null and lang is not null").withColumn("draw", F.xxhash64("doc_id", F.lit("language")))
    bound = keyed.orderBy("draw").select("draw").limit(rows).agg(F.max("draw").alias("draw")).first()["draw"]
    sample = keyed.where(F.col("draw") <= F.lit(bound)).select("text", F.col("lang").cast("string").alias("lang"))
    n_scripts = len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if words := words_of(text.lower()):
                    own = seen.setdefault(lang, np.zeros((1 << BITS) + n_scripts, np.int64))
                    own[: 1 << BITS] += np.bincount(grams(words)[0], minlength=1 << BITS)
                    own[1 << BITS :] += np.bincount(scripts(words), minlength=n_scripts)
        for lang, own in seen.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(own[some])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = sorted(found.groupby("lang")["n"].sum().sort_values(ascending=False, kind="stable").index[:languages])
    table = np.zeros(((1 << BITS) + n_scripts, len(langs)))
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    grams_of, written = table[: 1 << BITS], table[1 << BITS :]
    log_p = np.log((grams_of + 0.5) / (grams_of.sum(0) + 0.5 * (1 << BITS))) if langs else grams_of
    return Model(langs, log_p.astype(np.float32), written > 0.001 * written.sum(0))


def label(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row of ``docs`` (``doc_id, text``).

    ``lang_pred`` is ``und``, the score 0 and the spans empty if the text is null or has no
    letter, or if the model knows no language.  The score is the share of the letters that
    the spans give to ``lang_pred``.  Spans have start and end (exclusive) in code points.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by BITS and LANGUAGES
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value)
        labeller = Labeller(model, penalty) if model.langs else None
        for batch in chain.from_iterable(slices(b, "text", 6_000_000) for b in batches):
            texts = batch.column("text").to_pylist()
            made = list(labeller(texts)) if labeller else [("und", 0.0, [])] * len(texts)
            spans = [[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in made]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
