"""Sentence ends learned from the corpus itself: a full stop behind an abbreviation ends no sentence.

The method is that of Kiss and Strunk, "Unsupervised multilingual sentence boundary detection"
(2006).  A word is an abbreviation if it comes with a full stop far more often than chance
tells, is short, and hardly ever comes without one.  An abbreviation may still end a sentence:
it does if the next word is capitalised here but written small elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import SENTENCE_END, WHITE
from ..functions.vectors import WORD
from ..storage import cut, looked_up

THRESHOLD = 0.3
ALMOST_SURE = 0.99
WORD_CHARS = 64  # a longer word's score is nothing: it falls by e with each character


@dataclass(frozen=True)
class Learned:
    """``abbreviations``: word, n_ended, n_open, score; ``small``: words written small rather than large inside of sentences."""

    abbreviations: DataFrame
    small: DataFrame


def _core(token: Column) -> Column:
    """A token without the marks around it but full stops at its end; null for one without a letter, or a very long one."""
    bare = F.when(F.length(token) <= WORD_CHARS, F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", ""))
    return F.when(bare.rlike(r"\p{L}"), bare)


def _word(core: Column) -> Column:
    return F.lower(F.rtrim(core, F.lit(".")))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n_ended, n_open, n_small, n_large``: with a full stop and without, small, and capitalised inside of a sentence.

    One pass, and shuffles of counts.  Null and blank texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, inner = Counter(), Counter()
            for x in batch.column(0):
                words = WORD.findall(x.as_py() or "")
                every.update(words)
                inner.update(b for a, b in zip(words, words[1:]) if a[-1] not in ".!?:")
            rows = [(w, False, n - inner[w]) for w, n in every.items()] + [(w, True, n) for w, n in inner.items()]
            rows = [r for r in rows if len(r[0]) <= WORD_CHARS and r[2]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64()))], ["token", "inside", "n"])

    seen = docs.select(F.col(text).alias("text")).mapInArrow(run, "token string, inside boolean, n long")
    times = seen.groupBy("token", "inside").agg(F.sum("n").alias("n"))
    rows = times.withColumn("core", _core(F.col("token"))).where("core is not null")  # once for all that are written alike
    number = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    ended = F.endswith(F.col("core"), F.lit("."))
    return rows.groupBy(_word(F.col("core")).alias("word")).agg(
        number(ended).alias("n_ended"), number(~ended).alias("n_open"), number(F.col("core").rlike(r"^\p{Ll}")).alias("n_small"),
        number(F.col("core").rlike(r"^\p{Lu}") & F.col("inside")).alias("n_large"),
    )


def scored(counts: DataFrame) -> DataFrame:
    """``counts`` with ``score``: a log-likelihood ratio, times factors for shortness, stops inside and uses without a stop.

    It compares the share of full stops of all words with ``ALMOST_SURE``.  Where no word has a
    full stop, or all have one, nothing can be told and the score is 0.
    """
    whole = F.broadcast(counts.agg((F.sum("n_ended") / F.sum(F.col("n_ended") + F.col("n_open"))).alias("_p")))  # one row
    p, sure, k, rest = F.col("_p"), F.lit(ALMOST_SURE), F.col("n_ended"), F.col("n_open")
    ratio = -2.0 * (k * F.ln(p) + rest * F.ln(1 - p) - k * F.ln(sure) - rest * F.ln(1 - sure))
    size = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    stops = F.length("word") - size + 1
    score = ratio * F.exp(-size) * stops * F.pow(size, -rest.cast("double"))
    return counts.crossJoin(whole).withColumn("score", F.when((p > 0) & (p < 1), score).otherwise(0.0)).drop("_p")


def learn(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> Learned:
    """What all ``docs`` tell of their words; both tables are written, as they are joined more than once."""
    counts = cut(word_counts(docs, text))
    known = scored(counts).where(F.col("score") >= threshold).select("word", "n_ended", "n_open", "score")
    return Learned(cut(known), cut(counts.where("n_small > n_large").select("word")))


STOP = StructType([StructField("i", IntegerType()), StructField("last", StringType()), StructField("following", StringType())])
_END, _LAST = re.compile(f"([.!?][{WHITE}]+)"), re.compile(f"[^{WHITE}]*$")


def _pieces(text: str | None) -> list[str]:
    """Text up to and with the white space behind each . ! or ?"""
    return _END.sub(rf"\1{SENTENCE_END}", text or "").split(SENTENCE_END)


@F.udf(ArrayType(STOP), useArrow=True)
def _stops(text: str | None) -> list[tuple[int, str, str | None]]:
    """The pieces that end with a full stop, their last word and the next one, where there is one; of long words the part that tells that."""
    pieces, edge, out = _pieces(text), WORD_CHARS + 1, []  # a longer token has no core, nor has what is cut of it
    for i, piece in enumerate(pieces):
        last = _LAST.search(piece.rstrip(WHITE)[-edge:]).group()
        if last.endswith("."):
            following = WORD.match(pieces[i + 1].lstrip(WHITE)[:edge]) if i + 1 < len(pieces) else None
            out.append((i, last, following and following.group()))
    return out


@F.udf(ArrayType(StringType()), useArrow=True)
def _sentences(text: str | None, joints: list[int] | None) -> list[str]:
    """The pieces, each that is in ``joints`` put together with the next one; stripped, blank ones dropped."""
    pieces, on, out, begin = _pieces(text), {*(() if joints is None else joints)}, [], 0
    for i in range(len(pieces)):
        if i not in on or i + 1 == len(pieces):
            out.append("".join(pieces[begin : i + 1]).strip(WHITE))
            begin = i + 1
    return [x for x in out if x]


def _joints(docs: DataFrame, learned: Learned) -> DataFrame:
    """``node, joints``: of each text (by digest) the pieces that the next one goes on, where there are any."""
    ends = docs.select("_digest", F.explode(_stops("_text")).alias("j"))
    ends = ends.select("_digest", "j.i", _core(F.col("j.last")).alias("a"), _core(F.col("j.following")).alias("b")).where("a is not null")
    ends = ends.select("_digest", "i", _word(F.col("a")).alias("a"), _word(F.col("b")).alias("b"), F.coalesce(F.col("b").rlike(r"^\p{Lu}"), F.lit(False)).alias("large"))
    after = cut(looked_up(ends, "a", learned.abbreviations.select(F.col("word").alias("node"), F.lit(True).alias("short"))).where("short").distinct())
    told = looked_up(after, "b", learned.small.select(F.col("word").alias("node"), F.lit(True).alias("small")))
    return told.where("not (large and coalesce(small, false))").groupBy(F.col("_digest").alias("node")).agg(F.collect_list("i").alias("joints"))


def with_sentences(docs: DataFrame, learned: Learned, text: str = "text", to: str = "sentences") -> DataFrame:
    """``docs`` with an array of their sentences: split as by ``functions.text.sentences``, but not behind abbreviations.

    A full stop behind an abbreviation ends a sentence only if a capitalised word follows that is
    written small elsewhere.  Sentences keep the white space inside of them; blank ones are
    dropped; null and blank texts have none.  Equal texts are split once and the same way; texts
    move only if the table of places behind abbreviations is too large to be sent out.
    """
    named = docs.withColumn("_digest", F.md5(F.coalesce(text, F.lit(""))))
    joints = cut(_joints(named.select("_digest", F.col(text).alias("_text")), learned))
    found = looked_up(named, "_digest", joints)
    return found.withColumn(to, _sentences(text, "joints")).select(*(c for c in docs.columns if c != to), to)
