"""Places of regular-expression matches, with DataFrame functions alone.

``split`` gives the text between the leftmost non-overlapping matches and
``regexp_extract_all`` the matches; running sums of their lengths are the places.  The sums
run in chunks, so that many matches in one text don't copy one growing array again and again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
SPAN = "array<struct<start: int, rank: int, end: int, kind: string, score: double>>"


def find(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]], prefix: str = "_") -> DataFrame:
    """Add, for each kind, ``<prefix><kind>``: array of ``(start, end, text, before, after)``.

    ``patterns`` gives each kind its pattern and a cheap condition without which there is no
    match; texts that fail it are not searched.  ``before`` and ``after`` are what lies
    between a match and its neighbours of the same kind.  Places are code points, ends
    exclusive.  Null texts have no match.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({f"{prefix}m_{k}": F.coalesce(F.when(guard, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))), none) for k, (p, guard) in patterns.items()})
    df = df.withColumns({f"{prefix}g_{k}": F.when(F.size(f"{prefix}m_{k}") > 0, F.split(F.col(text), p, -1)) for k, (p, _) in patterns.items()})
    df = df.withColumns({f"{prefix}z_{k}": F.when(F.size(f"{prefix}m_{k}") > 0, _zipped(F.col(f"{prefix}m_{k}"), F.col(f"{prefix}g_{k}"))) for k in patterns})
    df = df.drop(*(f"{prefix}{x}_{k}" for k in patterns for x in "mg"))
    empty = F.array().cast("array<struct<start: int, end: int, text: string, before: string, after: string>>")
    df = df.withColumns({f"{prefix}{k}": F.coalesce(_placed(F.col(f"{prefix}z_{k}")), empty) for k in patterns})
    return df.drop(*(f"{prefix}z_{k}" for k in patterns))


def _zipped(matches: Column, gaps: Column) -> Column:
    """(gap, match, next gap) in chunks."""
    n = F.size(matches)
    rows = F.arrays_zip(F.slice(gaps, 1, n).alias("g"), matches.alias("m"), F.slice(gaps, 2, n).alias("a"))
    rows = F.transform(rows, lambda x: F.struct(x["g"].alias("g"), x["m"].alias("m"), x["a"].alias("a"), F.length(x["g"]).alias("lg"), F.length(x["m"]).alias("lm")))
    return F.transform(F.sequence(F.lit(1), n, F.lit(CHUNK)), lambda i: F.slice(rows, i, CHUNK))


def _placed(chunks: Column) -> Column:
    item = "struct<start: int, end: int, text: string, before: string, after: string>"
    start = lambda kind, at: F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["lg"] + x["lm"])
    bases = F.aggregate(chunks, start("int", F.lit(0)), lambda s, c: F.struct((s["at"] + total(c)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["lg"]
        row = F.struct(begin.alias("start"), (begin + x["lm"]).alias("end"), x["m"].alias("text"), x["g"].alias("before"), x["a"].alias("after")).cast(item)
        return F.struct((begin + x["lm"]).alias("at"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.flatten(F.zip_with(chunks, bases, lambda c, at: F.aggregate(c, start(item, at), step, lambda s: s["out"])))


def gathered(kinds: list[str], keep: dict[str, object], score: dict[str, object], prefix: str = "_") -> Column:
    """All spans by start, then in the order of ``kinds``: ``(start, rank, end, kind, score)``."""

    def part(rank: int, kind: str) -> Column:
        held = F.filter(F.col(f"{prefix}{kind}"), keep[kind]) if kind in keep else F.col(f"{prefix}{kind}")
        of = score.get(kind, lambda x: F.lit(1.0))
        return F.transform(held, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), of(x).alias("score"))).cast(SPAN)

    return F.array_sort(F.concat(*(part(rank, kind) for rank, kind in enumerate(kinds))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every maximal run of spans replaced by ``mark``."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.when((x["start"] >= s["at"]), F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], fresh).alias("out"))

    made = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, made).otherwise(text)
