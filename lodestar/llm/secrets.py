"""Secret scans over a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression gives a Boolean query: which trigrams a text must hold for the
rule to match.  The index has a row for each trigram and document (posting lists as rows,
only of trigrams that some rule asks for).  Intersecting and uniting the postings of a
document leaves the rules it may match, and only those are verified by their expression.  A
rule without mandatory trigrams is run on every text.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import cut, small, unused

# The rules.  Each has a pattern that reads alike in Java and Python, and, where
# a match must pass a test, the least length of what group 1 (the whole match if 0) holds.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}+", 0, 0),
    "hex": (r"[0-9a-f]{16,}+", 0, 0),
}
EXTRA = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}+", 0, 0),
    "google": (r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    "stripe": (r"[sr]k_live_[0-9A-Za-z]{16,}+", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 0),
    "private": (r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 0),
}
RULES = BASE | EXTRA
MARK = "[SECRET]"
STRINGS = 64  # a part of a pattern with more readings than this counts as anything


def _readings(item: tuple) -> list[str] | None:
    """All lower-cased strings that a part of a pattern may match, or None for too many."""
    op, arg = item
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN and all(x is C.LITERAL for x, _ in arg):
        return sorted({chr(v).lower() for _, v in arg})
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else sorted({s for p in parts for s in p})
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[1] <= 5 and (once := _sequence(arg[2])) is not None:
        made = [("".join(x)) for n in range(arg[0], arg[1] + 1) for x in product(once, repeat=n)]
        return sorted(set(made)) if len(made) <= STRINGS else None
    return None


def _sequence(items: list) -> list[str] | None:
    out = [""]
    for item in items:
        own = _readings(item)
        if own is None or len(out) * len(own) > STRINGS:
            return None
        out = [a + b for a in out for b in own]
    return out


def _runs(items: list) -> list[list[str]]:
    """Maximal stretches of the pattern that have few readings, all of which a match must contain."""
    out, now = [], [""]
    for item in items:
        own = _readings(item)
        if own is not None and len(now) * len(own) <= STRINGS:
            now = [a + b for a in now for b in own]
            continue
        out.append(now)
        now = own if own is not None else [""]
        if own is None and item[0] is C.SUBPATTERN:
            out += _runs(item[1][3])
        elif own is None and item[0] in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and item[1][0] > 0:
            out += _runs(item[1][2])
    return [*out, now]


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Conjunction of disjunctions of trigram sets: each inner list needs one set held whole.

    Trigrams are lower-cased, so the query holds for patterns that ignore case, too.  An
    empty conjunction means that nothing is mandatory.
    """
    query = []
    for run in _runs(list(_parser.parse(pattern))):
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if all(sets):
            query.append(sorted({a for a in sets if not any(b < a for b in sets)}, key=sorted))
    return query


def index(docs: DataFrame, rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """The postings ``gram, doc_id`` of all trigrams that the rules ask for."""
    grams = sorted({g for p, _, _ in rules.values() for any_of in trigram_query(p) for held in any_of for g in held})
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams))) if grams else F.array().cast("array<string>")
    return docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(held).alias("gram"))


def candidates(postings: DataFrame, rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """``doc_id, may``: the indexed rules whose trigram query the postings of a document fulfil."""
    held = postings.groupBy("doc_id").agg(F.collect_set("gram").alias("held"))  # at most as many as the rules have trigrams
    of = {}
    for rule, (pattern, _, _) in rules.items():
        if query := trigram_query(pattern):
            whole = lambda grams: reduce(lambda a, b: a & b, (F.array_contains("held", g) for g in sorted(grams)))
            of[rule] = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(whole, any_of)) for any_of in query))
    may = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in of.items()))) if of else F.array().cast("array<string>")
    return held.select("doc_id", may.alias("may")).where(F.size("may") > 0)


def find(docs: DataFrame, to: str = "secrets", rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """Add ``to``: the spans of secrets in ``text``, ``(start, rank, end, kind, score)`` by start.

    ``docs`` has ``doc_id, text``.  Null and empty texts have none.  Rows with equal or null
    ids share their postings, which only widens the candidates; every row is verified on its
    own text.  Other columns stay as they are, whatever their names.
    """
    found = cut(candidates(index(docs.select("doc_id", "text"), rules), rules))
    free = unused(docs, "secret")
    right = small(found.select(F.col("doc_id").alias(f"{free}id"), F.col("may").alias(f"{free}may")))
    full = [r for r, (p, _, _) in rules.items() if not trigram_query(p)]
    df = docs.join(right, docs["doc_id"].eqNullSafe(right[f"{free}id"]), "left")
    may = {r: F.lit(True) if r in full else F.coalesce(F.array_contains(f"{free}may", r), F.lit(False)) for r in rules}
    df = S.find(df, "text", {r: (p, may[r]) for r, (p, _, _) in rules.items()}, free)
    keep = {r: partial(_long, r, rules) for r, (_, _, n) in rules.items() if n}
    return df.withColumn(to, S.gathered(list(rules), keep, {}, free)).drop(f"{free}id", f"{free}may", *(f"{free}{r}" for r in rules))


def _long(rule: str, rules: dict[str, tuple[str, int, int]], x: Column) -> Column:
    pattern, group, least = rules[rule]
    return F.length(F.regexp_extract(x["text"], pattern, group)) >= least


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; ``n_chars``, if there, is counted anew.

    Rows without a secret stay as they are, null and empty texts too; an empty table stays empty.
    """
    free = unused(docs, "found")
    made = find(docs, free)
    made = made.withColumn("text", S.redacted(F.col("text"), F.col(free), mark))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.size(free) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, the base spans' SHA-256, and all spans as text.

    Null and empty texts have no span; a text of any length is searched whole; every one of
    several equal rows is given; an empty table gives no rows, and other columns are not read.
    """
    found = find(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["rank"] < len(BASE))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(S.counted(F.col("secrets"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(S.listed(base), 256).alias("base_sha256"),
        S.listed(F.col("secrets")).alias("spans"),
    )
