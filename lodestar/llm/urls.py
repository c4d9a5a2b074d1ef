"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` (host rules) or over the whole URL in
lower case (pattern rules).  Each has literal tokens, runs of letters and digits that any
URL it matches must contain whole; a rule of several readings has tokens for each.  The rule
is filed under the token of each reading that is rarest in the URLs at hand.  A URL looks up
its own tokens and runs only the rules filed there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MOST_RULES = 1_000_000  # what is sent to every machine is bounded by this

# Host rules as (verdict, host, path).
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Pattern rules as (name, regular expression, mandatory whole tokens of each reading).  They judge
# what no host rule fits, and all of them block.
PATTERN_RULES = [
    ("spam-farm", r"://(?:[^/?#]*\.)?spam-farm\.", (("spam", "farm"),)),
    ("cheap-pills", r"://(?:[^/?#]*\.)?cheap-pills\.", (("cheap", "pills"),)),
    ("casino", r"://(?:[^/?#]*[.-])?casino[.-]", (("casino",),)),
    ("free-money", r"://(?:[^/?#]*[.-])?free-money[.-]", (("free", "money"),)),
    ("replica-watches", r"://(?:[^/?#]*[.-])?replica-watches[.-]", (("replica", "watches"),)),
    ("payday-loans", r"://(?:[^/?#]*[.-])?payday-loans[.-]", (("payday", "loans"),)),
    ("adult", r"://(?:[^/?#]*[.-])?(?:adult|xxx)[.-]", (("adult",), ("xxx",))),
    ("doubleclick", r"://(?:[^/?#]*\.)?doubleclick\.net(?:[:/?#]|$)", (("doubleclick", "net"),)),
    ("session-trap", r"[?&;](?:phpsessid|jsessionid)=", (("phpsessid",), ("jsessionid",))),
]


@dataclass(frozen=True)
class Rule:
    """``tokens``: for each reading, whole tokens of every URL that matches it; a reading without: the rule is tried on every URL."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[tuple[str, ...], ...]
    weight: int  # of the rules that match, the heaviest wins; ties go to the first
    on_host: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """The path's last token may go on in the URL, so it is no whole token."""
    whole = TOKEN.findall(host) + TOKEN.findall(path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])].translate(UPPER))
    if not re.fullmatch(r"[\x00-\x7f]*", host + path) or re.search(r"[A-Z]", path):
        whole = TOKEN.findall(host)
    pattern = rf"(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path) or '(?:/|$)'}"
    return Rule(host + path, verdict, pattern, (tuple(whole),), len(host) + len(path), True)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [Rule(n, "block", p, t, 0, False) for n, p, t in PATTERN_RULES]


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty if the URL is null or has no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def token_counts(pages: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of ``tokens`` occurs; counted where the rows are, added up by token."""
    wanted = frozenset(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = defaultdict(int)
        for batch in batches:
            for x in batch.column(0):
                for t in wanted.intersection(TOKEN.findall((x.as_py() or "").translate(UPPER))):
                    seen[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counts = pages.select(url).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}  # no more rows than the rules have tokens


def judge(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, pattern``.

    ``rule`` is the longest host rule that fits (null if none does) and gives the verdict.
    Else ``pattern`` is the first pattern rule that matches, whose verdict holds; else the
    verdict is allow.  A null URL has empty host and path and is allowed.  Columns of
    ``pages`` with the names of results are replaced; all rows stay, repeated ones too.
    """
    rules = default_rules() if rules is None else rules
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; deal them into lists of at most {MOST_RULES}")
    made = ["host", "path", "rule", "verdict", "pattern"]
    rest = [c for c in pages.columns if c not in made]
    counts = token_counts(pages, url, sorted({t for r in rules for reading in r.tokens for t in reading}))
    filed, always = defaultdict(list), []
    for at, r in enumerate(rules):
        row = (at, r.name, r.verdict, r.pattern, r.weight, r.on_host)
        if all(r.tokens):
            for rarest in {min(reading, key=lambda t: (counts.get(t, 0), -len(t), t)) for reading in r.tokens}:
                filed[rarest].append(row)
        else:
            always.append(row)
    held = pages.sparkSession.sparkContext.broadcast((dict(filed), always))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*rest).schema), *(f"{c} string" for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed, always = held.value
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            out = []
            for x in batch.column(url).to_pylist():
                host, path = parts(x)
                whole, low = host + path, (x or "").translate(UPPER)
                tried = always + [r for t in set(TOKEN.findall(low)) for r in filed.get(t, ())]
                best = {True: None, False: None}
                for at, name, verdict, pattern, weight, on_host in tried:
                    p = compiled.get(at) or compiled.setdefault(at, re.compile(pattern, re.DOTALL))
                    if (p.match(whole) if on_host else p.search(low)) and (best[on_host] is None or (weight, -at) > best[on_host][0]):
                        best[on_host] = ((weight, -at), name, verdict)
                of_host, of_url = best[True], best[False]
                out.append((host, path, of_host and of_host[1], (of_host or of_url or (0, "", "allow"))[2], of_url and of_url[1]))
            columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * len(made)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, *made])

    return pages.select(*rest).mapInArrow(run, schema)
