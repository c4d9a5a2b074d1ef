"""Personal data: patterns propose spans, checksums confirm them, words nearby set the score.

All of it is DataFrame functions.  Quantifiers are possessive and tries start at the first
character of a run (or right after the last match), which finds the same matches as the
plain patterns in linear time: no run of a long text is tried from each of its characters.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import unused

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["iban"]
# Length of an IBAN by country.
IBAN = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}
LOCAL = "[A-Za-z0-9._%+-]"


def _iban() -> str:
    by_length = defaultdict(list)
    for country, n in IBAN.items():
        by_length[n].append(country)
    forms = (f"(?:{'|'.join(c)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return f"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
}
# Score without context; what a word nearby adds; the words that raise and that lower it.
CONTEXT = {
    "email": (0.9, 0.1, "mail|contact|write|kontakt|correo|courriel", "example"),
    "ip": (0.6, 0.3, r"\bip\b|address|server|host|client|adresse", "version|release|section"),
    "card": (0.7, 0.3, "card|visa|credit|payment|karte|carte|tarjeta", "isbn|order|invoice|tracking"),
    "phone": (0.6, 0.3, "phone|tel|call|mobile|fax|telefon", "isbn|order|invoice"),
    "iban": (0.6, 0.3, "iban|account|bank|konto|compte|cuenta", "serial|order"),
}
NEAR = 40
LEAST = 0.5  # an added span needs this score


def _guards(text: Column) -> dict[str, Column]:
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9](?:\.[0-9]++){3}"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": F.contains(text, F.lit("+")),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    }


def _small(part: Column) -> Column:
    """At most 255, whatever zeros come first."""
    digits = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(digits) <= 3, F.concat(F.lit("0"), F.substring(digits, 1, 3)).cast("int") <= 255).otherwise(F.lit(False))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:  # i counts from the right
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return total + d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _keep(kind: str, x: Column) -> Column:
    text = x["text"]
    if kind == "ip":
        return F.forall(F.split(text, r"\."), _small)
    if kind == "card":
        digits = F.regexp_replace(text, "[^0-9]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(text, F.lit(" "), F.lit(""))) & (_score(kind, x) >= LEAST)
    return F.lit(True)


def _score(kind: str, x: Column) -> Column:
    base, step, up, down = CONTEXT[kind]
    near = F.lower(F.concat(F.substring(x["before"], F.greatest(F.length(x["before"]) - NEAR + 1, F.lit(1)), F.lit(NEAR)), F.lit(" "), F.substring(x["after"], 1, NEAR)))
    score = F.lit(base) + F.when(near.rlike(up), F.lit(step)).otherwise(F.lit(0.0)) - F.when(near.rlike(down), F.lit(step)).otherwise(F.lit(0.0))
    return F.least(F.round(score, 2), F.lit(1.0))


def find(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """Add ``to``: the spans of personal data in ``text``, ``(start, rank, end, kind, score)`` by start.

    A null text has none.  Other columns stay as they are, whatever their names; rows that
    repeat are treated alike.
    """
    names = KINDS + EXTRA
    free = unused(docs, "pii")
    guards = _guards(F.col(text))
    found = S.find(docs, text, {k: (PATTERNS[k], guards[k]) for k in names}, free)
    keep, score = ({k: partial(f, k) for k in names} for f in (_keep, _score))
    return found.withColumn(to, S.gathered(names, keep, score, free)).drop(*(f"{free}{k}" for k in names))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, the base spans' SHA-256, and all spans as text.

    Null and empty texts have no span; a text of any length is searched whole; every one of
    several equal rows is given; an empty table gives no rows, and other columns are not read.
    """
    found = find(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["rank"] < len(KINDS))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(S.counted(F.col("pii"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(S.listed(base), 256).alias("base_sha256"),
        S.listed(F.col("pii")).alias("spans"),
        *(S.counted(F.col("pii"), k).alias(f"n_{k}") for k in EXTRA),
        F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
    )
