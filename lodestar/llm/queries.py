"""The queries of this subpackage: name to function of (spark, sf_dir)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, decontaminate, importance, language, media, packing, pii, quality, secrets, simhash, suffixes, toxicity, urls
from .common import cut, fold, spread_join, stored, table


def tokenizer() -> str:
    """The tokenizer file that the packing query is to use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


#: op1_urls: host rules by length, else the pattern rules, both written out.
OP1_SQL = """
WITH split AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), hosts AS (
  SELECT page_id, url, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM split
), parts AS (
  SELECT page_id, url,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM hosts
), rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, r_host || r_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS rank
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN regexp_matches(lower(p.url),
    '://([^/?#]*\\.)?(spam-farm|cheap-pills)\\.|://([^/?#]*[.-])?(casino|free-money|replica-watches|payday-loans|adult|xxx)[.-]|://([^/?#]*\\.)?doubleclick\\.net([:/?#]|$)|[?&;](phpsessid|jsessionid)=')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.rank = 1
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of copies among pictures that are made from the pages (the tables have no images)."""
    found = media.copies(media.articles(table(spark, sf_dir, "pages")), media.picture, ("number", "article"))
    return found.withColumnRenamed("id", "page_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold() != 0))
    found = language.label(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold() != 0).select("doc_id", F.col("toxic").alias("label")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each leak: ``doc_id, item_id`` and how much of the item the tiles cover."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "covered_tokens", "item_tokens", F.size("tiles").alias("n_tiles"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures and verdicts, and how many words stand in lines that the host repeats."""
    found = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", *quality.FIGURES, "removed_words", "base_failed", "kept")


#: op11_quality: as the operator, but lines and windows are compared themselves, not their hashes.
OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, source FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
windows AS (SELECT id, i, list_aggregate(words[i : i + 7], 'string_agg', ' ') AS w FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM worded)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT id, count(DISTINCT word) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS word FROM twice) GROUP BY id),
lines AS (SELECT id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
filled AS (SELECT *, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
doubled AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM filled GROUP BY id),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM docs GROUP BY source),
often AS (SELECT f.source, plain FROM (SELECT source, plain, count(DISTINCT text) AS n FROM filled GROUP BY source, plain) f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 10 AND f.n > h.n * 0.001::DOUBLE),
gone AS (SELECT id, sum(len(string_split(f.plain, ' '))) AS n FROM filled f JOIN often o ON f.plain = o.plain AND f.source IS NOT DISTINCT FROM o.source GROUP BY id),
made AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS removed_words
  FROM worded LEFT JOIN doubled d USING (id) LEFT JOIN repeated r USING (id) LEFT JOIN gone g USING (id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM made)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept FROM failed
"""


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes as text, and errors by label; a label may be that of most rows, so hot ones are sent out."""
    made, books = codebooks.compress(table(spark, sf_dir, "embeddings"), carry=("label",))
    said = hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    keys = {"none": F.col("label").isNull(), "of": F.coalesce("label", F.lit(0))}
    rows = stored(made.select("vec_id", code.alias("code"), "error", *(c.alias(k) for k, c in keys.items())), "codes")
    sums = cut(rows.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    return spread_join(rows, sums, list(keys)).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))


def _op13_sql(parts: int = codebooks.PARTS, entries: int = codebooks.ENTRIES, width: int = 16, rounds: int = codebooks.ROUNDS) -> str:
    """The rounds written one after another; ``width`` is that of a part of the table's vectors."""
    vector, key = f"DOUBLE[{width}]", "ORDER BY vec_id, v"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER ({key}) AS id, vec_id, label, v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0))",
        f"pieces AS MATERIALIZED (SELECT id, p, v[p * {width} + 1 : (p + 1) * {width}]::{vector} AS x FROM kept, range({parts}) r(p))",
        f"book0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS c FROM pieces WHERE id <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT id, p, min({{'d': round(pow(array_distance(x, c), 2))::BIGINT, 'e': e}}) AS m FROM pieces JOIN book{r} USING (p) GROUP BY id, p)")
        if r < rounds:
            steps.append(f"sum{r} AS (SELECT p, e, i, floor(sum(v) / count(*)) AS v FROM (SELECT p, m.e AS e, unnest(range({width})) AS i, unnest(x::DOUBLE[]) AS v FROM near{r} JOIN pieces USING (id, p)) GROUP BY p, e, i)")
            steps.append(f"mean{r} AS (SELECT p, e, list(v ORDER BY i)::{vector} AS c FROM sum{r} GROUP BY p, e)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))")
    return f"""
WITH {", ".join(steps)},
said AS (SELECT sha256(string_agg(v::BIGINT, ',' ORDER BY p, e, i)) AS s FROM (SELECT p, e, unnest(range({width})) AS i, unnest(c::DOUBLE[]) AS v FROM book{rounds})),
codes AS (SELECT vec_id, label, string_agg(lpad(lower(hex(m.e)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} JOIN kept USING (id) GROUP BY id, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT s FROM said) AS codebooks_sha256 FROM codes
"""


#: op10_secrets: RE2 has no possessive quantifiers, and its (?i) also folds two letters beyond A-Z.
def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
_RE2 = {
    **{kind: pattern.replace("}+", "}") for kind, (pattern, _, _) in secrets.RULES.items()},
    "assign": rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
}


def _op10_sql() -> str:
    quoted = {kind: "'" + pattern.replace("'", "''") + "'" for kind, pattern in _RE2.items()}
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gs FROM documents WHERE regexp_matches(text, {p})"
        for rank, (kind, p) in enumerate(quoted.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    listed = "string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, rank)"
    return f"""
WITH found AS ({found}),
each AS (SELECT doc_id, kind, rank, unnest(ms) AS m, unnest(gs[1 : len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM found),
placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m) AS start FROM each),
kept AS (SELECT * FROM placed WHERE kind <> 'assign' OR length(regexp_extract(m, {quoted['assign']}, 2)) >= 12),
made AS (SELECT doc_id, {counts}, {listed} FILTER (rank < {len(secrets.BASE)}) AS base, {listed} AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN made m ON m.doc_id = d.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": op1_urls,
    "op2_media": op2_media,
    "op3_language": op3_language,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_suffixes": op7_suffixes,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
    "op11_quality": op11_quality,
    "op12_resampling": op12_resampling,
    "op13_codes": op13_codes,
}
ORACLES: dict[str, str] = {"op1_urls": OP1_SQL, "op10_secrets": _op10_sql(), "op11_quality": OP11_SQL, "op13_codes": _op13_sql()}
