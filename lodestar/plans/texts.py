"""Chunks, budgets, sentences, prompts and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing, prompts
from ..functions import text as T
from ..operators import ends, search
from ..storage import table
from . import query

CHUNKS = r"""tok AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS t FROM documents),
starts AS (SELECT doc_id, t, unnest(range(0, len(t), 412)) AS s FROM tok WHERE len(t) > 0),
chunks AS (SELECT doc_id, (s // 412)::INTEGER AS chunk_idx, array_to_string(t[s + 1 : s + 512], ' ') AS text FROM starts)"""
SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
TOK = r"list_filter(string_split_regex(trim(lower({0})), '\s+'), lambda x: x <> '')"
#: Documents of one language are one question's passages, in order of their ids.
BUDGET = """ranked AS (SELECT lang, doc_id, text, sum(length(text) // 4) OVER (PARTITION BY lang ORDER BY doc_id) AS running_tokens FROM documents),
kept AS (SELECT * FROM ranked WHERE running_tokens <= 8000)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_idx, md5(text) AS text_md5 FROM chunks")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(_docs(spark, sf_dir)).select("doc_id", "chunk_idx", F.md5("text").alias("text_md5"))


@query(f"WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_chunks, sum(ceil(n / 30.0))::BIGINT AS n_batches, max(n) AS max_chunks FROM n")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.chunks(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"), F.sum(F.ceil(F.col("n") / 30)).alias("n_batches"), F.max("n").alias("max_chunks"))


@query("SELECT doc_id, coalesce(length(text) // 4, 0) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {BUDGET} SELECT lang, doc_id, running_tokens::BIGINT AS running_tokens FROM kept")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.token_budget(_docs(spark, sf_dir), "lang", pos="doc_id", wide=True).select("lang", "doc_id", "running_tokens")


@query(f"WITH {BUDGET} SELECT lang, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS context_md5, count(*) AS n_texts FROM kept GROUP BY lang")
def context_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = search.contexts(_docs(spark, sf_dir), "lang", pos="doc_id", wide=True)
    return made.select("lang", F.md5("context").alias("context_md5"), F.col("n_texts").cast("long").alias("n_texts"))


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
x AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM s)
SELECT doc_id, pos::INTEGER AS pos, md5(sentence) AS sentence_md5 FROM x"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"))


@query(
    """WITH raw AS (SELECT doc_id // 2 AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN text END AS content, doc_id AS pos FROM documents),
kept AS (SELECT id AS doc_id, coalesce(text, content) AS text, pos FROM raw WHERE coalesce(text, content) <> '')
SELECT doc_id, md5(arg_max(text, pos)) AS text_md5 FROM kept GROUP BY doc_id"""
)
def corpus_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records share an id, and the text has one name or another."""
    third = F.col("doc_id") % 3 == 0
    none = F.lit(None).cast("string")
    raw = _docs(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 2).cast("long").alias("id"), F.lit(None).cast("long").alias("doc_id"), none.alias("title"), none.alias("context"),
        F.when(~third, F.col("text")).alias("text"), F.when(third, F.col("text")).alias("content"), F.col("doc_id").alias("pos"),
    )
    return T.corpus(raw).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL AND text <> '' AND role = 'user'")
def question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are the users' turns; id 0 is an id like any other."""
    return table(spark, sf_dir, "conversations").where("conv_id is not null and text <> '' and role = 'user'").select("conv_id", "turn")


@query(
    """SELECT conv_id, turn, md5('Answer.' || chr(10) || 'Context: ' || substr(text, 1, 500) || chr(10) || 'Question: ' || text) AS user_md5 FROM conversations WHERE role = 'user' AND text IS NOT NULL"""
)
def prompt_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    made = prompts.grounded(F.col("text"), F.substring("text", 1, prompts.CHAIN_CHARS))
    return rows.select("conv_id", "turn", F.md5(made[1]["content"]).alias("user_md5"))


@query(
    f"""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), made AS (
SELECT conv_id, turn, 'entities' AS builder, 'Extract.' || chr(10) || 'Question: ' || text AS p FROM u
UNION ALL SELECT conv_id, turn, 'triplets', 'Extract the facts.' || chr(10) || 'Text: ' || text FROM u
UNION ALL SELECT conv_id, turn, 'direct', 'Answer.' || chr(10) || 'Question: ' || text FROM u
UNION ALL SELECT conv_id, turn, 'sufficient', 'Judge.' || chr(10) || 'Question: ' || text || chr(10) || 'Answer: ' || role || chr(10) || 'Context: ' || substr(repeat(text || '|', 40), 1, 2000) FROM (SELECT u.*, c.role FROM u JOIN conversations c USING (conv_id, turn))
UNION ALL SELECT conv_id, turn, 'label', 'Compare.' || chr(10) || 'Question: ' || text || chr(10) || 'Expected: ' || substr(text, 1, 9) || chr(10) || 'Answer: ' || substr(text, 3, 9) FROM u
UNION ALL SELECT conv_id, turn, 'single_hop', 'Write.' || chr(10) || 'Document: ' || text FROM u
UNION ALL SELECT conv_id, turn, 'summary', 'Write.' || chr(10) || 'Entity: ' || substr(text, 1, 5) || chr(10) || 'Documents: [1] ' || substr(text, 1, 800) || chr(10) || '[2] ' || substr(repeat(text, 9), 1, 800) FROM u
UNION ALL SELECT conv_id, turn, 'multi_hop', 'Write.' || chr(10) || 'Hops: 2' || chr(10) || 'Bridges: x, y' || chr(10) || 'Documents: [1] ' || substr(text, 1, 500) || chr(10) || '[2] ' || substr(repeat(text, 9), 1, 500) || chr(10) || '[3] z' FROM u
UNION ALL SELECT conv_id, turn, 'two_hop', 'Write.' || chr(10) || 'Hops: 1' || chr(10) || 'Bridges: x' || chr(10) || 'Documents: [1] ' || substr(text, 1, 500) || chr(10) || '[2] z' FROM u)
SELECT conv_id, turn, builder, md5(p) AS user_md5 FROM made"""
)
def prompt_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every builder of messages but the one above hands to a model, from each turn."""
    t = F.col("text")
    long = lambda n, sep="": F.repeat(F.concat(t, F.lit(sep)), n)
    made = {
        "entities": prompts.entities(t), "triplets": prompts.triplets(t), "direct": prompts.direct(t), "sufficient": prompts.sufficient(t, F.col("role"), long(40, "|")),
        "label": prompts.label(t, F.substring(t, 1, 9), F.substring(t, 3, 9)), "single_hop": prompts.single_hop(t), "summary": prompts.summary(F.substring(t, 1, 5), F.array(t, long(9))),
        "multi_hop": prompts.multi_hop(F.array(t, long(9), F.lit("z")), F.array(F.lit("x"), F.lit("y"))), "two_hop": prompts.two_hop(t, F.lit("z"), F.lit("x")),
    }
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("builder"), F.md5(m[1]["content"]).alias("user_md5")) for k, m in made.items())))
    return rows.select("conv_id", "turn", each.alias("x")).select("conv_id", "turn", "x.*")


#: A model's output made from an event: a list of lists, fenced for every third, broken for every seventh.
REPLY = """'[["' || event_type || '", "by", "u' || user_id || '"], ["' || event_type || '", "at"], ["", "by", "x"]' || CASE WHEN event_id % 7 = 0 THEN '' ELSE ']' END"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.concat(F.lit('[["'), "event_type", F.lit('", "by", "u'), F.col("user_id").cast("string"), F.lit('"], ["'), "event_type", F.lit('", "at"], ["", "by", "x"]'), F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.lit("]")))
    content = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), inner, F.lit("\n```"))).otherwise(inner)
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", content.alias("content"))


@query(
    """SELECT event_id, event_type AS subject, 'by' AS relation, 'u' || user_id AS object FROM events WHERE event_id % 7 <> 0
UNION ALL SELECT event_id, '', 'by', 'x' FROM events WHERE event_id % 7 <> 0"""
)
def triplet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir).select("event_id", F.explode(parsing.triplets(F.col("content"))).alias("t"))
    return rows.select("event_id", F.col("t")[0].alias("subject"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("object"))


@query("SELECT event_id, event_type AS subject, 'by' AS relation, 'u' || user_id AS object FROM events WHERE event_id % 7 <> 0 AND trim(event_type) <> ''")
def triplet_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import valid

    return valid(triplet_parse(spark, sf_dir))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' ELSE 'incomplete' END AS label, event_id % 4 = 0 AS says_correct FROM events"""
)
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    content = F.when(k == 0, F.lit('```json\n{"label": "correct"}\n```')).when(k == 1, F.lit('{"label": "incorrect", "reason": "x"}')).when(k == 2, F.lit('{"label": "maybe"}')).otherwise(F.lit("no json"))
    rows = table(spark, sf_dir, "events").select("event_id", content.alias("content"))
    return rows.select("event_id", parsing.judge_label(F.col("content")).alias("label"), parsing.says_correct(F.col("content")).alias("says_correct"))


@query("SELECT event_id, event_id % 3 = 0 AS sufficient, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'q' || user_id END AS sub_question FROM events")
def iterative_evaluation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    good = F.concat(F.lit('{"sufficient": '), F.when(k == 0, F.lit("true")).otherwise(F.lit("false")), F.lit(', "reason": "r", "sub_question": "q'), F.col("user_id").cast("string"), F.lit('"}'))
    rows = table(spark, sf_dir, "events").select("event_id", parsing.evaluation(F.when(k == 2, F.lit("{broken")).otherwise(good)).alias("e"))
    return rows.select("event_id", "e.sufficient", "e.sub_question")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'distributed' WHEN 1 THEN 'full_context' WHEN 2 THEN 'distributed' ELSE 'query_focused' END AS type FROM events"""
)
def question_type_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    content = F.when(k == 0, F.lit(" Distributed ")).when(k == 1, F.lit("it is full_context.")).when(k == 2, F.lit("full_context or distributed")).when(k == 3, F.lit("query_focused")).otherwise(F.lit("unsure"))
    return table(spark, sf_dir, "events").select("event_id", parsing.question_type(content).alias("type"))


@query(
    """WITH k AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type || '|||by' ELSE event_type || '|||by|||u' || user_id END AS key FROM events),
p AS (SELECT event_id, string_split(key, '|||') AS p FROM k)
SELECT p[1] AS subject, p[2] AS relation, p[3] AS object, count(*) AS n_sources, min(event_id) AS first_doc FROM p WHERE len(p) = 3 GROUP BY ALL"""
)
def triplet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a stored map, split on triple bars; keys of another number of parts are dropped."""
    from ..sources.readers import split_keys

    key = F.when(F.col("event_id") % 5 == 0, F.concat("event_type", F.lit("|||by"))).otherwise(F.concat("event_type", F.lit("|||by|||u"), F.col("user_id").cast("string")))
    rows = split_keys(table(spark, sf_dir, "events").select(key.alias("key"), "event_id"))
    return rows.groupBy("subject", "relation", "object").agg(F.count("*").alias("n_sources"), F.min("event_id").alias("first_doc"))


@query(
    """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '' ELSE text END AS rag_answer, CASE WHEN turn % 4 = 1 THEN 'I cannot answer this.' END AS llm_answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, arg_max(md5(coalesce(nullif(rag_answer, ''), nullif(llm_answer, ''), '')), turn) AS answer_md5 FROM a GROUP BY conv_id"""
)
def answers_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer column that is not empty; the last row of an id holds."""
    from ..sources.readers import first_answer

    odd = F.col("turn") % 4 == 1
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.when(odd, F.lit("")).otherwise(F.col("text")).alias("rag_answer"), F.when(odd, F.lit("I cannot answer this.")).alias("llm_answer"))
    return rows.select("conv_id", "turn", F.md5(first_answer("rag_answer", "llm_answer")).alias("m")).groupBy("conv_id").agg(F.max_by("m", "turn").alias("answer_md5"))


@query("SELECT conv_id, turn, text IS NULL OR text = '' OR lower(text) LIKE '%cannot answer%' AS refusal FROM conversations")
def refusal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"))


@query("SELECT doc_id, source || '_' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') AS query_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", "source", n.alias("n")).select("doc_id", T.query_id(F.col("source"), F.col("n")).alias("query_id"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 0 ELSE 2 END AS n_triplets FROM events")
def extraction_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken replies are asked for again; the second attempt mends those with odd ids."""
    from ..operators import graph

    replies = _replies(spark, sf_dir).select("event_id", "content")
    mended = F.when(F.col("event_id") % 2 == 1, F.concat(F.regexp_replace("content", "```(json)?", ""), F.lit("]"))).otherwise(F.col("content"))
    made = graph.retried(graph.attempted(replies), graph.attempted(replies.withColumn("content", mended)), "event_id")
    return made.select("event_id", "status", F.size("triplets").alias("n_triplets"))


#: The words of all documents, and what the corpus tells of them.
LEARNED = r"""tok AS (SELECT doc_id, t, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS t FROM documents)),
core AS (SELECT CASE WHEN length(w) <= 64 THEN regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}.]+$', '') END AS core, i > 1 AND right(t[i - 1], 1) NOT IN ('.', '!', '?', ':') AS inside FROM tok),
counts AS (SELECT lower(rtrim(core, '.')) AS word, count(*) FILTER (core LIKE '%.') AS n_ended, count(*) FILTER (core NOT LIKE '%.') AS n_open,
count(*) FILTER (regexp_matches(core, '^\p{Ll}')) AS n_small, count(*) FILTER (inside AND regexp_matches(core, '^\p{Lu}')) AS n_large FROM core WHERE regexp_matches(core, '\p{L}') GROUP BY 1),
p AS (SELECT sum(n_ended)::DOUBLE / sum(n_ended + n_open) AS p FROM counts),
parts AS (SELECT *, length(replace(word, '.', ''))::DOUBLE AS size, -2 * (n_ended * ln(p) + n_open * ln(1 - p) - n_ended * ln(0.99) - n_open * ln(0.01)) AS ratio FROM counts, p),
short AS (SELECT word, n_ended, n_open, ratio * exp(-size) * (length(word) - size + 1) * pow(size, -n_open::DOUBLE) AS score FROM parts)"""


@query(f"WITH {LEARNED} SELECT word, n_ended, n_open, score FROM short WHERE score >= 0.3")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that come with a full stop much more often than chance tells."""
    return ends.learn(_docs(spark, sf_dir)).abbreviations


@query(
    rf"""WITH {LEARNED},
pieces AS (SELECT doc_id, p, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL)),
words AS (SELECT doc_id, i, piece, list_filter(string_split_regex(trim(piece), '\s+'), lambda x: x <> '')[-1] AS a, list_filter(string_split_regex(trim(p[i + 1]), '\s+'), lambda x: x <> '')[1] AS b FROM pieces),
bare AS (SELECT doc_id, i, piece, a, CASE WHEN length(a) <= 64 THEN regexp_replace(regexp_replace(a, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.]+$', '') END AS ca, CASE WHEN length(b) <= 64 THEN regexp_replace(regexp_replace(b, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.]+$', '') END AS cb FROM words),
marked AS (SELECT doc_id, i, piece, a LIKE '%.' AND coalesce(lower(rtrim(ca, '.')) IN (SELECT word FROM short WHERE score >= 0.3), false)
AND NOT (coalesce(regexp_matches(cb, '^\p{{Lu}}'), false) AND coalesce(lower(rtrim(cb, '.')) IN (SELECT word FROM counts WHERE n_small > n_large), false)) AS goes_on FROM bare),
placed AS (SELECT doc_id, i, piece, coalesce(sum((NOT coalesce(goes_on, false))::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM marked),
joined AS (SELECT doc_id, s, trim(string_agg(piece, '' ORDER BY i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence FROM placed GROUP BY doc_id, s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS pos, md5(sentence) AS sentence_md5 FROM joined WHERE sentence <> ''"""
)
def sentence_split_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents, not ended by the full stops of abbreviations that they teach."""
    docs = _docs(spark, sf_dir)
    rows = ends.with_sentences(docs, ends.learn(docs)).select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))
    return rows.select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"))
