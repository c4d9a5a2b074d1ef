"""Strategies' answers and their scores, over the conversations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import chunks as chunked
from ..functions.vectors import one_hot
from ..operators import evaluate, merge, strategies
from ..operators.graph import extract
from ..providers import RULES
from ..storage import cut, stored, table
from . import query
from .graphs import pagerank_steps
from .texts import CHUNKS, SENT, TOK

#: A question is a user's turn, its expected answer the next turn; the turn's number is in the id.
PAIRS = """pairs AS (SELECT u.conv_id * 1000 + u.turn AS qid, u.text AS question, a.text AS reference, u.conv_id FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND u.text <> '')"""
REFUSAL = DEFAULT.refusal
#: The stand-in prediction: every third question is refused, the others get the reference's first sentence and the question's last.
PREDICTED = f"""{PAIRS}, sent AS (SELECT *, {SENT.format('question')} AS qs, {SENT.format('reference')} AS rs FROM pairs),
predicted AS (SELECT qid, reference, question, CASE WHEN qid % 3 = 0 THEN '{REFUSAL}' ELSE rs[1] || ' ' || qs[-1] END AS prediction FROM sent WHERE len(qs) > 0 AND len(rs) > 0)"""


def _vectors(name: str, source: str) -> str:
    """A CTE with the hashed vectors of ``source``'s texts, as rows."""
    return f"""{name} AS (SELECT key, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS value FROM (SELECT key, (('0x' || substr(md5(w), 1, 8))::UBIGINT % 64)::INTEGER AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT key, unnest({TOK.format('text')}) AS w FROM {source}) GROUP BY ALL))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    user = talk.where("role = 'user' and text <> ''").select("conv_id", "turn", F.col("text").alias("question"))
    reply = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return user.join(reply, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "question", "reference", "conv_id")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import sentences

    rows = pairs(spark, sf_dir).withColumns({"qs": sentences(F.col("question")), "rs": sentences(F.col("reference"))}).where((F.size("qs") > 0) & (F.size("rs") > 0))
    text = F.when(F.col("qid") % 3 == 0, F.lit(REFUSAL)).otherwise(F.concat_ws(" ", F.element_at("rs", 1), F.element_at("qs", -1)))
    return rows.select("qid", "reference", "question", text.alias("prediction"), F.when(F.col("qid") % 5 != 0, F.array("reference", "question")).alias("retrieved"))


def _two_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the predictions, and of answers that repeat the reference."""
    rows = predicted(spark, sf_dir)
    return evaluate.judged(rows).withColumn("method", F.lit("naive")).unionByName(evaluate.judged(rows.withColumn("prediction", F.col("reference"))).withColumn("method", F.lit("graph")))


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


F1 = f"""{PREDICTED}, t AS (SELECT qid, prediction, {TOK.format('prediction')} AS p, {TOK.format('reference')} AS r FROM predicted),
s AS (SELECT qid, prediction, CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: list_contains(r, x)))::DOUBLE / len(p) ELSE 0 END AS precision, CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda x: list_contains(p, x)))::DOUBLE / len(r) ELSE 0 END AS recall FROM t),
f1 AS (SELECT qid, precision, recall, CASE WHEN lower(prediction) LIKE '%cannot answer%' OR precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS semantic_f1 FROM s)"""


@query(f"WITH {F1} SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(semantic_f1, 6) AS semantic_f1 FROM f1")
def semantic_f1_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.token_f1(predicted(spark, sf_dir)), "precision", "recall", "semantic_f1")


@query(f"WITH {F1} SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(semantic_f1, 6) AS semantic_f1 FROM f1")
def semantic_f1_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens matched by vectors that are equal for equal tokens and orthogonal for others."""
    return _round(evaluate.semantic_f1(predicted(spark, sf_dir), replace(RULES, embed_tokens=one_hot)), "precision", "recall", "semantic_f1")


@query(
    f"""WITH {PREDICTED}, t AS (SELECT qid, prediction, {TOK.format('prediction')} AS p, {TOK.format('reference')} AS r FROM predicted),
pt AS (SELECT qid, w, count(*) AS n FROM (SELECT qid, unnest(p) AS w FROM t) GROUP BY ALL), rt AS (SELECT qid, w, count(*) AS n FROM (SELECT qid, unnest(r) AS w FROM t) GROUP BY ALL),
v AS MATERIALIZED (SELECT w, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(w) - length(replace(w, c, '')))::DOUBLE) AS v FROM (SELECT w FROM pt UNION SELECT w FROM rt)),
near AS MATERIALIZED (SELECT pt.qid, pt.w AS pw, pt.n AS pn, rt.w AS rw, rt.n AS rn, CASE WHEN list_sum(a.v) > 0 AND list_sum(b.v) > 0 THEN list_cosine_similarity(a.v, b.v) ELSE 0 END AS c FROM pt JOIN rt USING (qid) JOIN v a ON a.w = pt.w JOIN v b ON b.w = rt.w),
precise AS (SELECT qid, sum(pn * c) / sum(pn) AS precision FROM (SELECT qid, pw, pn, max(c) AS c FROM near GROUP BY ALL) GROUP BY qid), recalled AS (SELECT qid, sum(rn * c) / sum(rn) AS recall FROM (SELECT qid, rw, rn, max(c) AS c FROM near GROUP BY ALL) GROUP BY qid),
s AS (SELECT qid, prediction, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall FROM t LEFT JOIN precise USING (qid) LEFT JOIN recalled USING (qid))
SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN lower(prediction) LIKE '%cannot answer%' OR precision + recall <= 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS semantic_f1 FROM s"""
)
def semantic_f1_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens matched by the letters that they are made of."""
    return _round(evaluate.semantic_f1(predicted(spark, sf_dir)), "precision", "recall", "semantic_f1")


SENTENCES = f"""answered AS (SELECT * FROM predicted WHERE lower(prediction) NOT LIKE '%cannot answer%'),
asent AS (SELECT qid, unnest(s) AS text, generate_subscripts(s, 1) AS pos FROM (SELECT qid, {SENT.format('prediction')} AS s FROM answered)),
akey AS (SELECT qid || ':' || pos AS key, qid, pos, text FROM asent), {_vectors('av', 'akey')}"""
COVERAGE = f"""{PREDICTED}, {SENTENCES}, gkey AS (SELECT qid::VARCHAR AS key, reference AS text FROM answered), {_vectors('gv', 'gkey')},
best AS (SELECT k.qid, k.key, coalesce(sum(a.value * g.value), 0) AS sim FROM akey k LEFT JOIN av a ON a.key = k.key LEFT JOIN gv g ON g.key = k.qid::VARCHAR AND g.bucket = a.bucket GROUP BY ALL),
cov AS (SELECT qid, max(sim) AS coverage FROM best GROUP BY qid),
coverage AS (SELECT p.qid, coalesce(coverage, 0) AS coverage FROM predicted p LEFT JOIN cov USING (qid))"""


@query(f"WITH {COVERAGE} SELECT qid, round(coverage, 6) AS coverage FROM coverage")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.coverage(predicted(spark, sf_dir)), "coverage")


FAITHFUL = f"""{PREDICTED}, {SENTENCES}, tkey AS (SELECT qid || ':r' AS key, qid, reference AS text FROM answered WHERE qid % 5 <> 0 UNION ALL SELECT qid || ':q', qid, question FROM answered WHERE qid % 5 <> 0), {_vectors('tv', 'tkey')},
cross_sim AS (SELECT k.qid, k.key, t.key AS other, coalesce(sum(a.value * v.value), 0) AS sim FROM akey k JOIN tkey t ON t.qid = k.qid LEFT JOIN av a ON a.key = k.key LEFT JOIN tv v ON v.key = t.key AND v.bucket = a.bucket GROUP BY ALL),
best2 AS (SELECT qid, key, max(sim) AS sim FROM cross_sim GROUP BY ALL),
faith AS (SELECT qid, avg((round(sim, 9) >= 0.7)::INTEGER) AS faithfulness_hard, avg(sim) AS faithfulness_soft FROM best2 GROUP BY qid)"""


@query(f"WITH {FAITHFUL} SELECT p.qid, round(faithfulness_hard, 6) AS faithfulness_hard, round(faithfulness_soft, 6) AS faithfulness_soft FROM predicted p LEFT JOIN faith USING (qid)")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.faithfulness(predicted(spark, sf_dir)), "faithfulness_hard", "faithfulness_soft")


JUDGED = "CASE WHEN lower({0}) LIKE '%cannot answer%' OR trim({0}) = '' THEN 'incomplete' WHEN contains(lower({0}), lower(trim({1}))) THEN 'correct' ELSE 'incorrect' END"


@query(f"WITH {PREDICTED} SELECT qid, {JUDGED.format('prediction', 'reference')} AS llm_label FROM predicted")
def judge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.judged(predicted(spark, sf_dir))


SPLIT = f"""{PREDICTED}, {SENTENCES}, both_texts AS (SELECT qid, 'r' AS side, {SENT.format('reference')} AS s FROM answered WHERE qid % 5 <> 0 UNION ALL SELECT qid, 'q', {SENT.format('question')} FROM answered WHERE qid % 5 <> 0),
tkey AS (SELECT qid || side || i AS key, qid, text FROM (SELECT qid, side, unnest(s) AS text, generate_subscripts(s, 1) AS i FROM both_texts)), {_vectors('tv', 'tkey')},
cross_sim AS (SELECT k.qid, k.key, t.key AS other, coalesce(sum(a.value * v.value), 0) AS sim FROM akey k JOIN tkey t ON t.qid = k.qid LEFT JOIN av a ON a.key = k.key LEFT JOIN tv v ON v.key = t.key AND v.bucket = a.bucket GROUP BY ALL),
best2 AS (SELECT qid, key, max(sim) AS sim FROM cross_sim GROUP BY ALL),
faith AS (SELECT qid, avg((round(sim, 9) >= 0.7)::INTEGER) AS faithfulness_hard, avg(sim) AS faithfulness_soft FROM best2 GROUP BY qid)"""


#: Refusals have no score; without retrieval (every fifth id) it is 0.
HELD = "CASE WHEN lower(prediction) LIKE '%cannot answer%' THEN NULL WHEN p.qid % 5 = 0 THEN 0.0 ELSE round({0}, 6) END AS {0}"


@query(f"WITH {SPLIT} SELECT p.qid, {HELD.format('faithfulness_hard')}, {HELD.format('faithfulness_soft')} FROM predicted p LEFT JOIN faith USING (qid)")
def faithfulness_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the sentences of what was retrieved."""
    return _round(evaluate.faithfulness(predicted(spark, sf_dir), split=True), "faithfulness_hard", "faithfulness_soft")


SCORES = f"""{FAITHFUL}, {COVERAGE.split(SENTENCES + ', ')[1]}, {F1.replace(PREDICTED + ', ', '')}, judged AS (SELECT qid, {JUDGED.format('prediction', 'reference')} AS llm_label FROM predicted),
scores AS (SELECT p.qid, semantic_f1, coverage, faithfulness_hard, faithfulness_soft, llm_label FROM predicted p JOIN f1 USING (qid) JOIN coverage USING (qid) LEFT JOIN faith USING (qid) JOIN judged USING (qid))"""
MEANS = ("semantic_f1", "coverage", "faithfulness_hard", "faithfulness_soft")


@query(f"WITH {SCORES} SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in MEANS)}, llm_label FROM scores")
def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of every answered question."""
    return _round(evaluate.all_metrics(predicted(spark, sf_dir)), *MEANS)


@query(
    f"""WITH {SCORES} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in MEANS)}, {', '.join(f"count(*) FILTER (llm_label = '{k}') AS n_{k}" for k in ('correct', 'incorrect', 'incomplete'))},
{', '.join(f"round(100.0::DOUBLE * count(*) FILTER (llm_label = '{k}') / count(*), 2) AS pct_{k}" for k in ('correct', 'incorrect', 'incomplete'))} FROM scores"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(evaluate.all_metrics(predicted(spark, sf_dir)))


@query(
    f"""WITH {PREDICTED}, found AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user' AND turn % 4 = 0)
SELECT p.qid, md5(p.prediction) AS prediction_md5, CASE WHEN f.qid IS NULL THEN 0 ELSE 1 END AS n_retrieved FROM predicted p LEFT JOIN found f USING (qid) WHERE p.qid % 7 <> 0"""
)
def to_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers meet their questions and what was retrieved for them; those with scores (every seventh id) are left out."""
    rows = cut(predicted(spark, sf_dir))
    found = table(spark, sf_dir, "conversations").where("role = 'user' and turn % 4 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.array("text").alias("retrieved"))
    made = evaluate.to_evaluate(rows.select("qid", "reference"), rows.select("qid", "prediction"), found, rows.where("qid % 7 = 0").select("qid"))
    return made.select("qid", F.md5("prediction").alias("prediction_md5"), F.size("retrieved").alias("n_retrieved"))


@query(
    f"""WITH {PREDICTED}, a AS (SELECT qid, {JUDGED.format('prediction', 'reference')} AS l FROM predicted), b AS (SELECT qid, {JUDGED.format('reference', 'reference')} AS l FROM predicted)
SELECT a.qid, a.l AS label_a, b.l AS label_b, a.l = b.l AS same, CASE WHEN a.l = b.l THEN NULL WHEN b.l = 'correct' THEN 'graph' WHEN a.l = 'correct' THEN 'naive' WHEN b.l = 'incomplete' THEN 'graph' ELSE 'naive' END AS winner FROM a JOIN b USING (qid)"""
)
def method_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compared(_two_methods(spark, sf_dir), "naive", "graph")


@query(
    f"""WITH {PREDICTED}, a AS (SELECT qid, {JUDGED.format('prediction', 'reference')} AS l FROM predicted), b AS (SELECT qid, {JUDGED.format('reference', 'reference')} AS l FROM predicted)
SELECT a.l AS label_a, b.l AS label_b, count(*) AS n FROM a JOIN b USING (qid) GROUP BY ALL"""
)
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.comparison(_two_methods(spark, sf_dir), "naive", "graph")


def _best_sentence(source: str) -> str:
    """CTEs with the best sentence of each context in ``source``: most tokens of the question, then the first."""
    return f"""said AS (SELECT qid, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos, question FROM (SELECT qid, question, {SENT.format('context')} AS s FROM {source})),
scored AS (SELECT qid, sentence, pos, len(list_intersect(list_distinct({TOK.format('sentence')}), list_distinct({TOK.format('question')}))) AS n FROM said),
best AS (SELECT qid, arg_max(sentence, (n, -pos)) AS answer FROM scored GROUP BY qid)"""


@query(f"WITH {PAIRS} SELECT qid, 'llm_direct' AS method, '{REFUSAL}' AS answer FROM pairs")
def answer_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.direct(pairs(spark, sf_dir))


#: The questions whose id is divisible by 100 are asked, by ``answer_naive`` all; passages are the chunks of all documents.
ASKED = f"{PAIRS}, asked AS (SELECT * FROM pairs WHERE qid % 100 = 0)"
ALL_ASKED = f"{PAIRS}, asked AS (SELECT * FROM pairs)"
#: PageRank runs so many rounds where it has SQL.
ROUNDS = 12
PLAIN = {"rounds": ROUNDS}


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(pairs(spark, sf_dir).where(F.col("qid") % 100 == 0).select("qid", "question"))


def _all_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(pairs(spark, sf_dir).select("qid", "question"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(chunked(table(spark, sf_dir, "documents")).withColumn("row_id", F.col("doc_id") * 1000 + F.col("chunk_idx")), "chunks")


def _world(chunks: DataFrame) -> strategies.Graph:
    return strategies.graph_of(extract(chunks).drop("source_text"))  # which would be written for each triplet


NAIVE = f"""{ASKED}, {CHUNKS}, ckey AS (SELECT doc_id * 1000 + chunk_idx AS key, text FROM chunks), {_vectors('cv', 'ckey')}, qkey AS (SELECT qid AS key, question AS text FROM asked), {_vectors('qv', 'qkey')},
near AS (SELECT a.qid, c.key, round(coalesce(s.sim, 0), 12) AS similarity FROM asked a CROSS JOIN ckey c LEFT JOIN (SELECT qv.key AS qid, cv.key, sum(qv.value * cv.value) AS sim FROM qv JOIN cv USING (bucket) GROUP BY ALL) s ON s.qid = a.qid AND s.key = c.key),
naive AS (SELECT qid, key // 1000 AS doc_id, key % 1000 AS chunk_idx, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, key) - 1 AS pos FROM near QUALIFY pos < 100)"""


@query(f"WITH {NAIVE} SELECT qid, pos, doc_id, chunk_idx::INTEGER AS chunk_idx, round(similarity, 6) AS similarity FROM naive")
def naive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strategies.naive_passages(_asked(spark, sf_dir), _chunks(spark, sf_dir), DEFAULT.top_k)
    return found.select("qid", F.col("pos").cast("long").alias("pos"), "doc_id", "chunk_idx", F.round("similarity", 6).alias("similarity"))


def _answered(source: str, method: str, asks: str = "asked") -> str:
    """The best sentence of the passages of ``source`` (qid, pos, text) within the budget, or a refusal."""
    return f"""ranked AS (SELECT qid, pos, text, sum(length(text) // 4) OVER (PARTITION BY qid ORDER BY pos) AS run FROM {source}),
ctx AS (SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS context FROM ranked WHERE run <= 8000 GROUP BY qid), rows AS (SELECT qid, question, context FROM asked JOIN ctx USING (qid)), {_best_sentence('rows')}
SELECT a.qid, '{method}' AS method, md5(coalesce(b.answer, '{REFUSAL}')) AS answer_md5 FROM {asks} a LEFT JOIN best b USING (qid)"""


def _hashed(made: DataFrame) -> DataFrame:
    return made.select("qid", "method", F.md5("answer").alias("answer_md5"))


@query(f"WITH {NAIVE.replace(ASKED, ALL_ASKED)}, held AS (SELECT * FROM naive JOIN chunks USING (doc_id, chunk_idx)), {_answered('held', 'naive')}")
def answer_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions, answered from the hundred most similar chunks, as far as the budget goes."""
    asked, chunks = _all_asked(spark, sf_dir), _chunks(spark, sf_dir)
    return _hashed(strategies.answered(asked, strategies.within_budget(strategies.naive_marked(asked, chunks, DEFAULT.top_k), chunks), "naive"))


TRIGRAMS = r"CASE WHEN length({0}) > 2 THEN array_to_string(list_transform(range(1, length({0}) - 1), lambda i: substr(regexp_replace(lower({0}), '\s+', '_', 'g'), i::INTEGER, 3)), ' ') ELSE lower({0}) END"
#: Triplets of the chunks, entity ids, edges by id, and the seeds of each question.
SEEDED = f"""{CHUNKS}, named AS (SELECT doc_id, chunk_idx, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS n FROM chunks),
trip AS (SELECT doc_id, chunk_idx, n[i] AS subject, n[i + 1] AS object FROM (SELECT *, unnest(range(1, len(n))) AS i FROM named WHERE len(n) > 1)),
ent AS (SELECT row_number() OVER (ORDER BY entity) - 1 AS entity_id, entity FROM (SELECT subject AS entity FROM trip UNION SELECT object FROM trip)),
edges AS (SELECT DISTINCT least(a.entity_id, b.entity_id) AS src, greatest(a.entity_id, b.entity_id) AS dst FROM trip JOIN ent a ON a.entity = subject JOIN ent b ON b.entity = object),
sym AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
askn AS (SELECT qid, question, list_distinct(regexp_extract_all(question, '[A-Z][a-z]{{3,}}')) AS n FROM asked),
aske AS (SELECT qid, unnest(CASE WHEN len(n) > 0 THEN n ELSE [question] END) AS entity FROM askn),
tkey1 AS (SELECT DISTINCT entity AS key, {TRIGRAMS.format('entity')} AS text FROM aske), {_vectors('av', 'tkey1')},
tkey2 AS (SELECT entity_id AS key, {TRIGRAMS.format('entity')} AS text FROM ent), {_vectors('ev', 'tkey2')},
esim AS (SELECT av.key AS entity, ev.key AS node, round(sum(av.value * ev.value), 12) AS similarity FROM av JOIN ev USING (bucket) GROUP BY ALL),
etop AS (SELECT * FROM esim QUALIFY row_number() OVER (PARTITION BY entity ORDER BY similarity DESC, node) <= 20),
emax AS (SELECT qid, node, max(similarity) AS similarity FROM aske JOIN etop USING (entity) WHERE similarity > 0.4 GROUP BY ALL),
seed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, node) AS rank FROM emax QUALIFY rank <= 20),
seeds AS (SELECT qid, node, similarity AS weight FROM seed)"""


@query(f"WITH {ASKED}, {SEEDED} SELECT qid, entity, rank, round(similarity, 6) AS similarity FROM seed JOIN ent ON entity_id = node")
def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that start the search for each question."""
    world = _world(_chunks(spark, sf_dir))
    found = strategies.seeds(_asked(spark, sf_dir), world).join(world.names.withColumnRenamed("entity_id", "node"), "node")
    return found.select("qid", "entity", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


PLACED = f"""{SEEDED}, {pagerank_steps(ROUNDS)},
ptop AS (SELECT qid, node FROM x{ROUNDS} WHERE score >= 1e-5 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, node) <= 100),
nodes AS MATERIALIZED (SELECT qid, node FROM ptop UNION SELECT qid, node FROM seeds),
inside AS (SELECT a.qid, e.src, e.dst, greatest(coalesce(s.similarity, 0), coalesce(t.similarity, 0)) AS similarity FROM edges e JOIN nodes a ON a.node = e.src JOIN nodes b ON b.node = e.dst AND b.qid = a.qid LEFT JOIN seed s ON s.qid = a.qid AND s.node = e.src LEFT JOIN seed t ON t.qid = a.qid AND t.node = e.dst),
spelt AS (SELECT qid, a.entity AS subject, b.entity AS object, similarity FROM inside JOIN ent a ON a.entity_id = src JOIN ent b ON b.entity_id = dst),
ways AS (SELECT qid, subject, object, similarity FROM spelt UNION SELECT qid, object, subject, similarity FROM spelt),
held1 AS (SELECT qid, doc_id, chunk_idx, max(similarity) AS similarity FROM ways JOIN trip USING (subject, object) GROUP BY ALL),
sources AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id, chunk_idx) - 1 AS pos FROM held1)"""


@query(f"WITH {ASKED}, {PLACED} SELECT n.qid, entity, round(similarity, 6) AS similarity, rank, rank IS NOT NULL AS is_seed FROM nodes n JOIN ent ON entity_id = n.node LEFT JOIN seed s ON s.qid = n.qid AND s.node = n.node")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strategies.graph_search(_asked(spark, sf_dir), _world(_chunks(spark, sf_dir)), **PLAIN).nodes
    return found.select("qid", "entity", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"), "is_seed")


@query(f"WITH {ASKED}, {PLACED} SELECT qid, subject, 'next_to' AS relation, object, round(similarity, 6) AS similarity FROM spelt")
def graph_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strategies.graph_search(_asked(spark, sf_dir), _world(_chunks(spark, sf_dir)), **PLAIN).triplets
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {ASKED}, {PLACED} SELECT qid, pos, doc_id, chunk_idx, round(1 - 0.01::DOUBLE * pos, 6) AS similarity FROM sources")
def graph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    found = strategies.graph_passages(_asked(spark, sf_dir), _world(chunks), chunks, **PLAIN)
    return found.select("qid", F.col("pos").cast("long").alias("pos"), "doc_id", "chunk_idx", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {ASKED}, {PLACED}, held AS (SELECT * FROM sources JOIN chunks USING (doc_id, chunk_idx)), {_answered('held', 'graph')}")
def answer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered from the chunks that state the triplets around the question's entities."""
    asked, chunks = _asked(spark, sf_dir), _chunks(spark, sf_dir)
    near = strategies.graph_marked(asked, _world(chunks), chunks, **PLAIN)
    return _hashed(strategies.answered(asked, strategies.within_budget(near, chunks), "graph"))


HYBRID = f"""{NAIVE}, {PLACED.replace(CHUNKS + ', ', '')}, each_one AS (SELECT qid, 2 * pos AS pos, doc_id, chunk_idx FROM naive UNION ALL SELECT qid, 2 * pos + 1, doc_id, chunk_idx FROM sources),
held AS (SELECT * FROM each_one JOIN chunks USING (doc_id, chunk_idx) WHERE qid IN (SELECT qid FROM naive) AND qid IN (SELECT qid FROM sources) AND text <> '' QUALIFY row_number() OVER (PARTITION BY qid, doc_id, chunk_idx ORDER BY pos) = 1)"""


@query(f"WITH {HYBRID}, asks AS (SELECT * FROM asked WHERE qid IN (SELECT qid FROM held)), {_answered('held', 'hybrid', 'asks')}")
def answer_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered from both lists, one passage of each in turn."""
    asked, chunks = _asked(spark, sf_dir), _chunks(spark, sf_dir)
    near = strategies.naive_marked(asked, chunks, DEFAULT.top_k)
    return _hashed(strategies.hybrid(asked, near, strategies.graph_marked(asked, _world(chunks), chunks, **PLAIN), chunks=chunks))


@query(f"WITH {ASKED}, {PLACED}, held AS (SELECT * FROM sources JOIN chunks USING (doc_id, chunk_idx)), one AS (WITH {_answered('held', 'iterative')}) SELECT *, 1 AS rounds FROM one WHERE answer_md5 <> md5('{REFUSAL}')")
def answer_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that a round with passages answers (the stand-in answers from any passage, so the first)."""
    asked, chunks = _asked(spark, sf_dir), _chunks(spark, sf_dir)
    world = _world(chunks)
    made, _ = strategies.iterative(asked, lambda q: strategies.graph_marked(q, world, chunks, **PLAIN), chunks=chunks)
    return made.where(F.col("answer") != REFUSAL).select("qid", "method", F.md5("answer").alias("answer_md5"), "rounds")


@query(f"WITH {CHUNKS}, named AS (SELECT regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS n FROM chunks), ent AS (SELECT DISTINCT unnest(n) AS entity FROM named WHERE len(n) > 1), key1 AS (SELECT entity AS key, {TRIGRAMS.format('entity')} AS text FROM ent), {_vectors('v', 'key1')} SELECT key AS entity, bucket, round(value, 6) AS value FROM v")
def entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all entities' names, as the values that are not zero."""
    world = _world(_chunks(spark, sf_dir))
    rows = world.vectors.join(world.names.withColumnRenamed("entity_id", "item_id"), "item_id").select("entity", F.posexplode("embedding").alias("bucket", "value"))
    return rows.where("value <> 0").withColumn("value", F.round("value", 6))


@query(
    f"""WITH {PAIRS}, given AS (SELECT qid, question, reference, CASE WHEN qid % 3 = 0 THEN NULL ELSE reference END AS answer FROM pairs),
rows AS (SELECT qid, question, reference || chr(10) || chr(10) || question AS context FROM given WHERE answer IS NULL AND qid % 2 = 0), {_best_sentence('rows')},
again AS (SELECT qid, answer FROM best WHERE answer <> '' AND NOT contains(lower(answer), 'cannot answer'))
SELECT g.qid, md5(coalesce(g.answer, a.answer)) AS answer_md5 FROM given g LEFT JOIN again a ON a.qid = g.qid"""
)
def retried_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third answer is missing and is made again where there are stored passages, which even ids have."""
    rows = cut(pairs(spark, sf_dir))
    held = rows.select("qid", F.when(F.col("qid") % 3 != 0, F.col("reference")).alias("answer"))
    kept = rows.where("qid % 2 = 0").select("qid", F.array("reference", "question").alias("retrieved"))
    return strategies.retried(rows.select("qid", "question"), held, kept).select("qid", F.md5("answer").alias("answer_md5"))


#: Two ranked lists of a conversation's turns: by number, and by length; the second has no id for every third.
LISTS = """lists AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p1, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) - 1 AS p2 FROM conversations),
rows AS (SELECT conv_id AS qid, 2 * p1 AS pos, turn AS doc_id, 0 AS chunk_idx, text FROM lists
  UNION ALL SELECT conv_id, 2 * p2 + 1, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn END, 0, text FROM lists),
keyed AS (SELECT *, row_number() OVER (PARTITION BY qid, CASE WHEN doc_id IS NULL THEN md5(text) ELSE doc_id || ':' || chunk_idx END ORDER BY pos) AS seen FROM rows WHERE text <> ''),
merged AS (SELECT qid, pos, doc_id, chunk_idx, text FROM keyed WHERE seen = 1)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    rank = lambda *order: F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1
    of = lambda pos, doc_id: turns.select(F.col("conv_id").alias("qid"), pos.alias("pos"), doc_id.alias("doc_id"), F.lit(0).alias("chunk_idx"), "text")
    return merge.interleave(of(rank("turn"), F.col("turn")), of(rank(F.length("text"), "turn"), F.when(F.col("turn") % 3 != 0, F.col("turn"))))


@query(f"WITH {LISTS} SELECT qid, pos, doc_id, chunk_idx, md5(text) AS text_md5 FROM merged")
def hybrid_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("qid", F.col("pos").cast("long").alias("pos"), "doc_id", "chunk_idx", F.md5("text").alias("text_md5"))


@query(f"WITH {LISTS}, r AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY qid ORDER BY pos) AS run FROM merged) SELECT qid, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS context_md5, count(*) AS n_texts FROM r WHERE run <= 8000 GROUP BY qid")
def hybrid_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import contexts

    return contexts(_merged(spark, sf_dir), "qid").select("qid", F.md5("context").alias("context_md5"), F.col("n_texts").cast("long").alias("n_texts"))


@query(
    """WITH held AS (SELECT lang AS qid, doc_id, 0 AS chunk_idx FROM documents WHERE doc_id % 3 = 0), found AS (SELECT lang AS qid, doc_id, 0 AS chunk_idx FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM held UNION ALL SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.qid = f.qid AND h.doc_id = f.doc_id)"""
)
def iterative_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("qid"), "doc_id", F.lit(0).alias("chunk_idx"))
    return merge.add_round(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 2 = 0"))


@query(
    """WITH t AS (SELECT conv_id AS qid, turn AS round, length(text) % 5 = 0 AS sufficient, CASE WHEN length(text) % 7 = 0 THEN '' ELSE 'q' || (length(text) % 3) END AS sub FROM conversations WHERE turn <= 3),
e AS (SELECT *, sufficient OR sub = '' OR EXISTS (SELECT 1 FROM t p WHERE p.qid = t.qid AND p.round < t.round AND p.sub = t.sub) AS ends FROM t),
s AS (SELECT qid, coalesce(min(round) FILTER (ends), max(round)) AS round FROM e GROUP BY qid) SELECT qid, round AS rounds, sufficient FROM s JOIN e USING (qid, round)"""
)
def iterative_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are rounds; the length of a text stands for the verdict and the next question."""
    n = F.length("text")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("round"), (n % 5 == 0).alias("sufficient"), F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("q"), (n % 3).cast("string"))).alias("sub_question"))
    return merge.rounds(turns)


@query(f"WITH {PAIRS}, t AS (SELECT qid, len({TOK.format('question')}) AS n FROM pairs) SELECT CASE WHEN n < 12 THEN 'distributed' WHEN n < 30 THEN 'full_context' ELSE 'query_focused' END AS type, count(*) AS n FROM t GROUP BY 1")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(RULES.classify(F.col("question")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
