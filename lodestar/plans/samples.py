"""The entity index of the documents, and samples for benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunks
from ..operators import generate, graph, index
from ..storage import cut, table
from . import query
from .texts import CHUNKS, SENT, TOK

#: Triplets by rule from the documents' chunks, and the index over them.
INDEX = f"""{CHUNKS}, names AS (SELECT doc_id, chunk_idx, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS n FROM chunks),
idx AS MATERIALIZED (SELECT DISTINCT doc_id, chunk_idx, unnest(n) AS entity FROM names WHERE len(n) > 1)"""
DRAWN = f"""{INDEX}, drawn AS (SELECT entity, doc_id, chunk_idx, md5('42|' || entity || '|' || doc_id || '|' || chunk_idx) AS draw FROM idx),
names2 AS (SELECT DISTINCT doc_id, entity FROM idx), one AS MATERIALIZED (SELECT entity, doc_id, min(draw) AS draw FROM drawn GROUP BY ALL)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "documents"))


def _triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.valid(graph.extract(_chunks(spark, sf_dir)))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(index.entity_chunks(_triplets(spark, sf_dir)))


@query(f"WITH {CHUNKS}, n AS (SELECT doc_id, chunk_idx, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS n FROM chunks), p AS (SELECT doc_id, chunk_idx, n, unnest(range(1, len(n))) AS i FROM n) SELECT doc_id, chunk_idx, (i - 1)::INTEGER AS pos, n[i] AS subject, 'next_to' AS relation, n[i + 1] AS object FROM p")
def triplet_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triplets(spark, sf_dir).drop("source_text")


@query(f"WITH {INDEX} SELECT entity, doc_id, chunk_idx FROM idx")
def entity_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.entity_chunks(_triplets(spark, sf_dir))


@query(f"WITH {INDEX} SELECT entity, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks FROM idx GROUP BY entity HAVING count(DISTINCT doc_id) >= 2")
def multi_doc_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.multi_doc_entities(index.entity_chunks(_triplets(spark, sf_dir)))


@query(
    f"""WITH {INDEX}, e AS (SELECT entity, count(*) AS c, count(DISTINCT doc_id) AS d FROM idx GROUP BY entity), d AS (SELECT doc_id, count(DISTINCT entity) AS e FROM idx GROUP BY doc_id),
l AS (SELECT count(*) AS n_entities, round(avg(c), 6) AS avg_chunks, max(c) AS max_chunks, round(avg(d), 6) AS avg_docs, max(d) AS max_docs, count(*) FILTER (d > 1) AS n_multi_doc FROM e),
r AS (SELECT count(*) AS n_docs, round(avg(e), 6) AS avg_entities, max(e) AS max_entities FROM d) SELECT * FROM l, r"""
)
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(_index(spark, sf_dir))


@query(f"WITH {INDEX}, n AS (SELECT DISTINCT doc_id, entity FROM idx) SELECT a.doc_id AS d1, b.doc_id AS d2, entity FROM n a JOIN n b USING (entity) WHERE b.doc_id = a.doc_id + 1")
def shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document and the next."""
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d1"), (F.col("doc_id") + 1).alias("d2"))
    return index.shared_entities(_index(spark, sf_dir), pairs)


@query(
    f"""WITH {INDEX}, fit AS (SELECT doc_id, chunk_idx, length(text) AS n_chars FROM chunks WHERE length(text) BETWEEN 100 AND 2000 AND (doc_id, chunk_idx) IN (SELECT (doc_id, chunk_idx) FROM idx))
SELECT * FROM fit ORDER BY md5('42|' || doc_id || '|' || chunk_idx) LIMIT 50"""
)
def single_hop_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.single_hop_samples(index.entity_chunks(_triplets(spark, sf_dir)), _chunks(spark, sf_dir), 50)


STEP_2 = f"""{DRAWN}, near AS (SELECT n.doc_id AS doc_1, o.entity, o.doc_id AS next, o.draw FROM names2 n JOIN one o USING (entity) WHERE o.doc_id <> n.doc_id),
two AS MATERIALIZED (SELECT doc_1, arg_min(entity, (draw, entity, next)) AS bridge_1, arg_min(next, (draw, entity, next)) AS doc_2 FROM near GROUP BY doc_1)"""


@query(f"WITH {STEP_2}, k AS (SELECT *, row_number() OVER (PARTITION BY least(doc_1, doc_2), greatest(doc_1, doc_2) ORDER BY doc_1, bridge_1, doc_2) AS r FROM two) SELECT doc_1, bridge_1, doc_2 FROM k WHERE r = 1")
def multihop_chains_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chains(_index(spark, sf_dir), 2)


@query(
    f"""WITH {STEP_2}, near3 AS (SELECT t.doc_1, t.bridge_1, t.doc_2, o.entity, o.doc_id AS next, o.draw FROM two t JOIN names2 n ON n.doc_id = t.doc_2 JOIN one o USING (entity) WHERE o.doc_id <> t.doc_1 AND o.doc_id <> t.doc_2),
three AS (SELECT doc_1, bridge_1, doc_2, arg_min(entity, (draw, entity, next)) AS bridge_2, arg_min(next, (draw, entity, next)) AS doc_3 FROM near3 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY list_sort([doc_1, doc_2, doc_3]) ORDER BY doc_1, bridge_1, doc_2, bridge_2, doc_3) AS r FROM three) SELECT doc_1, bridge_1, doc_2, bridge_2, doc_3 FROM k WHERE r = 1"""
)
def multihop_chains_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chains(_index(spark, sf_dir), 3)


@query(
    f"""WITH {INDEX}, top AS (SELECT entity, count(DISTINCT doc_id) AS n_docs FROM idx WHERE length(entity) >= 3 GROUP BY entity HAVING count(DISTINCT doc_id) >= 2 ORDER BY n_docs DESC, entity LIMIT 20),
one AS (SELECT entity, n_docs, doc_id, min(chunk_idx) AS chunk_idx FROM idx JOIN top USING (entity) GROUP BY ALL)
SELECT entity, n_docs, doc_id, chunk_idx, row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS place FROM one QUALIFY place <= 5"""
)
def summary_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.summary_clusters(_index(spark, sf_dir), 20).withColumn("place", F.col("place").cast("long"))


SINGLE = r"""drawn1 AS (SELECT doc_id, chunk_idx, text, md5('42|' || doc_id || '|' || chunk_idx) AS draw FROM chunks WHERE length(text) BETWEEN 100 AND 2000 AND (doc_id, chunk_idx) IN (SELECT (doc_id, chunk_idx) FROM idx) ORDER BY draw LIMIT 50),
named AS (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{3,}')[1] AS name, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM drawn1),
single AS (SELECT doc_id, chunk_idx, text, draw, 'What is said about ' || name || '?' AS question, list_filter(s, lambda x: contains(x, name))[1] AS answer FROM named)"""


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_chunks(spark, sf_dir))
    held = index.entity_chunks(graph.valid(graph.extract(rows)))
    drawn = index.single_hop_samples(held, rows, 50).drop("n_chars").join(rows, ["doc_id", "chunk_idx"])
    made = generate.single_hop(drawn).withColumn("draw", index.draw("doc_id", "chunk_idx"))
    return generate.numbered(made, "single_hop", ["draw"])


@query(f"WITH {INDEX}, {SINGLE} SELECT 'single_hop_' || lpad((row_number() OVER (ORDER BY draw))::VARCHAR, 4, '0') AS id, doc_id, chunk_idx, question, md5(answer) AS answer_md5 FROM single")
def generated_single_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir).select("id", "doc_id", "chunk_idx", "question", F.md5("answer").alias("answer_md5"))


@query(
    f"""WITH {STEP_2}, k AS (SELECT *, row_number() OVER (PARTITION BY least(doc_1, doc_2), greatest(doc_1, doc_2) ORDER BY doc_1, bridge_1, doc_2) AS r FROM two)
SELECT doc_1, doc_2, 'Which names lead from document ' || doc_1 || ' to document ' || doc_2 || '?' AS question, bridge_1 || ' lead through documents ' || doc_1 || ', ' || doc_2 AS answer FROM k WHERE r = 1"""
)
def generated_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generate.multi_hop(index.chains(_index(spark, sf_dir), 2), 2)
    return made.select(F.col("doc_ids")[0].alias("doc_1"), F.col("doc_ids")[1].alias("doc_2"), "question", "answer")


#: The best sentence of each sample's text for its question; it answers if it holds the expected one.
ANSWERED = f"""said AS (SELECT draw, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos, question FROM (SELECT single.draw, single.question, named.s FROM single JOIN named USING (draw))),
scored AS (SELECT draw, sentence, pos, len(list_intersect(list_distinct({TOK.format('sentence')}), list_distinct({TOK.format('question')}))) AS n FROM said),
best AS (SELECT draw, arg_max(sentence, (n, -pos)) AS got FROM scored GROUP BY draw),
verdicts AS (SELECT draw, NOT contains(lower(got), 'cannot answer') AND NOT contains(lower(got), 'i don''t know') AND contains(lower(got), lower(trim(answer))) AS answerable, NOT contains(lower(question), lower(trim(answer))) AS leak FROM single JOIN best USING (draw))"""


@query(f"WITH {INDEX}, {SINGLE}, {ANSWERED} SELECT 'single_hop_' || lpad((row_number() OVER (ORDER BY draw))::VARCHAR, 4, '0') AS id, 'single_hop' AS type, answerable, true AS shortcut, leak, answerable AND leak AS overall FROM verdicts")
def validated_single_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the generated questions."""
    return generate.checked(_single(spark, sf_dir).withColumn("facts", F.array("text")))


@query(
    f"""WITH {INDEX}, top AS (SELECT entity, count(DISTINCT doc_id) AS n_docs FROM idx WHERE length(entity) >= 3 GROUP BY entity HAVING count(DISTINCT doc_id) >= 2 ORDER BY n_docs DESC, entity LIMIT 20),
one AS (SELECT entity, doc_id, min(chunk_idx) AS chunk_idx FROM idx JOIN top USING (entity) GROUP BY ALL),
placed AS (SELECT entity, doc_id, chunk_idx, row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS place FROM one QUALIFY place <= 5),
said AS (SELECT entity, doc_id, place, list_filter({SENT.format('text')}, lambda x: contains(x, entity))[1] AS said FROM placed JOIN chunks USING (doc_id, chunk_idx)),
made AS (SELECT entity, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS doc_ids, string_agg(said, ' ' ORDER BY place) AS answer, count(said) AS n FROM said GROUP BY entity)
SELECT entity, doc_ids, 'What do the documents say about ' || entity || '?' AS question, md5(answer) AS answer_md5 FROM made WHERE n > 1"""
)
def generated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_chunks(spark, sf_dir))
    held = cut(index.entity_chunks(graph.valid(graph.extract(rows))))
    made = generate.summary(index.summary_clusters(held, 20), rows)
    return made.select("entity", F.array_join("doc_ids", ",").alias("doc_ids"), "question", F.md5("answer").alias("answer_md5"))


@query(
    f"""WITH {STEP_2}, k AS (SELECT *, row_number() OVER (PARTITION BY least(doc_1, doc_2), greatest(doc_1, doc_2) ORDER BY doc_1, bridge_1, doc_2) AS r FROM two),
pool AS (SELECT doc_1, doc_2, bridge_1 || ' lead through documents ' || doc_1 || ', ' || doc_2 AS answer, md5(doc_1 || '|' || doc_2) AS draw FROM k WHERE r = 1),
clean AS (SELECT * FROM pool p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id IN (p.doc_1, p.doc_2) AND contains(lower(d.text), lower(p.answer))) AND doc_1 % 3 <> 0)
SELECT 'multi_hop_2_' || lpad((row_number() OVER (ORDER BY draw) - 1)::VARCHAR, 4, '0') AS id, doc_1, doc_2, answer FROM clean ORDER BY draw LIMIT 25"""
)
def validated_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains in the order of their draw until 25 questions pass; those that start at every third document count as failed."""
    pool = generate.multi_hop(index.chains(_index(spark, sf_dir), 2), 2).withColumn("draw", F.md5(F.array_join("doc_ids", "|")))
    facts = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = generate.until(pool, 25, lambda tried: generate.without_shortcut(tried, facts).where(F.col("doc_ids")[0] % 3 != 0), ["draw"], batch=30)
    return generate.numbered(made, "multi_hop_2", ["draw"], 0).select("id", F.col("doc_ids")[0].alias("doc_1"), F.col("doc_ids")[1].alias("doc_2"), "answer")


@query(
    f"""WITH {CHUNKS}, names AS (SELECT doc_id, chunk_idx, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS n FROM chunks),
trip AS (SELECT DISTINCT doc_id, chunk_idx, n[i] AS subject, n[i + 1] AS object FROM (SELECT *, unnest(range(1, len(n))) AS i FROM names WHERE len(n) > 1))
SELECT doc_id, count(*) AS n_triplets, md5(string_agg(chunk_idx || ' ' || subject || ' next_to ' || object, ';' ORDER BY chunk_idx, subject, object)) AS triplets_md5 FROM trip GROUP BY doc_id"""
)
def triplets_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document states, gathered again from the statements."""
    from ..sources.readers import regrouped

    line = lambda x: F.concat_ws(" ", x["chunk_idx"].cast("string"), x["subject"], x["relation"], x["object"])
    made = regrouped(_triplets(spark, sf_dir))
    return made.select("doc_id", F.size("triplets").cast("long").alias("n_triplets"), F.md5(F.array_join(F.transform("triplets", line), ";")).alias("triplets_md5"))
