"""Vector search and embedding-space queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.vectors import token_counts
from ..operators import evaluate, search
from ..storage import table
from . import query

#: Queries are the vectors whose id is divisible by 100, against all vectors.
PAIRS = """pairs AS (
  SELECT q.vec_id AS qid, v.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity
  FROM embeddings q JOIN embeddings v ON true WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, item_id) AS rank FROM pairs
)"""
#: Every vector's neighbours but itself.
NEIGHBOURS = """pairs AS (
  SELECT q.vec_id AS qid, v.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, item_id) AS rank FROM pairs
)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    items = _items(spark, sf_dir)
    return search.block_top_k(items.where(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("qid"), "embedding"), items.select("item_id", "embedding"), k)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("qid", "item_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {PAIRS} SELECT qid, item_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_top(spark, sf_dir, 10))


@query(f"WITH {PAIRS} SELECT qid, item_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10")
def vector_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cells around pivots, where most cells need not be compared."""
    items = _items(spark, sf_dir).select("item_id", "embedding")
    asked = items.where(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("qid"), "embedding")
    return _shown(search.pruned_top_k(asked, items, 10).found)


@query(f"WITH {NEIGHBOURS} SELECT qid, item_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10")
def neighbours_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every vector."""
    items = _items(spark, sf_dir).select("item_id", "embedding")
    return _shown(search.pruned_top_k(items.withColumnRenamed("item_id", "qid"), items, 10, skip_self=True, cell=256).found)


@query(f"WITH {PAIRS} SELECT qid, item_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 100 AND similarity >= 0.4")
def vector_topk_threshold_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.thresholded(_top(spark, sf_dir, DEFAULT.top_k), "intent"))


@query(f"WITH {PAIRS} SELECT qid, item_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 100 AND 1 - similarity >= 0.4")
def vector_topk_threshold_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.thresholded(_top(spark, sf_dir, DEFAULT.top_k), "compat"))


@query(
    f"""WITH {PAIRS}, merged AS (
  SELECT e.label AS question, item_id AS entity_id, max(similarity) AS similarity
  FROM ranked JOIN embeddings e ON e.vec_id = qid WHERE rank <= 20 AND similarity > 0.1 GROUP BY ALL
), best AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, entity_id) AS rank FROM merged)
SELECT question, entity_id, rank, round(similarity, 6) AS similarity FROM best WHERE rank <= 20"""
)
def seed_entities_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label are the entities of one question."""
    found = _top(spark, sf_dir, DEFAULT.seeds)
    labels = _items(spark, sf_dir).select(F.col("item_id").alias("qid"), F.col("label").alias("question"))
    best = search.merged_seeds(found.join(labels, "qid"), least=0.1)
    return best.select("question", "entity_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {NEIGHBOURS}, d AS (SELECT qid, sqrt(greatest(0, 2 - 2 * similarity)) AS d FROM ranked WHERE rank <= 2),
r AS (SELECT qid, min(d) AS r1, max(d) AS r2 FROM d GROUP BY qid HAVING count(*) = 2 AND min(d) > 1e-7)
SELECT CASE WHEN count(*) >= 2 AND avg(ln(r2 / r1)) > 0 THEN round(1 / avg(ln(r2 / r1)), 4) END AS intrinsic_dimension, count(*) AS valid_samples FROM r"""
)
def twonn_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.two_nn(_items(spark, sf_dir).select("item_id", "embedding"))


@query(
    """WITH long AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT i, avg(x) AS m FROM long GROUP BY i),
d AS (SELECT vec_id, 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS d FROM long JOIN centre USING (i) GROUP BY vec_id)
SELECT round(avg(d), 6) AS avg_centroid_distance, round(stddev_pop(d), 6) AS std_centroid_distance,
  round(min(d), 6) AS min_centroid_distance, round(max(d), 6) AS max_centroid_distance FROM d"""
)
def centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.centroid_distances(table(spark, sf_dir, "embeddings"))


@query(
    """WITH long AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE unnest(embedding)::DOUBLE END AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT i, avg(x) AS m FROM long GROUP BY i),
d AS (SELECT vec_id, 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS d FROM long JOIN centre USING (i) GROUP BY vec_id HAVING sum(x * x) > 0)
SELECT round(avg(d), 6) AS avg_centroid_distance, round(stddev_pop(d), 6) AS std_centroid_distance,
  round(min(d), 6) AS min_centroid_distance, round(max(d), 6) AS max_centroid_distance FROM d"""
)
def centroid_distance_of_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector is zero: it counts in the mean and has no distance."""
    zeroed = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 7 == 0, F.lit(0.0).cast("float")).otherwise(x))
    return evaluate.centroid_distances(table(spark, sf_dir, "embeddings").withColumn("embedding", zeroed))


@query("SELECT CASE WHEN count(*) > 100000000 THEN 1.0 END AS hubness, 0::BIGINT AS max_occurrence, 0.0::DOUBLE AS mean_occurrence FROM embeddings")
def hubness_of_too_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With more neighbours asked for than there are vectors, hubness is null."""
    return evaluate.hubness(_items(spark, sf_dir).select("item_id", "embedding"), 100_000_000)


OCCURRENCES = f"""WITH {NEIGHBOURS}, seen AS (SELECT item_id, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY item_id),
occ AS (SELECT vec_id AS item_id, coalesce(n, 0) AS occurrence FROM embeddings LEFT JOIN seen ON item_id = vec_id)"""


@query(
    f"""{OCCURRENCES}, m AS (SELECT avg(occurrence) AS mu, stddev_pop(occurrence) AS sd FROM occ)
SELECT round(CASE WHEN any_value(sd) = 0 THEN 0 ELSE avg(power((occurrence - mu) / sd, 3)) END, 6) AS hubness,
  max(occurrence) AS max_occurrence, round(avg(occurrence), 6) AS mean_occurrence FROM occ, m"""
)
def hubness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.hubness(_items(spark, sf_dir).select("item_id", "embedding"))


@query(f"""{OCCURRENCES} SELECT item_id, occurrence, row_number() OVER (ORDER BY occurrence DESC, item_id DESC) AS place FROM occ WHERE occurrence > 0 QUALIFY place <= 5""")
def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.rank_hubs(evaluate.hubs(_items(spark, sf_dir).select("item_id", "embedding")))
    return found.withColumn("place", F.col("place").cast("long"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(trim(lower(text)), '\s+'), lambda x: x <> '')) AS w FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::UBIGINT % 64)::INTEGER AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM b"""
)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("value", F.round("value", 6))


@query(
    f"""{OCCURRENCES}, m AS (SELECT avg(occurrence) AS mu, stddev_pop(occurrence) AS sd FROM occ),
hub AS (SELECT round(CASE WHEN any_value(sd) = 0 THEN 0 ELSE avg(power((occurrence - mu) / sd, 3)) END, 6) AS hubness_score, max(occurrence) AS max_occurrence FROM occ, m),
d2 AS (SELECT qid, sqrt(greatest(0, 2 - 2 * similarity)) AS d FROM ranked WHERE rank <= 2), r2 AS (SELECT qid, min(d) AS a, max(d) AS b FROM d2 GROUP BY qid HAVING count(*) = 2 AND min(d) > 1e-7),
nn AS (SELECT CASE WHEN count(*) >= 2 AND avg(ln(b / a)) > 0 THEN round(1 / avg(ln(b / a)), 4) END AS intrinsic_dimension FROM r2),
tops AS (SELECT string_agg(item_id::VARCHAR, ',' ORDER BY occurrence DESC, item_id DESC) AS top_hubs FROM (SELECT * FROM occ WHERE occurrence > 0 ORDER BY occurrence DESC, item_id DESC LIMIT 5))
SELECT 'success' AS status, (SELECT count(*) FROM embeddings) AS total_embeddings, (SELECT max(len(embedding))::INTEGER FROM embeddings) AS embedding_dimension, intrinsic_dimension, hubness_score, max_occurrence, top_hubs FROM hub, nn, tops"""
)
def semantic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of an embedding space, its parts as columns."""
    made = evaluate.semantic_report(_items(spark, sf_dir).select("item_id", "embedding"))
    top = F.array_join(F.transform("semantic_interference.top_hubs", lambda x: x["chunk_index"].cast("string")), ",")
    return made.select("status", "total_embeddings", "embedding_dimension", "semantic_complexity.intrinsic_dimension", "semantic_interference.hubness_score", F.col("debug_max_occurrence").alias("max_occurrence"), top.alias("top_hubs"))
