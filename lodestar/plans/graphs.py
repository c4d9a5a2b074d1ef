"""Queries over the entity graph of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import chunks as chunked
from ..operators import graph
from ..storage import cut, dealt, table
from . import query
from .texts import CHUNKS

#: All triplets of the star schema; small ones leave out parts and orders.
SMALL = """small AS (
  SELECT 's' || s_suppkey AS subject, 'located_in' AS relation, 'n' || s_nationkey AS object, s_suppkey AS doc_id FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'located_in', 'n' || c_nationkey, c_custkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, n_nationkey FROM nation)"""
TRIPLETS = f"""{SMALL}, triplets AS (
  SELECT * FROM small UNION ALL SELECT DISTINCT 'p' || l_partkey, 'supplied_by', 's' || l_suppkey, l_partkey FROM lineitem)"""
EDGES = f"""{TRIPLETS}, edges AS (SELECT least(subject, object) AS src, greatest(subject, object) AS dst, min(relation) AS relation FROM triplets GROUP BY 1, 2)"""
SMALL_EDGES = f"""{SMALL}, edges AS (SELECT least(subject, object) AS src, greatest(subject, object) AS dst, min(relation) AS relation FROM small GROUP BY 1, 2)"""
BOTH = "sym AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def _name(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def small_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, a, key, relation, b, to: table(spark, sf_dir, name).select(_name(a, key).alias("subject"), F.lit(relation).alias("relation"), _name(b, to).alias("object"), F.col(key).cast("long").alias("doc_id"))
    return of("supplier", "s", "s_suppkey", "located_in", "n", "s_nationkey").unionByName(of("customer", "c", "c_custkey", "located_in", "n", "c_nationkey")).unionByName(of("nation", "n", "n_nationkey", "part_of", "r", "n_regionkey"))


def _stated(spark: SparkSession, sf_dir: str, once: bool) -> DataFrame:
    """All triplets, each part's suppliers ``once`` or as often as there are lines of them."""
    supplied = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    supplied = dealt(supplied, supplied.count(), "l_partkey", "l_suppkey").distinct() if once else supplied
    supplied = supplied.select(_name("p", "l_partkey").alias("subject"), F.lit("supplied_by").alias("relation"), _name("s", "l_suppkey").alias("object"), F.col("l_partkey").alias("doc_id"))
    return small_triplets(spark, sf_dir).unionByName(supplied)


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir, True)


def _joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst`` of the same edges, with repeats: what components need."""
    return _stated(spark, sf_dir, False).select(F.col("subject").alias("src"), F.col("object").alias("dst"))


def _edges(stated: DataFrame) -> DataFrame:
    return stated.groupBy(F.least("subject", "object").alias("src"), F.greatest("subject", "object").alias("dst")).agg(F.min("relation").alias("relation"))


def _vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


@query(f"WITH {TRIPLETS} SELECT subject AS entity FROM triplets UNION SELECT object FROM triplets")
def entities_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities(triplets(spark, sf_dir))


@query(f"WITH {TRIPLETS}, e AS (SELECT subject AS entity FROM triplets UNION SELECT object FROM triplets) SELECT row_number() OVER (ORDER BY entity) - 1 AS entity_id, entity FROM e")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.numbered(graph.entities(triplets(spark, sf_dir)))


@query("SELECT 'p' || l_partkey AS subject, 'supplied_by' AS relation, 's' || l_suppkey AS object, count(*) AS n_sources, count(DISTINCT l_orderkey) AS n_docs FROM lineitem GROUP BY l_partkey, l_suppkey")
def triplet_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line states that its part is supplied by its supplier; the order is the document."""
    stated = table(spark, sf_dir, "lineitem").select(_name("p", "l_partkey").alias("subject"), F.lit("supplied_by").alias("relation"), _name("s", "l_suppkey").alias("object"), F.col("l_orderkey").alias("doc_id"))
    return graph.provenance(stated)


@query(
    """WITH t AS (SELECT 'u' || user_id AS subject, event_type AS relation, 'u' || (user_id * 7 + event_id) % 50 AS object, event_id AS doc_id FROM events)
SELECT least(subject, object) AS a, greatest(subject, object) AS b, arg_max(relation, doc_id) AS relation, max(doc_id) AS doc_id FROM t GROUP BY 1, 2"""
)
def edges_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are entities, events relations between them; the last event of a pair holds."""
    other = F.concat(F.lit("u"), ((F.col("user_id") * 7 + F.col("event_id")) % 50).cast("string"))
    stated = table(spark, sf_dir, "events").select(_name("u", "user_id").alias("subject"), F.col("event_type").alias("relation"), other.alias("object"), F.col("event_id").alias("doc_id"))
    return graph.collapsed(stated, ["doc_id"])


@query(f"WITH {TRIPLETS}, b AS (SELECT doc_id, subject AS entity FROM triplets UNION SELECT doc_id, object FROM triplets) SELECT doc_id, count(*) AS n_entities FROM b GROUP BY doc_id")
def entities_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _stated(spark, sf_dir, False)
    return graph.entities_per_doc(stated, stated.count())


VERTICES = """vertices AS (SELECT 's' || s_suppkey AS node FROM supplier UNION SELECT 'c' || c_custkey FROM customer UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || r_regionkey FROM region UNION SELECT 'p' || p_partkey FROM part)"""


def _all_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no one supplies and regions without nations, too."""
    of = lambda name, prefix, key: table(spark, sf_dir, name).select(_name(prefix, key).alias("node"))
    rows = of("supplier", "s", "s_suppkey").union(of("customer", "c", "c_custkey")).union(of("nation", "n", "n_nationkey"))
    return rows.union(of("region", "r", "r_regionkey")).union(of("part", "p", "p_partkey")).distinct()


@query(
    f"""WITH {EDGES}, {VERTICES}, ends AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), n AS (SELECT count(*) AS n, count(*) FILTER (node NOT IN (SELECT node FROM ends)) AS alone FROM vertices), m AS (SELECT count(*) AS m, count(DISTINCT relation) AS r FROM edges)
SELECT n AS n_nodes, m AS n_edges, r AS n_relations, round(2.0::DOUBLE * m / (n * (n - 1)), 6) AS density, round(2.0::DOUBLE * m / n, 2) AS avg_degree, alone AS n_isolated FROM n, m"""
)
def graph_basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.basic_stats(_all_vertices(spark, sf_dir), _edges(triplets(spark, sf_dir)))


#: Every vertex with an edge reaches a region; a component is named after its smallest vertex.
REACH = f"""{EDGES}, {BOTH}, reach(node, root) AS (SELECT src, src FROM sym WHERE src LIKE 'r%' UNION SELECT dst, root FROM reach JOIN sym ON src = node),
low AS (SELECT root, min(node) AS m FROM reach GROUP BY root), labels AS (SELECT node, min(m) AS component FROM reach JOIN low USING (root) GROUP BY node)"""


@query(f"WITH RECURSIVE {REACH} SELECT node, component FROM labels")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_joins(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {REACH}, sizes AS (SELECT component, count(*) AS n FROM labels GROUP BY component)
SELECT count(*) AS n_components, max(n) AS largest, round(max(n) / sum(n)::DOUBLE, 4) AS largest_ratio, count(*) = 1 AS connected FROM sizes"""
)
def graph_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = graph.components(_joins(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 4).alias("largest_ratio"), (F.count("*") == 1).alias("connected"))


@query(
    f"""WITH {CHUNKS}, named AS (SELECT regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS n FROM chunks), trip AS (SELECT n[i] AS a, n[i + 1] AS b FROM (SELECT n, unnest(range(1, len(n))) AS i FROM named WHERE len(n) > 1)),
vertices AS (SELECT a AS u FROM trip UNION SELECT b FROM trip), pairs AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM trip WHERE a <> b),
sym AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs), k AS (SELECT u, count(*) AS k FROM sym GROUP BY u),
t AS (SELECT x.u, count(*) AS t FROM sym x JOIN sym y ON x.u = y.u AND x.v < y.v JOIN pairs p ON p.a = x.v AND p.b = y.v GROUP BY x.u)
SELECT round(sum(CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END) / count(*), 6) AS avg_clustering, count(*) AS n_nodes FROM vertices LEFT JOIN k USING (u) LEFT JOIN t USING (u)"""
)
def graph_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand next to each other in the documents are joined."""
    stated = cut(graph.extract(chunked(table(spark, sf_dir, "documents"))).select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct())
    return graph.clustering(_vertices(stated), stated)


@query(
    f"""WITH {EDGES}, ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
SELECT node, degree, round(degree::DOUBLE / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d"""
)
def graph_degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(_edges(triplets(spark, sf_dir)))
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality"))


@query(
    f"""WITH RECURSIVE {SMALL_EDGES}, {BOTH}, reach(node, component) AS (
  SELECT src, src FROM sym WHERE src LIKE 'r%' UNION SELECT dst, component FROM reach JOIN sym ON src = node),
low AS (SELECT component, count(*) AS n, min(node) AS first FROM reach GROUP BY component), top AS (SELECT component, n FROM low ORDER BY n DESC, first LIMIT 1),
walk(src, node, d) AS (SELECT node, node, 0 FROM reach WHERE component = (SELECT component FROM top WHERE n <= 5000) UNION SELECT walk.src, sym.dst, d + 1 FROM walk JOIN sym ON sym.src = walk.node WHERE d < 4),
best AS (SELECT src, node, min(d) AS d FROM walk GROUP BY src, node)
SELECT coalesce(round(avg(d), 4), -1) AS avg_path, coalesce(max(d), -1)::BIGINT AS diameter, (SELECT n FROM top) AS n_nodes FROM best WHERE d > 0"""
)
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths among regions, nations, suppliers and customers: where they are.  A region's tree is a component; one of over 5000 nodes gives -1."""
    return graph.path_metrics(cut(_edges(small_triplets(spark, sf_dir))))


def _levels(most: int) -> str:
    """CTEs ``f0`` to ``f{most}``: the pairs (word of 60 sources, node) that are met at each distance, as bits."""
    steps = ["f0 AS MATERIALIZED (SELECT id AS node, id // 60 AS word, 1::BIGINT << (id % 60)::INTEGER AS bits FROM numbers)", "s0 AS (SELECT * FROM f0)"]
    for n in range(1, most + 1):
        steps.append(f"""f{n} AS MATERIALIZED (SELECT x.node, x.word, x.bits & ~coalesce(s.bits, 0) AS bits FROM (SELECT near.b AS node, word, bit_or(bits) AS bits FROM f{n - 1} JOIN near ON near.a = node GROUP BY ALL) x LEFT JOIN s{n - 1} s USING (node, word)),
s{n} AS MATERIALIZED (SELECT node, word, bit_or(bits) AS bits FROM (SELECT * FROM s{n - 1} UNION ALL SELECT * FROM f{n}) GROUP BY ALL)""")
    return ", ".join(steps)


@query(
    f"""WITH RECURSIVE {EDGES}, {BOTH}, reach(node) AS (SELECT 'n1' UNION SELECT dst FROM reach JOIN sym ON src = node),
size AS (SELECT count(*) AS n FROM reach), numbers AS MATERIALIZED (SELECT node AS name, row_number() OVER (ORDER BY node) - 1 AS id FROM reach WHERE (SELECT n FROM size) <= 5000),
near AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM sym JOIN numbers x ON x.name = src JOIN numbers y ON y.name = dst), {_levels(12)},
met AS ({" UNION ALL ".join(f"SELECT {n} AS d, sum(bit_count(bits)) AS n FROM f{n}" for n in range(1, 13))})
SELECT coalesce(round(sum(d * n)::DOUBLE / sum(n), 4), -1) AS avg_path, coalesce(max(d) FILTER (n > 0), -1)::BIGINT AS diameter, (SELECT n FROM size) AS n_nodes FROM met"""
)
def graph_paths_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the whole graph, which shared parts connect; -1 once it has over 5000 nodes."""
    return graph.path_metrics(_joins(spark, sf_dir))


@query(f"WITH {TRIPLETS} SELECT relation, count(*) AS n FROM triplets GROUP BY relation ORDER BY n DESC, relation LIMIT 5")
def relation_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_relations(triplets(spark, sf_dir))


#: A question for each region; its seeds are the two suppliers there with most money.
SEEDS = """rich AS (SELECT n_regionkey AS qid, 's' || s_suppkey AS node, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
seeds AS (SELECT qid, node, CASE r WHEN 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM rich WHERE r <= 2)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    r = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    top = rows.select(F.col("n_regionkey").alias("qid"), _name("s", "s_suppkey").alias("node"), r.alias("r")).where("r <= 2")
    return cut(top.select("qid", "node", F.when(F.col("r") == 1, 0.75).otherwise(0.25).alias("weight")))


def pagerank_steps(rounds: int) -> str:
    """CTEs from ``sym`` (src, dst) and ``seeds`` (qid, node, weight) to ``x{rounds}``: the rounds written one after another."""
    steps = ["deg AS MATERIALIZED (SELECT src, count(*) AS k FROM sym GROUP BY src)", "p AS MATERIALIZED (SELECT qid, node, weight / sum(weight) OVER (PARTITION BY qid) AS share FROM seeds)", "x0 AS (SELECT qid, node, share AS score FROM p)"]
    for n in range(1, rounds + 1):
        steps.append(f"x{n} AS MATERIALIZED (SELECT qid, node, sum(part) AS score FROM (SELECT x.qid, s.dst AS node, 0.85::DOUBLE * x.score / d.k AS part FROM x{n - 1} x JOIN sym s ON s.src = x.node JOIN deg d ON d.src = x.node UNION ALL SELECT qid, node, (1 - 0.85::DOUBLE) * share FROM p) GROUP BY qid, node)")
    return ", ".join(steps)


def _pagerank_sql(rounds: int) -> str:
    return f"{EDGES}, {BOTH}, {SEEDS}, {pagerank_steps(rounds)}"


@query(f"WITH {_pagerank_sql(4)} SELECT qid, node, round(score, 9) AS score FROM x4")
def ppr_fixed_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = graph.pagerank(_edges(triplets(spark, sf_dir)), _seeds(spark, sf_dir), 4, DEFAULT.ppr_alpha)
    return scores.withColumn("score", F.round("score", 9))


@query(
    f"""WITH {_pagerank_sql(4)}, top AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, node) AS r FROM x4 WHERE score >= 1e-5)
SELECT qid, node FROM top WHERE r <= 100 UNION SELECT qid, node FROM seeds"""
)
def ppr_topn_with_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _seeds(spark, sf_dir)
    return graph.ppr_subgraph(graph.pagerank(_edges(triplets(spark, sf_dir)), seeds, 4), seeds)


@query()
def ppr_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same seeds, pushed until no node's residual is over a millionth of its degree."""
    return graph.push_pagerank(_edges(triplets(spark, sf_dir)), _seeds(spark, sf_dir))


BFS = f"""{EDGES}, {BOTH}, {SEEDS}, h1 AS (SELECT DISTINCT qid, dst AS node FROM seeds JOIN sym ON src = node), h2 AS (SELECT DISTINCT qid, dst AS node FROM h1 JOIN sym ON src = node),
within2 AS (SELECT qid, node, min(hops) AS hops FROM (SELECT qid, node, 0 AS hops FROM seeds UNION ALL SELECT qid, node, 1 FROM h1 UNION ALL SELECT qid, node, 2 FROM h2) GROUP BY qid, node)"""


@query(f"WITH {BFS} SELECT qid, node, hops FROM within2")
def bfs_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.within(_edges(triplets(spark, sf_dir)), _seeds(spark, sf_dir))


@query(f"WITH {BFS} SELECT a.qid, e.src, e.dst, e.relation FROM edges e JOIN within2 a ON a.node = e.src AND a.hops <= 1 JOIN within2 b ON b.node = e.dst AND b.hops <= 1 AND b.qid = a.qid")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(_edges(triplets(spark, sf_dir)))
    return graph.induced(edges, graph.within(edges, _seeds(spark, sf_dir), 1)).select("qid", "src", "dst", "relation")


@query(
    """WITH stated AS (SELECT l_suppkey AS qid, l_partkey, l_suppkey, max(l_discount) AS similarity FROM lineitem GROUP BY ALL),
best AS (SELECT qid, l_orderkey AS doc_id, l_linenumber AS chunk_idx, max(similarity) AS similarity FROM stated JOIN lineitem USING (l_partkey, l_suppkey) GROUP BY ALL)
SELECT qid, doc_id, chunk_idx, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id, chunk_idx) AS pos FROM best"""
)
def source_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines are the documents and chunks that state a supply; each supplier's supplies are a question's triplets."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(_name("p", "l_partkey").alias("subject"), F.lit("supplied_by").alias("relation"), _name("s", "l_suppkey").alias("object"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_idx"), "l_suppkey", "l_discount")
    stated = rows.groupBy(F.col("l_suppkey").alias("qid"), "subject", "relation", "object").agg(F.max("l_discount").alias("similarity"))
    found = graph.sources(stated, rows.drop("l_suppkey", "l_discount"))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH {EDGES}, {BOTH}, {SEEDS}, ranked AS (SELECT qid, node, weight AS similarity, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, node) AS rank FROM seeds),
near AS (SELECT DISTINCT qid, dst AS node FROM seeds JOIN sym ON src = node)
SELECT qid, node, similarity, rank, true AS is_seed FROM ranked UNION ALL SELECT qid, node, NULL, NULL, false FROM near WHERE (qid, node) NOT IN (SELECT (qid, node) FROM seeds)"""
)
def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are ranked by weight, the nodes around them are not."""
    seeds = _seeds(spark, sf_dir)
    near = graph.within(_edges(triplets(spark, sf_dir)), seeds, 1).select("qid", "node").join(seeds.select("qid", "node"), ["qid", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), "node")).cast("long")
    top = seeds.select("qid", "node", F.col("weight").alias("similarity"), rank.alias("rank"), F.lit(True).alias("is_seed"))
    return top.unionByName(near.select("qid", "node", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("rank"), F.lit(False).alias("is_seed")))


@query(
    f"""WITH RECURSIVE {SMALL_EDGES}, {BOTH}, reach(node, root) AS (SELECT src, src FROM sym WHERE src LIKE 'r%' UNION SELECT dst, root FROM reach JOIN sym ON src = node),
v AS (SELECT src AS node FROM sym UNION SELECT dst FROM sym), d AS (SELECT src, count(*) AS k FROM sym GROUP BY src), sizes AS (SELECT root, count(*) AS n FROM reach GROUP BY root)
SELECT 'success' AS status, (SELECT count(*) FROM v) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM sizes) AS n_components, (SELECT max(n) FROM sizes) AS largest,
  (SELECT max(k) FROM d) AS max_degree, (SELECT round(sum(k)::DOUBLE / (SELECT count(*) FROM v), 6) FROM d) AS mean_degree, (SELECT arg_max(relation, n) FROM (SELECT relation, count(*) AS n FROM edges GROUP BY relation)) AS top_relation"""
)
def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a graph, where suppliers and customers are, parts of it as columns."""
    from ..operators import evaluate

    edges = cut(_edges(small_triplets(spark, sf_dir)))
    made = evaluate.structure_report(_vertices(edges), edges)
    return made.select(
        "status", "basic_stats.n_nodes", "basic_stats.n_edges", "connectivity.n_components", "connectivity.largest", "centrality.max_degree",
        F.col("centrality.avg_degree").alias("mean_degree"), F.col("relation_metrics.top")[0]["relation"].alias("top_relation"),
    )
