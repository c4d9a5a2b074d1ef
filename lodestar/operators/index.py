"""The entity index, and samples for benchmark questions drawn from it.

Draws are by the smallest MD5 of a seed and the keys, so they don't depend on how rows are
dealt.  Nothing pairs all documents of an entity: whoever needs another document of an
entity looks at the few that come first in the entity's own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..storage import cut, dealt, looked_up, small


def entity_chunks(triplets: DataFrame) -> DataFrame:
    """``entity, doc_id, chunk_idx``: each chunk that names an entity, once."""
    kept = triplets.where("doc_id is not null and source_text <> ''")
    both = kept.select(F.col("subject").alias("entity"), "doc_id", "chunk_idx").union(kept.select("object", "doc_id", "chunk_idx"))
    return both.distinct()


def multi_doc_entities(index: DataFrame, least: int = 2) -> DataFrame:
    return index.groupBy("entity").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks")).where(F.col("n_docs") >= least)


def statistics(index: DataFrame) -> DataFrame:
    """One row: entities, documents, chunks and their means and maxima."""
    by_entity = index.groupBy("entity").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))
    by_doc = index.groupBy("doc_id").agg(F.countDistinct("entity").alias("entities"))
    left = by_entity.agg(F.count("*").alias("n_entities"), F.round(F.avg("chunks"), 6).alias("avg_chunks"), F.max("chunks").alias("max_chunks"), F.round(F.avg("docs"), 6).alias("avg_docs"), F.max("docs").alias("max_docs"), F.count_if(F.col("docs") > 1).alias("n_multi_doc"))
    right = by_doc.agg(F.count("*").alias("n_docs"), F.round(F.avg("entities"), 6).alias("avg_entities"), F.max("entities").alias("max_entities"))
    return left.crossJoin(right)


def shared_entities(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """``d1, d2, entity`` for stated pairs of documents."""
    names = index.select("doc_id", "entity").distinct()
    left = pairs.join(names.withColumnRenamed("doc_id", "d1"), "d1")
    return left.join(names.withColumnRenamed("doc_id", "d2"), ["d2", "entity"]).select("d1", "d2", "entity")


def draw(*keys: str, config: Config = DEFAULT) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(config.sample_seed)), *(F.col(k).cast("string") for k in keys)))


def single_hop_samples(index: DataFrame, chunks: DataFrame, n: int, least: int = 100, most: int = 2000, config: Config = DEFAULT) -> DataFrame:
    """``n`` chunks with entities and a length within bounds, by draw."""
    named = index.select("doc_id", "chunk_idx").distinct()
    fit = chunks.where(F.length("text").between(least, most)).join(named, ["doc_id", "chunk_idx"], "left_semi")
    return fit.withColumn("draw", draw("doc_id", "chunk_idx", config=config)).orderBy("draw").limit(n).select("doc_id", "chunk_idx", F.length("text").cast("long").alias("n_chars"))


def first_docs(index: DataFrame, k: int, config: Config = DEFAULT) -> DataFrame:
    """The first ``k`` documents of each entity by draw: ``entity, doc_id, chunk_idx, draw, place``.

    Each document counts with its first chunk by draw.
    """
    drawn = index.withColumn("draw", draw("entity", "doc_id", "chunk_idx", config=config))
    one = drawn.groupBy("entity", "doc_id").agg(F.min(F.struct("draw", "chunk_idx")).alias("c")).select("entity", "doc_id", "c.*")
    order = Window.partitionBy("entity").orderBy("draw")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _options(names: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """``node, options``: the ``n`` documents that come first after each document ``last`` of ``names`` (``last, entity``).

    ``first`` has ``entity`` and its first documents ``near`` (``draw, next``), in order.  An option
    is ``draw, entity, next``, and no document is one twice.  Names may repeat.
    """
    near = F.slice(F.filter("near", lambda x: x["next"] != F.col("last")), 1, n)  # of an entity, n are enough
    met = names.join(small(first), "entity").select("last", "entity", F.explode(near).alias("x")).select("last", "entity", "x.draw", "x.next")
    if n == 1:
        best = met.groupBy("last").agg(F.min(F.struct("draw", "entity", "next")).alias("o"))
        return best.select(F.col("last").alias("node"), F.array("o").alias("options"))
    once = met.groupBy("last", "next").agg(F.min(F.struct("draw", "entity")).alias("o")).select("last", F.struct("o.draw", "o.entity", "next").alias("o"))
    order = Window.partitionBy("last").orderBy("o")
    kept = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return kept.groupBy(F.col("last").alias("node")).agg(F.array_sort(F.collect_list("o")).alias("options"))


def chains(index: DataFrame, n_docs: int, config: Config = DEFAULT) -> DataFrame:
    """Chains of ``n_docs`` documents, each joined to the next by an entity: one for each start.

    ``doc_1, bridge_1, doc_2, ...``.  A step takes the entity and the document with the
    smallest draw among those whose document is not in the chain; a chain has at most
    ``n_docs - 1`` documents before, so the first ``n_docs`` of an entity are enough.  Chains
    over the same set of documents count once, the one with the smallest start.

    What may follow hangs on the last document alone, so it is found once for each: most chains
    go on to the same few documents, which are not joined with their entities for every chain.
    ``index`` is cut.
    """
    rows = dealt(index, index.count(), "doc_id")
    names = rows.select(F.col("doc_id").alias("last"), "entity")
    first = cut(first_docs(rows, n_docs, config).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("draw", F.col("doc_id").alias("next")))).alias("near")))
    made, cols = None, ["doc_1"]
    for k in range(2, n_docs + 1):
        if made is None:
            met = _options(names, first, 1).withColumnRenamed("node", "doc_1")
        else:
            lasts = small(cut(made.select("last").distinct()))
            met = looked_up(made, "last", cut(_options(names.join(lasts, "last", "left_semi"), first, k - 1)))
        chain = F.array(*(f"doc_{j}" for j in range(1, k)))
        taken = met.withColumn("b", F.get(F.filter("options", lambda o: ~F.array_contains(chain, o["next"])), F.lit(0))).where("b is not null")
        made = cut(taken.select(*cols, F.col("b.entity").alias(f"bridge_{k - 1}"), F.col("b.next").alias(f"doc_{k}"), F.col("b.next").alias("last")))
        cols += [f"bridge_{k - 1}", f"doc_{k}"]
    same = F.array_sort(F.array(*(f"doc_{k}" for k in range(1, n_docs + 1))))
    sets = dealt(made.withColumn("docs", same), made.count(), "docs")  # a set has at most as many rows as documents
    return sets.groupBy("docs").agg(F.min(F.struct(*cols)).alias("c")).select("c.*")


def summary_clusters(index: DataFrame, n: int, least: int = 2, config: Config = DEFAULT) -> DataFrame:
    """The ``n`` entities of three letters or more in most documents, with their first chunks in up to five documents."""
    wide = index.groupBy("entity").agg(F.countDistinct("doc_id").alias("n_docs")).where((F.col("n_docs") >= least) & (F.length("entity") >= 3))
    top = wide.orderBy(F.desc("n_docs"), "entity").limit(n)
    one = index.join(F.broadcast(top), "entity").groupBy("entity", "n_docs", "doc_id").agg(F.min("chunk_idx").alias("chunk_idx"))  # top: n rows
    order = Window.partitionBy("entity").orderBy("doc_id")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.summary_documents)
