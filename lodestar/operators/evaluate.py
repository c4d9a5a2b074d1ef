"""Scores of answers and of embedding spaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import parsing, prompts
from ..functions.calls import Limits, Model, called, is_object
from ..functions.text import is_refusal, sentences, tokens
from ..functions.vectors import dot, hashed
from ..providers import RULES, Providers
from ..storage import cut
from .search import nearest


def token_f1(pairs: DataFrame) -> DataFrame:
    """``qid, precision, recall, semantic_f1`` of ``prediction`` against ``reference``.

    Tokens match if they are equal: precision is the share of the prediction's tokens that
    the reference has, recall the reverse.  A refusal scores 0.
    """
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a)).otherwise(F.lit(0.0))
    made = pairs.withColumns({"p": tokens(F.lower("prediction")), "r": tokens(F.lower("reference"))})
    made = made.withColumns({"precision": share(F.col("p"), F.col("r")), "recall": share(F.col("r"), F.col("p"))})
    total = F.col("precision") + F.col("recall")
    f1 = F.when(is_refusal(F.col("prediction")) | (total == 0), F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / total)
    return made.select("qid", "precision", "recall", f1.alias("semantic_f1"))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def greedy_match(made: np.ndarray, given: np.ndarray, block: int = 1024) -> tuple[float, float]:
    """Precision and recall of token vectors: the mean of each one's best cosine on the other side.

    ``block`` rows are compared at a time, so memory grows with the texts' length and not with
    the product of two.  A zero vector has cosine 0 with all; a side without tokens gives 0 and 0.
    """
    if not len(made) or not len(given):
        return 0.0, 0.0
    both = made.any(0) & given.any(0)  # the other dimensions add nothing to a product
    made, given = _unit(made)[:, both], _unit(given)[:, both]
    rows, columns = np.empty(len(made)), np.full(len(given), -np.inf)
    for at in range(0, len(made), block):
        best = np.full(min(block, len(made) - at), -np.inf)
        for to in range(0, len(given), block):
            cosine = made[at : at + block] @ given[to : to + block].T
            best = np.maximum(best, cosine.max(axis=1))
            columns[to : to + block] = np.maximum(columns[to : to + block], cosine.max(axis=0))
        rows[at : at + block] = best
    return float(rows.mean()), float(columns.mean())


def semantic_f1(pairs: DataFrame, providers: Providers = RULES, batch: int = 32) -> DataFrame:
    """``qid, precision, recall, semantic_f1``: tokens of ``prediction`` and ``reference`` matched by their vectors.

    Each token meets the one of the other text whose vector has the largest cosine; precision
    is the mean over the prediction, recall over the reference.  The provider's token embedder
    gets ``batch`` pairs of texts at a time.  A refusal, a text without tokens and a sum that
    is not positive score 0.  With vectors that are one for equal tokens and orthogonal for
    others this is ``token_f1``.
    """
    embed = providers.embed_tokens
    refused = is_refusal(F.col("prediction"))
    rows = pairs.select("qid", F.coalesce("prediction", F.lit("")).alias("prediction"), F.coalesce("reference", F.lit("")).alias("reference"), refused.alias("refused"))
    kind = rows.schema["qid"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            scores = []
            for at in range(0, len(part), batch):
                few = part.iloc[at : at + batch]
                vectors = embed([*few["prediction"], *few["reference"]])
                scores += [greedy_match(vectors[i], vectors[len(few) + i]) for i in range(len(few))]
            p, r = (np.array([s[i] for s in scores], float) for i in (0, 1))
            total = p + r
            f1 = np.where(part["refused"].to_numpy(bool) | (total <= 0), 0.0, 2 * p * r / np.where(total > 0, total, 1.0))
            yield pd.DataFrame({"qid": part["qid"], "precision": p, "recall": r, "semantic_f1": f1})

    return rows.mapInPandas(run, f"qid {kind}, precision double, recall double, semantic_f1 double")


def model_judged(pairs: DataFrame, model: Model, limits: Limits = Limits()) -> DataFrame:
    """``qid, llm_label, status, attempts`` by a model that is asked for each pair with its ``question``.

    A refusal or blank prediction is incomplete without a call.  A reply that is no JSON
    object is tried again; after the last attempt the label is incomplete and the status failed.
    """
    answered = ~is_refusal(F.col("prediction")) & (F.trim("prediction") != "")
    asked = pairs.where(answered).select("qid", F.to_json(prompts.label(F.col("question"), F.col("reference"), F.col("prediction"))).alias("prompt"))
    made = called(asked, "prompt", model, limits, is_object).select("qid", parsing.judge_label(F.col("reply")).alias("llm_label"), "status", "attempts")
    rest = pairs.where(~F.coalesce(answered, F.lit(False))).select("qid", F.lit("incomplete").alias("llm_label"), F.lit("done").alias("status"), F.lit(0).alias("attempts"))
    return made.unionByName(rest)


def _by_sentence(pairs: DataFrame, answer: str, against: str) -> DataFrame:
    """Each sentence of the answer with its best similarity to the texts it is held against."""
    rows = pairs.select("qid", F.transform(F.col(against), lambda x: hashed(x)).alias("against"), F.posexplode(sentences(F.col(answer))).alias("pos", "sentence"))
    rows = rows.withColumn("v", hashed(F.col("sentence")))
    return rows.select("qid", "pos", F.array_max(F.transform("against", lambda a: dot(F.col("v"), a))).alias("similarity"))


def coverage(pairs: DataFrame) -> DataFrame:
    """``qid, coverage``: the best similarity of the reference to a sentence of the prediction; 0 for refusals."""
    best = _by_sentence(pairs.where(~is_refusal(F.col("prediction"))).withColumn("one", F.array("reference")), "prediction", "one")
    best = best.groupBy("qid").agg(F.max("similarity").alias("coverage"))
    return pairs.select("qid").join(best, "qid", "left").select("qid", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def faithfulness(pairs: DataFrame, config: Config = DEFAULT, split: bool = False) -> DataFrame:
    """``qid, faithfulness_hard, faithfulness_soft`` of ``prediction`` against ``retrieved`` texts.

    Hard is the share of sentences whose best similarity reaches the threshold, soft the mean
    of the best ones.  Both are null for refusals and without retrieved texts.  ``split``
    compares with the sentences of the texts instead of the texts, and gives 0 without any.
    """
    texts = F.flatten(F.transform("retrieved", lambda x: sentences(x))) if split else F.col("retrieved")
    usable = pairs.where(~is_refusal(F.col("prediction")) & (F.size(F.coalesce("retrieved", F.array().cast("array<string>"))) > 0)).withColumn("texts", texts)
    best = _by_sentence(usable, "prediction", "texts")
    scores = best.groupBy("qid").agg(F.avg((F.round("similarity", 9) >= config.faithful_similarity).cast("double")).alias("faithfulness_hard"), F.avg("similarity").alias("faithfulness_soft"))
    if not split:
        return pairs.select("qid").join(scores, "qid", "left")
    given = pairs.select("qid", is_refusal(F.col("prediction")).alias("refused")).join(scores, "qid", "left")
    return given.select("qid", *(F.when(~F.col("refused"), F.coalesce(c, F.lit(0.0))).alias(c) for c in ("faithfulness_hard", "faithfulness_soft")))


def judged(pairs: DataFrame) -> DataFrame:
    """``qid, llm_label`` by rule: a refusal is incomplete, an answer that holds the reference correct."""
    held = F.contains(F.lower("prediction"), F.lower(F.trim("reference")))
    label = F.when(is_refusal(F.col("prediction")) | (F.trim("prediction") == ""), F.lit("incomplete")).when(held, F.lit("correct")).otherwise(F.lit("incorrect"))
    return pairs.select("qid", label.alias("llm_label"))


def all_metrics(pairs: DataFrame, config: Config = DEFAULT, providers: Providers | None = None, labels: bool = True) -> DataFrame:
    """One row for each question with every score; ``pairs`` has ``qid, reference, prediction, retrieved``.

    With providers tokens are matched by their vectors, else equal ones match.  Without
    ``labels`` nothing is judged and labels are null.
    """
    out = (semantic_f1(pairs, providers) if providers else token_f1(pairs)).select("qid", "semantic_f1")
    for part in (coverage(pairs), faithfulness(pairs, config), *([judged(pairs)] if labels else [])):
        out = out.join(part, "qid")
    return out if labels else out.withColumn("llm_label", F.lit(None).cast("string"))


def to_evaluate(questions: DataFrame, answers: DataFrame, retrieved: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """``qid, reference, prediction, retrieved``: answered questions that have no scores yet.

    ``questions`` has ``qid, reference``, ``answers`` ``qid, prediction``, ``retrieved``
    ``qid, retrieved`` (texts; none for a question means an empty list) and ``done`` ``qid``.
    """
    rows = questions.where("reference is not null").join(answers.where("prediction is not null"), "qid")
    if done is not None:
        rows = rows.join(done.select("qid").distinct(), "qid", "left_anti")
    none = F.array().cast("array<string>")
    if retrieved is None:
        return rows.withColumn("retrieved", none)
    return rows.join(retrieved.select("qid", "retrieved"), "qid", "left").withColumn("retrieved", F.coalesce("retrieved", none))


def summary(scores: DataFrame) -> DataFrame:
    """Means that ignore nulls, and the labels' counts and shares."""
    labelled = F.count("llm_label")
    share = lambda k: F.round(100.0 * F.count_if(F.col("llm_label") == k) / labelled, 2).alias(f"pct_{k}")
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("semantic_f1", "coverage", "faithfulness_hard", "faithfulness_soft")]
    return scores.agg(F.count("*").alias("n"), *means, *(F.count_if(F.col("llm_label") == k).alias(f"n_{k}") for k in ("correct", "incorrect", "incomplete")), *map(share, ("correct", "incorrect", "incomplete")))


def comparison(labels: DataFrame, a: str, b: str) -> DataFrame:
    """How two methods' labels meet: ``label_a, label_b, n``; ``labels`` has ``qid, method, llm_label``."""
    left = labels.where(F.col("method") == a).select("qid", F.col("llm_label").alias("label_a"))
    right = labels.where(F.col("method") == b).select("qid", F.col("llm_label").alias("label_b"))
    return left.join(right, "qid").groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def compared(labels: DataFrame, a: str, b: str) -> DataFrame:
    """``qid, label_a, label_b, same, winner``: two methods' labels of each question that both have.

    The winner has the better label of correct, incomplete, incorrect; null for equal ones.
    """
    left = labels.where(F.col("method") == a).select("qid", F.col("llm_label").alias("label_a"))
    right = labels.where(F.col("method") == b).select("qid", F.col("llm_label").alias("label_b"))
    worth = lambda c: F.when(F.col(c) == "correct", 2).when(F.col(c) == "incomplete", 1).otherwise(0)
    winner = F.when(worth("label_a") > worth("label_b"), F.lit(a)).when(worth("label_a") < worth("label_b"), F.lit(b))
    return left.join(right, "qid").select("qid", "label_a", "label_b", (F.col("label_a") == F.col("label_b")).alias("same"), winner.alias("winner"))


def semantic_report(vectors: DataFrame, k: int = DEFAULT.hub_neighbours) -> DataFrame:
    """One row with every metric of ``item_id, embedding``; an empty table has the status ``failed`` and no metrics."""
    size = vectors.agg(F.count("*").alias("total_embeddings"), F.max(F.size("embedding")).alias("embedding_dimension"))
    enough = vectors.count() > k
    seen = hubs(vectors, k) if enough else vectors.select("item_id", F.lit(0).cast("long").alias("occurrence"))
    spread = _spread(seen, enough).toDF("hubness_score", "debug_max_occurrence", "debug_mean_occurrence")
    top = rank_hubs(seen).agg(F.array_sort(F.collect_list(F.struct("place", "item_id", "occurrence"))).alias("t"))
    top = top.select(F.transform("t", lambda x: F.struct(x["item_id"].alias("chunk_index"), x["occurrence"].alias("occurrence"))).alias("top_hubs"))
    rows = size.crossJoin(two_nn(vectors)).crossJoin(centroid_distances(vectors)).crossJoin(spread).crossJoin(top)  # one row each
    some = F.col("total_embeddings") > 0
    part = lambda *c: F.when(some, F.struct(*c))
    return rows.select(
        F.when(some, F.lit("success")).otherwise(F.lit("failed")).alias("status"), "total_embeddings", "embedding_dimension",
        part("intrinsic_dimension", "valid_samples").alias("semantic_complexity"),
        part(*(f"{x}_centroid_distance" for x in ("avg", "std", "min", "max"))).alias("semantic_distinguishability"),
        part("hubness_score", F.lit(k).alias("k"), "top_hubs").alias("semantic_interference"), "debug_max_occurrence", "debug_mean_occurrence",
    )


def structure_report(vertices: DataFrame, edges: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row with every metric of a graph of ``node`` and ``src, dst, relation``; an empty one has zeros."""
    from . import graph

    vertices, edges = cut(vertices), cut(edges)
    stats = graph.basic_stats(vertices, edges)
    linked = graph.components(edges.select("src", "dst")).select("component")
    alone = vertices.join(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("component"))
    sizes = linked.groupBy("component").agg(F.count("*").alias("n")).unionByName(alone.withColumn("n", F.lit(1).cast("long")))
    joined = sizes.agg(F.count("*").alias("n_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.round(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)), 4).alias("largest_ratio"), (F.count("*") == 1).alias("connected"))
    d = graph.degrees(edges).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("total"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))
    clustered = graph.clustering(vertices, edges.select("src", "dst")).select(F.coalesce("avg_clustering", F.lit(0.0)).alias("avg_clustering"))
    paths = graph.path_metrics(edges.select("src", "dst"), config).select("avg_path", "diameter", F.col("n_nodes").alias("path_nodes"))
    top = graph.top_relations(edges).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "relation")))).alias("t")).select(F.transform("t", lambda x: F.struct(x["relation"].alias("relation"), x["n"].alias("n"))).alias("top"))
    rows = stats.crossJoin(joined).crossJoin(d).crossJoin(clustered).crossJoin(paths).crossJoin(top)  # one row each
    n = F.col("n_nodes")
    mean = F.when(n > 0, F.round(F.col("total") / n, 6)).otherwise(F.lit(0.0))
    central = F.when(n > 1, F.round(F.col("total") / n / (n - 1), 6)).otherwise(F.lit(0.0))
    return rows.select(
        F.when(n > 0, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.struct("n_nodes", "n_edges", "n_relations", "density", "avg_degree", "n_isolated").alias("basic_stats"),
        F.struct("n_components", "largest", "largest_ratio", "connected").alias("connectivity"),
        F.struct(mean.alias("avg_degree"), "max_degree", central.alias("avg_centrality")).alias("centrality"),
        F.struct("avg_path", "diameter", F.col("path_nodes").alias("n_nodes")).alias("path_metrics"),
        F.struct("n_relations", "top").alias("relation_metrics"), "avg_clustering",
    )


def two_nn(vectors: DataFrame) -> DataFrame:
    """Intrinsic dimension from the two nearest neighbours of each vector: one row.

    Null if fewer than three vectors, or two that can be used.
    """
    near = nearest(vectors.select(F.col("item_id").alias("qid"), "embedding"), vectors, 2, skip_self=True)
    far = near.withColumn("d", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))))
    both = far.groupBy("qid").agg(F.min("d").alias("r1"), F.max("d").alias("r2"), F.count("*").alias("n")).where((F.col("n") == 2) & (F.col("r1") > 1e-7))
    mean, n = F.avg(F.ln(F.col("r2") / F.col("r1"))), F.count("*")
    return both.agg(F.when((n >= 2) & (mean > 0), F.round(1 / mean, 4)).alias("intrinsic_dimension"), n.alias("valid_samples"))


def centroid_distances(vectors: DataFrame) -> DataFrame:
    """Cosine distance of the vectors to their mean: mean, population deviation, least and most.

    The mean has one row for each dimension; only that is sent out.  A zero vector counts in
    the mean, but has no distance to it.
    """
    mean = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    length = lambda v: F.sqrt(dot(v, v))
    far = vectors.crossJoin(F.broadcast(centre)).select((1 - F.try_divide(dot(F.col("embedding"), F.col("centre")), length(F.col("embedding")) * length(F.col("centre")))).alias("d"))
    return far.agg(*(F.round(f("d"), 6).alias(f"{k}_centroid_distance") for k, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))


def hubs(vectors: DataFrame, k: int = DEFAULT.hub_neighbours) -> DataFrame:
    """``item_id, occurrence``: in how many others' k nearest a vector is."""
    near = nearest(vectors.select(F.col("item_id").alias("qid"), "embedding"), vectors, k, skip_self=True)
    seen = near.groupBy("item_id").agg(F.count("*").alias("occurrence"))
    return vectors.select("item_id").join(seen, "item_id", "left").select("item_id", F.coalesce("occurrence", F.lit(0)).alias("occurrence"))


def _spread(occurrences: DataFrame, enough: bool) -> DataFrame:
    """One row of ``occurrence``: ``hubness, max_occurrence, mean_occurrence``; null, 0 and 0 of too few vectors."""
    if not enough:
        return occurrences.sparkSession.range(1).select(F.lit(None).cast("double").alias("hubness"), F.lit(0).cast("long").alias("max_occurrence"), F.lit(0.0).alias("mean_occurrence"))
    skew = F.coalesce(F.nanvl(F.skewness("occurrence"), F.lit(0.0)), F.lit(0.0))
    return occurrences.agg(F.round(skew, 6).alias("hubness"), F.max("occurrence").alias("max_occurrence"), F.round(F.avg("occurrence"), 6).alias("mean_occurrence"))


def hubness(vectors: DataFrame, k: int = DEFAULT.hub_neighbours) -> DataFrame:
    """One row: population skewness of the occurrences (0 if they are equal), largest and mean.

    Of fewer than ``k + 1`` vectors the skewness is null, the others 0.
    """
    enough = vectors.count() > k
    return _spread(hubs(vectors, k) if enough else vectors, enough)


def rank_hubs(occurrences: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` vectors that are near to most others; one that is near to none is no hub."""
    order = Window.orderBy(F.desc("occurrence"), F.desc("item_id"))
    top = occurrences.where("occurrence > 0").orderBy(F.desc("occurrence"), F.desc("item_id")).limit(n)
    return top.withColumn("place", F.row_number().over(order))
