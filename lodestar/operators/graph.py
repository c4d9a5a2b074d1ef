"""Entity graphs held as tables: building, neighbourhoods, PageRank, components and metrics."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT, Config
from ..functions import parsing, prompts
from ..functions.calls import Limits, Model, called, is_list_of_lists
from ..functions.text import capitalised, valid_name
from ..storage import BROADCAST_ROWS, cut, dealt, in_turn, looked_up, mapped, small, stored, together


PIECE = 4096  # edges of a node that go to one task
WORD = 64  # sources whose searches share a number
CELLS = 12_000_000  # scores that a task holds at once
MOST_TASKS = 4096
QUESTIONS = 50_000  # that a task goes through, at most
JOINED = 1 << 20  # edges that a task joins at once
STRIP, PART = 1024, 1 << 18  # edges of a row, and those that are put in order at once
SHORT = 64  # a node of more edges in a part is added up by itself
ADDED = 1 << 18  # bytes that are added up at once
FRONT = 20_000  # nodes of questions from which on their edges are looked for from the end of lower degree


def extract(chunks: DataFrame) -> DataFrame:
    """Triplets by rule: each capitalised word and the next one of its chunk, ``next_to`` each other."""
    found = chunks.withColumn("names", capitalised(F.col("text"))).where(F.size("names") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda i: F.struct(F.get("names", i - 1).alias("subject"), F.get("names", i).alias("object")))
    rows = found.select("doc_id", "chunk_idx", F.col("text").alias("source_text"), F.posexplode(pairs).alias("pos", "pair"))
    return rows.select("pair.subject", F.lit("next_to").alias("relation"), "pair.object", "doc_id", "chunk_idx", "source_text", "pos")


def attempted(replies: DataFrame) -> DataFrame:
    """A model's replies (``content``) with ``triplets`` and ``status``: failed where the JSON is broken.

    The failed rows are the queue for another attempt; what fails again stays in it.
    """
    from ..functions.parsing import json_of
    from ..functions.parsing import triplets as parsed

    good = json_of(F.col("content"), "array<array<string>>").isNotNull()
    return replies.withColumn("triplets", parsed(F.col("content"))).withColumn("status", F.when(good, F.lit("done")).otherwise(F.lit("failed")))


def extractor(model: Model, limits: Limits = Limits()) -> Callable[[DataFrame], DataFrame]:
    """A function from chunks to triplets, as ``extract`` is one, that asks ``model`` for each chunk.

    A reply that is no JSON list of lists is tried again.  A chunk whose last attempt failed
    gives one row with the status ``failed``, its error and no names; one without a triplet
    gives none.
    """

    def run(chunks: DataFrame) -> DataFrame:
        asked = chunks.select("doc_id", "chunk_idx", F.col("text").alias("source_text"), F.to_json(prompts.triplets(F.col("text"))).alias("prompt"))
        replies = cut(called(asked, "prompt", model, limits, is_list_of_lists))
        made = replies.select("doc_id", "chunk_idx", "source_text", "status", "error", F.posexplode_outer(parsing.triplets(F.col("reply"))).alias("pos", "t"))
        name = lambda i, c: F.get("t", F.lit(i)).alias(c)
        return made.where("t is not null or status = 'failed'").select(name(0, "subject"), name(1, "relation"), name(2, "object"), "doc_id", "chunk_idx", "source_text", "pos", "status", "error")

    return run


def retried(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first attempt's rows, those that failed replaced by the second attempt's."""
    again = second.join(first.where("status = 'failed'").select(key), key, "left_semi")
    return together(first.where("status <> 'failed'"), again.select(first.columns))


def valid(triplets: DataFrame) -> DataFrame:
    return triplets.where(valid_name(F.col("subject")) & valid_name(F.col("relation")) & valid_name(F.col("object")))


def entities(triplets: DataFrame) -> DataFrame:
    return triplets.select(F.col("subject").alias("entity")).union(triplets.select("object")).distinct()


def numbered(names: DataFrame) -> DataFrame:
    """``entity_id, entity``: the rank of a name among all, from 0.

    Names are ranged over partitions, counted in each, and numbered inside; no task holds
    all of them.
    """
    dealt = cut(names.select("entity").repartitionByRange("entity").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("part", before.alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("entity"))
    return dealt.join(F.broadcast(base), "part").select((F.col("base") + rank - 1).cast("long").alias("entity_id"), "entity")


def provenance(triplets: DataFrame) -> DataFrame:
    """How often, and in how many documents, each triplet is stated."""
    return triplets.groupBy("subject", "relation", "object").agg(F.count("*").alias("n_sources"), F.countDistinct("doc_id").alias("n_docs"))


def collapsed(triplets: DataFrame, order: list[str]) -> DataFrame:
    """One undirected edge for each pair of entities; the last statement in ``order`` gives its relation."""
    rank = F.struct(*order, "relation")
    return triplets.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.max_by("relation", rank).alias("relation"), F.max_by("doc_id", rank).alias("doc_id"))


def entities_per_doc(triplets: DataFrame, most: int | None = None) -> DataFrame:
    """How many entities each document's triplets name; there are at most ``most`` triplets, which are counted if it is not told."""
    most = triplets.count() if most is None else most
    both = triplets.select("doc_id", F.explode(F.array("subject", "object")).alias("entity"))
    once = dealt(both, 2 * most, "doc_id", "entity").distinct()
    return once.groupBy("doc_id").agg(F.count("entity").alias("n_entities"))


def both_ways(edges: DataFrame, loops: bool = False) -> DataFrame:
    """``src, dst`` in both directions, each once."""
    out = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return out if loops else out.where("src <> dst")


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value.cast("double"), digits)


def _turned(pairs: DataFrame) -> DataFrame:
    """``src, dst`` as they are and, but for loops, the other way round; ``pairs`` is read once."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    ways = F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src")))
    return pairs.select(F.explode(ways).alias("way")).select("way.src", "way.dst")


def linked(edges: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """``src, piece, dst``, edges in both directions, loops once; and ``node, degree, pieces``.

    A node's edges are dealt into pieces of about ``piece``, so what meets a hub is joined
    piece by piece, in many tasks.  Only nodes of more than one piece, which are fewer than
    edges by that factor, are told to the edges, so these are not shuffled by node.
    """
    known = edges.where("src is not null and dst is not null")
    pairs = known.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = stored(_turned(pairs), "links")
    degree = stored(both.groupBy("src").agg(F.count("*").alias("degree")).select(F.col("src").alias("node"), "degree", F.ceil(F.col("degree") / piece).cast("int").alias("pieces")), "degrees")
    hubs = small(cut(degree.where("pieces > 1").select(F.col("node").alias("src"), F.col("pieces").alias("own"))))
    dealt = both.join(hubs, "src", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("own")), F.lit(0)).cast("int"))
    return dealt.select("src", "piece", "dst"), degree


def adjacency(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """``src, piece, dst, dst_degree, dst_pieces``: see ``linked``."""
    return _told(*linked(edges, piece))


def _told(links: DataFrame, degree: DataFrame) -> DataFrame:
    return stored(looked_up(links, "dst", degree.select("node", F.col("degree").alias("dst_degree"), F.col("pieces").alias("dst_pieces"))), "adjacency")


def _shares(degree: DataFrame, seeds: DataFrame) -> DataFrame:
    """``qid, node, share, degree, pieces`` of the seeds that are in the graph; shares of a question add up to 1."""
    there = degree.join(small(cut(seeds.select("node").distinct())), "node", "left_semi")
    start = cut(seeds.join(there, "node").select("qid", "node", "weight", "degree", "pieces"))
    known = start.groupBy("qid").agg(F.sum("weight").alias("known"))
    return cut(start.join(known, "qid").select("qid", "node", (F.col("weight") / F.col("known")).alias("share"), "degree", "pieces"))


def _pieces(state: DataFrame, amount: Column) -> DataFrame:
    """What each row of ``state`` (``qid, node, pieces``) sends to each of its node's pieces: ``qid, src, piece, part``."""
    return state.select("qid", F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), amount.alias("part"))


def _flow(state: DataFrame, links: DataFrame, amount: Column, sent_out: bool = False) -> DataFrame:
    """What each row of ``state`` (``qid, node, pieces``) sends along its edges: ``qid, node, degree, pieces, part``."""
    sent = _pieces(state, amount)
    met = links.join(F.broadcast(sent) if sent_out else sent, ["src", "piece"])
    return met.select("qid", F.col("dst").alias("node"), F.col("dst_degree").alias("degree"), F.col("dst_pieces").alias("pieces"), "part")


def _sent(front: DataFrame) -> int:
    """How many rows ``front`` is when it meets the pieces."""
    return front.agg(F.sum("pieces").alias("n")).first()["n"] or 0


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int, alpha: float = DEFAULT.ppr_alpha, tolerance: float | None = None, every: int = 5) -> DataFrame:
    """Personalised PageRank over an undirected graph, round by round: ``qid, node, score``.

    ``edges`` has ``src, dst`` (both directions are made), ``seeds`` ``qid, node, weight``.
    Every round joins the scores with the edges and adds them up by node, first in each task;
    scores start at the seeds' shares.  As long as few nodes have a score, these are sent out
    to where the edges and degrees lie; later both are joined by shuffle, in pieces.  With a
    ``tolerance`` it is seen every few rounds whether the last round's change, summed over
    nodes, is below it times the number of nodes for every question, which ends the work.
    Seeds that are not in the graph are left out; without any a question has no row.
    """
    links, degree = linked(edges)
    nodes = degree.count()
    enough = None if tolerance is None else tolerance * nodes
    start = _shares(degree, seeds)
    scores = start.select("qid", "node", F.col("share").alias("score"))
    most = nodes * start.select("qid").distinct().count()  # rows that scores can have
    few = True
    for n in range(1, rounds + 1):
        few = few and (most <= BROADCAST_ROWS or scores.count() <= BROADCAST_ROWS)
        state = degree.join(F.broadcast(scores) if few else scores, "node")
        amount = alpha * F.col("score") / F.col("degree")
        if few:
            flow = links.join(F.broadcast(state.select("qid", F.col("node").alias("src"), amount.alias("part"))), "src")
        else:
            flow = links.join(_pieces(state, amount), ["src", "piece"])
        back = start.select("qid", "node", ((1 - alpha) * F.col("share")).alias("part"))
        added = together(flow.select("qid", F.col("dst").alias("node"), "part"), back).groupBy("qid", "node").agg(F.sum("part").alias("score"))
        counted = few and most > BROADCAST_ROWS and n < rounds
        new = stored(added, "scores") if counted or n % every == every - 1 or n % every == 0 else added
        if tolerance is not None and n % every == 0:
            pair = new.alias("n").join(scores.alias("o"), ["qid", "node"], "full")
            change = pair.groupBy("qid").agg(F.sum(F.abs(F.coalesce("n.score", F.lit(0.0)) - F.coalesce("o.score", F.lit(0.0)))).alias("d")).agg(F.max("d").alias("d")).first()["d"]
            if (change or 0.0) < enough:
                return new.select("qid", "node", "score")
        scores = new
    return scores.select("qid", "node", "score")


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``src, dst``, sorted by ``dst``, to rows with up to ``STRIP`` of them as bytes: each ``dst`` once, how many it has, and their ``src``."""
    for batch in batches:
        ends, out = [batch.column(c).to_numpy().astype("<u4") for c in ("src", "dst")], []
        for i in range(0, batch.num_rows, STRIP):
            src, dst = (x[i : i + STRIP] for x in ends)
            begin = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
            out.append((src.tobytes(), dst[begin].tobytes(), np.diff(np.r_[begin, len(dst)]).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (zip(*out, strict=True) if out else ((), (), ()))], ["src", "dst", "many"])


def _wide_rows(wide: int) -> int:
    """How many rows of so many scores are added up at once."""
    return max(16, ADDED // (8 * wide))


def _laid(src: np.ndarray, dst: np.ndarray, many: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
    """Edges in the order in which they are added up for ``wide`` questions.

    Nodes of up to ``SHORT`` edges come by falling number of them, some rows at a time: the
    first ``src`` of all these nodes, the second of those that have one, and so on.  Then come
    the others, each with all it has.  Gives ``src``, the nodes, how many of them there are
    at each step, the steps of each group of rows, and the other nodes and their numbers.
    """
    full = np.repeat(dst, many)
    if (full[1:] < full[:-1]).any():
        order = np.argsort(full, kind="stable")
        full, src = full[order], src[order]
    begin = np.flatnonzero(np.r_[True, full[1:] != full[:-1]])
    count, node = np.diff(np.r_[begin, len(full)]), full[begin]
    long = np.flatnonzero(count > SHORT)
    short = np.flatnonzero(count <= SHORT)
    short = short[np.argsort(-count[short], kind="stable")]
    out, heights, steps = [], [], []
    for i in range(0, len(short), _wide_rows(wide)):
        rows = short[i : i + _wide_rows(wide)]
        step = np.arange(count[rows[0]])[:, None]
        there = step < count[rows][None]
        out.append(src[(begin[rows][None] + step)[there]])
        heights.append(there.sum(1))
        steps.append(len(step))
    out += [src[begin[k] : begin[k] + count[k]] for k in long]
    joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return joined(out, "<u4"), node[short].astype("<u4"), joined(heights, "<u4"), np.array(steps, "<u4"), node[long].astype("<u4"), count[long].astype("<u4")


def _parts(held: tempfile._TemporaryFileWrapper, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    held.seek(0)
    for _ in range(n):
        yield pickle.load(held)


def _add(part: tuple[np.ndarray, ...], sent: np.ndarray, scores: np.ndarray, rows: np.ndarray, more: np.ndarray) -> None:
    """Add to the ``scores`` of a part's nodes what its edges bring of ``sent``; ``rows`` and ``more`` are room for that."""
    src, short, heights, steps, long, count = (x.astype(np.int64) for x in part)
    at = step = first = 0
    for n in steps.tolist():
        height = heights[step : step + n].tolist()
        total = np.take(sent, src[at : at + height[0]], axis=0, out=rows[: height[0]], mode="clip")
        at += height[0]
        for h in height[1:]:
            total[:h] += np.take(sent, src[at : at + h], axis=0, out=more[:h], mode="clip")
            at += h
        scores[short[first : first + height[0]]] += total
        first += height[0]
        step += n
    for node, n in zip(long.tolist(), count.tolist(), strict=True):
        for i in range(at, at + n, len(more)):
            end = min(i + len(more), at + n)
            scores[node] += np.take(sent, src[i:end], axis=0, out=more[: end - i], mode="clip").sum(0)
        at += n


def _apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that a shuffle by them to ``n`` partitions puts into one partition each."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(64 * n + 1000).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in found]


def pagerank_best(edges: DataFrame, seeds: DataFrame, rounds: int, best: int, least: float, alpha: float = DEFAULT.ppr_alpha, cells: int = CELLS) -> DataFrame:
    """What ``pagerank`` gives, for many questions: ``qid, node, score`` of nodes with at least ``least`` that may be among a question's ``best``.

    Nodes are numbers from 0 on, without large gaps.  After a few rounds a question has a
    score at almost every node, so a row for each would be the questions times the graph.
    Here questions are dealt over as many tasks as run at once.  A task keeps one copy of the
    edges in a file and takes so many of its questions at a time that their scores are
    ``cells`` numbers at most; for these it goes through the edges once a round.  All scores
    are made, and those that can't be among the best, ties at 11 places kept, are not sent on.
    Time stays questions times edges; memory does not grow with either, and what is written
    is the edges times the tasks, however many questions there are.
    """
    both = cut(both_ways(edges, loops=True).where("src is not null and dst is not null"))
    size = (both.agg(F.max("dst").alias("n")).first()["n"] or 0) + 1
    spark, n = edges.sparkSession, seeds.select("qid").distinct().count()
    wide = max(1, min(cells // size, n))
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // QUESTIONS))
    blocks = _apart(spark, max(1, min(-(-n // wide), tasks, MOST_TASKS)))
    wide = max(1, min(wide, -(-2 * n // len(blocks))))
    strips = both.repartitionByRange("dst").sortWithinPartitions("dst", "src").select("src", "dst").mapInArrow(_strips, "src binary, dst binary, many binary")
    strips = cut(strips.withColumn("strip", F.monotonically_increasing_id()))
    none = F.lit(None)
    block = F.get(F.array(*(F.lit(b).cast("int") for b in blocks)), F.pmod(F.xxhash64("qid"), F.lit(len(blocks))).cast("int"))
    asked = seeds.select(block.alias("block"), F.lit(-1).cast("long").alias("strip"), *(none.cast("binary").alias(c) for c in ("src", "dst", "many")), "qid", F.col("node").cast("long").alias("node"), F.col("weight").cast("double").alias("weight"))
    sent = strips.join(F.broadcast(cut(asked.select("block").distinct())), how="cross")
    rows = together(asked, sent.select("block", "strip", "src", "dst", "many", *(none.cast(asked.schema[c].dataType).alias(c) for c in ("qid", "node", "weight"))))
    kind = pa.schema([("qid", to_arrow_type(seeds.schema["qid"].dataType)), ("node", pa.int64()), ("score", pa.float64())])

    def ranked(questions: list[pa.RecordBatch], degree: np.ndarray, held: tempfile._TemporaryFileWrapper, parts: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(questions).combine_chunks()
        coded = table.column("qid").combine_chunks().dictionary_encode()
        number, node, weight = coded.indices.to_numpy(), table.column("node").to_numpy(), table.column("weight").to_numpy()
        there = (node >= 0) & (node < size)
        there[there] = degree[node[there]] > 0
        send = (alpha / np.maximum(degree, 1))[:, None]
        for first in range(0, len(coded.dictionary), wide):
            own = there & (number >= first) & (number < first + wide)
            many = min(wide, len(coded.dictionary) - first)
            scores, sent = np.zeros((size, many)), np.empty((size, many))
            room = [np.empty((_wide_rows(wide), many)) for _ in range(2)]
            np.add.at(scores, (node[own], number[own] - first), weight[own])
            places = np.unique(node[own])
            shares = scores[places] / np.maximum(scores[places].sum(0), np.finfo(float).tiny)
            scores[places] = shares
            for _ in range(rounds):
                np.multiply(scores, send, out=sent)
                scores.fill(0.0)
                scores[places] = (1 - alpha) * shares
                for part in _parts(held, parts):
                    _add(part, sent, scores, *room)
            for k in range(many):
                found = np.flatnonzero(scores[:, k] >= least)
                value = scores[found, k]
                if len(found) > best:
                    near = value >= np.partition(value, len(value) - best)[len(value) - best] - 1e-11
                    found, value = found[near], value[near]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array([first + k] * len(found), pa.int64())), pa.array(found), pa.array(value)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, questions, degree, held, parts, open_ = None, [], None, None, 0, []

        def put() -> int:
            src, dst, many = (np.concatenate(x) for x in zip(*open_, strict=True))
            np.add.at(degree, dst, many)
            pickle.dump(_laid(src, dst, many, wide), held, protocol=5)
            open_.clear()
            return 1

        def end() -> Iterator[pa.RecordBatch]:
            n = parts + (put() if open_ else 0)
            yield from ranked(questions, degree, held, n)
            held.close()

        for batch in batches:
            of = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if of[a] != block:
                    if held is not None:
                        yield from end()
                    block, questions, degree, held, parts, open_ = of[a], [], np.zeros(size), tempfile.TemporaryFile(), 0, []
                part = batch.slice(a, b - a)
                n = int((part.column("strip").to_numpy() < 0).sum())
                if n:
                    questions.append(part.slice(0, n).select(["qid", "node", "weight"]))
                for strip in zip(*(part.column(c).slice(n) for c in ("src", "dst", "many")), strict=True):
                    open_.append([np.frombuffer(x.as_py(), "<u4") for x in strip])
                    if len(open_) * STRIP >= PART:
                        parts += put()
        if held is not None:
            yield from end()

    schema = f"qid {seeds.schema['qid'].dataType.simpleString()}, node long, score double"
    return rows.repartition(len(blocks), "block").sortWithinPartitions("block", "strip").mapInArrow(run, schema)


def push_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = DEFAULT.ppr_alpha, epsilon: float = DEFAULT.ppr_epsilon, piece: int = PIECE) -> DataFrame:
    """Personalised PageRank by forward push: ``qid, node, score, bound``.

    Each question holds what its nodes have kept and a residual that is still to be sent.
    Nodes whose residual is over ``epsilon`` times their degree keep the share 1 - ``alpha``
    of it and send the rest along their edges, until no question has such a node.  So work
    stays around a question's seeds, whatever the size of the graph; a hub's edges are sent
    along in pieces, and residuals are added up in each task before they are shuffled.

    The exact score lies between ``score`` and ``score + bound``: each node's residual is at
    most ``epsilon`` times its degree, and ``bound`` is that limit.  Seeds that are not in the
    graph are left out; without any a question has no row.
    """
    pieces, degree = linked(edges, piece)
    links = _told(pieces, degree)
    zero, keep = F.lit(0.0), in_turn("residuals")
    state = keep(_shares(degree, seeds).select("qid", "node", "degree", "pieces", zero.alias("kept"), F.col("share").alias("open")))
    over = F.col("open") > epsilon * F.col("degree")
    while True:
        front = state.where(over)
        rows = _sent(front)
        if not rows:
            break
        sent = _flow(front, links, alpha * F.col("open") / F.col("degree"), rows <= BROADCAST_ROWS).select("qid", "node", "degree", "pieces", zero.alias("kept"), F.col("part").alias("open"))
        stay = state.select("qid", "node", "degree", "pieces", (F.col("kept") + F.when(over, (1 - alpha) * F.col("open")).otherwise(zero)).alias("kept"), F.when(over, zero).otherwise(F.col("open")).alias("open"))
        state = keep(together(stay, sent).groupBy("qid", "node", "degree", "pieces").agg(F.sum("kept").alias("kept"), F.sum("open").alias("open")))
    return state.select("qid", "node", (F.col("kept") + (1 - alpha) * F.col("open")).alias("score"), (epsilon * F.col("degree")).alias("bound"))


def ppr_subgraph(scores: DataFrame, seeds: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``qid, node``: the best nodes with at least the least score, and all seeds of the question."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "node")
    top = scores.where(F.col("score") >= config.ppr_min_score).withColumn("r", F.row_number().over(order)).where(F.col("r") <= config.ppr_nodes)
    return together(top.select("qid", "node"), seeds.select("qid", "node")).distinct()


def ppr_filtered(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``qid, node``: of more than ``config.ppr_nodes`` nodes, the seeds and the best others by PageRank among the nodes.

    ``edges`` has ``src, dst``; PageRank runs on the edges that a question's nodes induce, so
    a node stands for itself in each question.
    """
    own = lambda c: F.struct("qid", F.col(c).alias("node"))
    inside = cut(induced(both_ways(edges), nodes).select("qid", own("src").alias("src"), own("dst").alias("dst")))
    weights = seeds.select("qid", own("node").alias("node"), "weight")
    scores = push_pagerank(inside, weights, config.ppr_alpha, config.ppr_epsilon).select("qid", F.col("node.node").alias("node"), "score")
    first = F.when(F.col("seed"), 0).otherwise(1)
    order = Window.partitionBy("qid").orderBy(first, F.desc(F.round(F.coalesce("score", F.lit(0.0)), 12)), "node")
    rows = nodes.join(scores, ["qid", "node"], "left").join(seeds.select("qid", "node", F.lit(True).alias("seed")), ["qid", "node"], "left")
    rows = rows.withColumn("seed", F.coalesce("seed", F.lit(False)))
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= config.ppr_nodes).select("qid", "node")


def within(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """``qid, node, hops``: everything within ``depth`` edges of a question's start nodes.

    A small front is sent out to the edges, which are read once for each step and never
    shuffled; a large one meets them in pieces.
    """
    pairs = edges.select("src", "dst") if depth == 1 else stored(edges.select("src", "dst"), "pairs")
    large: tuple[DataFrame, DataFrame] | None = None
    seen = cut(starts.select("qid", "node", F.lit(0).alias("hops")))
    for d in range(1, depth + 1):
        front = seen.where((F.col("hops") == d - 1) & F.col("node").isNotNull()).select("qid", "node").distinct()
        if front.count() <= BROADCAST_ROWS:
            met = _turned(pairs.where("src is not null and dst is not null")).join(F.broadcast(front.withColumnRenamed("node", "src")), "src")
        else:
            large = large or linked(pairs)
            met = large[0].join(_pieces(large[1].join(front, "node"), F.lit(None)), ["src", "piece"])
        new = met.select("qid", F.col("dst").alias("node"), F.lit(d).alias("hops"))
        seen = cut(together(seen, new).groupBy("qid", "node").agg(F.min("hops").alias("hops")))
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``qid`` and the edges both of whose ends are among a question's nodes; ``nodes`` is cut.

    Hubs are among the nodes of most questions, and all their edges for each would be many
    times the result.  So from ``FRONT`` nodes on an edge meets the questions of that end
    first which has fewer edges, and no node is that end of many.
    """
    ends = nodes.select("qid", "node")
    if ends.count() <= FRONT:
        of = lambda c: F.broadcast(ends.withColumnRenamed("node", c))
        return edges.join(of("src"), "src").join(of("dst"), ["qid", "dst"])
    pairs = stored(edges, "edges")
    degree = stored(degrees(pairs), "degrees")
    known = looked_up(pairs, "src", degree.withColumnRenamed("degree", "_k1"))
    known = looked_up(known, "dst", degree.withColumnRenamed("degree", "_k2"))
    low = (F.col("_k1") < F.col("_k2")) | ((F.col("_k1") == F.col("_k2")) & (F.col("src") <= F.col("dst")))
    known = known.withColumns({"_own": F.when(low, F.col("src")).otherwise(F.col("dst")), "_other": F.when(low, F.col("dst")).otherwise(F.col("src"))})
    of = lambda c: ends.withColumnRenamed("node", c)
    return known.join(of("_own"), "_own").join(of("_other"), ["qid", "_other"]).select("qid", *edges.columns)


def subgraph(nodes: DataFrame, seeds: DataFrame, names: DataFrame) -> DataFrame:
    """``qid, entity, similarity, rank, is_seed``: seeds with their rank, the other nodes without.

    ``names`` has ``entity_id, entity``; a node without a name is called ``Entity_`` and its id.
    """
    rows = together(nodes.select("qid", "node"), seeds.select("qid", "node")).distinct().join(seeds, ["qid", "node"], "left")
    rows = rows.join(names.withColumnRenamed("entity_id", "node"), "node", "left")
    name = F.coalesce("entity", F.concat(F.lit("Entity_"), F.col("node").cast("string")))
    return rows.select("qid", name.alias("entity"), "similarity", "rank", F.col("rank").isNotNull().alias("is_seed"))


def stated(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, names: DataFrame) -> DataFrame:
    """``qid, subject, relation, object, similarity``: edges among a question's nodes, by name.

    ``edges`` has ``src, dst, relation`` (ids; a missing relation is ``related_to``).  The
    similarity is the better one of the two ends as seeds, 0 if neither is one.
    """
    known = seeds.select("qid", F.col("node"), "similarity")
    end = lambda c, to: known.select("qid", F.col("node").alias(c), F.col("similarity").alias(to))
    rows = induced(edges, nodes).join(end("src", "s1"), ["qid", "src"], "left").join(end("dst", "s2"), ["qid", "dst"], "left")
    called = lambda c, to: names.select(F.col("entity_id").alias(c), F.col("entity").alias(to))
    rows = rows.join(called("src", "subject"), "src").join(called("dst", "object"), "dst")
    best = F.greatest(F.coalesce("s1", F.lit(0.0)), F.coalesce("s2", F.lit(0.0)))
    return rows.select("qid", "subject", F.coalesce("relation", F.lit("related_to")).alias("relation"), "object", best.alias("similarity"))


def sources(stated: DataFrame, triplets: DataFrame) -> DataFrame:
    """Chunks that state a question's triplets, each with its best similarity: ``qid, doc_id, chunk_idx, similarity, pos``.

    ``stated`` has ``qid, subject, relation, object, similarity``; either direction of a
    triplet matches, as the graph has none.
    """
    turned = stated.select("qid", F.col("object").alias("subject"), "relation", F.col("subject").alias("object"), "similarity")
    found = together(stated, turned).distinct().join(triplets, ["subject", "relation", "object"])
    best = found.groupBy("qid", "doc_id", "chunk_idx").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "doc_id", "chunk_idx")
    return best.withColumn("pos", F.row_number().over(order))


def _joined(ends: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, pa.Array]:
    """Edges that join what the given ones join, and no more of them than nodes: each node but one of a component with that one, and loops of those that have nothing else."""
    nodes = pa.chunked_array([x for pair in zip(*ends, strict=True) for x in pair]).combine_chunks().dictionary_encode()
    codes = nodes.indices.to_numpy().astype(np.int64)
    a, b = codes[: len(codes) // 2], codes[len(codes) // 2 :]
    label = np.arange(len(nodes.dictionary))
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            break
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(label, label[label]):
            label = label[label]
    size = np.bincount(label, minlength=len(label))
    out = np.flatnonzero((label != np.arange(len(label))) | (size == 1))
    return nodes.dictionary.take(pa.array(out)), nodes.dictionary.take(pa.array(label[out]))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``src, dst`` of a task to ``_joined`` ones, ``JOINED`` at a time."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0), batch.column(1)))
            n += batch.num_rows
        if n >= JOINED:
            held = [_joined(held)]
            n = len(held[0][0])
            if 2 * n > JOINED:  # they hardly get fewer
                yield pa.RecordBatch.from_arrays(list(held[0]), ["src", "dst"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(list(_joined(held)), ["src", "dst"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of the edges can reach.

    Edges may repeat.  Where they lie, each task first puts others in their place that join the
    same nodes and are no more than these, so what is shuffled grows with the nodes of the tasks.
    Each round contracts the graph: a node goes over to that node, up to two edges away, whose
    hash, drawn anew each round, is smallest.  In expectation at most two thirds of the nodes
    that still have edges are left, whatever they are called and in whatever order, and a star
    is one node at once; so rounds grow with the logarithm of the graph.  Minima are taken in
    each task before they are shuffled, and maps go back to the edges by ``mapped``, so hubs
    gather nowhere.
    """
    pairs = edges.select("src", "dst").where("src is not null and dst is not null")
    pairs = stored(pairs.mapInArrow(_forest, pairs.schema), "forest")
    keep = in_turn("edges")
    rest = keep(pairs.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        drawn = lambda c, n=len(steps): F.struct(F.xxhash64(c, F.lit(n)).alias("drawn"), F.col(c).alias("to"))
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("near"))
        near = stored(least.select("node", F.least("near", drawn("node"))["to"].alias("to")), "near")
        seen = looked_up(rest, "a", near.withColumnRenamed("to", "of_a"))
        seen = seen if near.count() <= BROADCAST_ROWS else stored(seen, "near")
        seen = looked_up(seen, "b", near.withColumnRenamed("to", "of_b"))
        found = near.union(seen.select("a", "of_b")).union(seen.select("b", "of_a")).groupBy("node").agg(F.min(drawn("to")).alias("near"))
        step = stored(found.select("node", F.col("near.to").alias("to")), "step")
        half = mapped(rest, "a", step)
        half = half if step.count() <= BROADCAST_ROWS else stored(half, "edges")
        moved = mapped(half, "b", step).where("a <> b")
        rest = keep(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        steps.append(step)
    alone = pairs.where("src = dst").select(F.col("src").alias("node")).distinct()  # or so it seemed to a task
    if not steps:
        return alone.select("node", F.col("node").alias("component"))
    labels = steps.pop()
    for step in reversed(steps):
        labels = stored(mapped(step, "to", labels), "labels")
    least = stored(together(labels, labels.select(F.col("to").alias("node"), "to")).groupBy(F.col("to").alias("node")).agg(F.min("node").alias("to")), "least")
    named = stored(mapped(labels, "to", least).withColumnRenamed("to", "component"), "components")
    return together(named, alone.join(named, "node", "left_anti").select("node", F.col("node").alias("component")))


def basic_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: size, density, relations, mean degree (a loop counts twice), isolated vertices."""
    v = vertices.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.countDistinct("relation").alias("n_relations"))
    touched = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().agg(F.count("*").alias("touched"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return v.crossJoin(e).crossJoin(touched).select(
        "n_nodes", "n_edges", "n_relations",
        F.when(n > 1, F.round(2.0 * m / (n * (n - 1)), 6)).otherwise(F.lit(0.0)).alias("density"),
        F.when(n > 0, F.round(2.0 * m / n, 2)).otherwise(F.lit(0.0)).alias("avg_degree"), (n - F.col("touched")).alias("n_isolated"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the mean local clustering over all vertices.

    Edges point from the end of lower degree to the other, so no vertex has more than about
    the root of twice the edges going out, and the pairs of those are the candidates.  These
    are most of what is shuffled, so vertices are numbers there, not names.
    """
    named = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    numbers = cut(numbered(named.select(F.col("src").alias("entity")).union(named.select("dst")).distinct()).select(F.col("entity").alias("node"), F.col("entity_id").alias("to")))
    ends = mapped_ends(named, numbers)
    pairs = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    degree = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("k"))
    ranked = pairs.join(degree.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    low = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    out = cut(ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = out.join(out.withColumnRenamed("v", "w"), "u").where("v < w")
    closed = wedges.join(pairs.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    corners = closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    local = degree.join(corners, "node", "left").select(F.when(F.col("k") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(F.lit(0.0)).alias("c"))
    return local.agg(F.sum("c").alias("c")).crossJoin(vertices.agg(F.count("*").alias("n"))).select(F.round(F.try_divide(F.coalesce("c", F.lit(0.0)), F.col("n")), 6).alias("avg_clustering"), F.col("n").alias("n_nodes"))


def path_metrics(edges: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row for the largest component: mean shortest path and diameter, -1 above the node limit.

    The limit is the metric's own rule.  All nodes search at once, ``WORD`` of them in the bits
    of one number: a row says which sources of a word have reached a node, the numbers of its
    neighbours are joined by OR, and what is new is counted.  So a round has a row for each
    node and word, and only the counts of pairs by distance are kept, not the pairs.  A single
    node has paths of 0; a graph without edges has -1.
    """
    labels = cut(components(edges))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    top = sizes.first()
    spark = edges.sparkSession
    if top is None or top["n"] > config.path_nodes or top["n"] == 1:
        value = 0.0 if top is not None and top["n"] == 1 else -1.0
        return spark.range(1).select(F.lit(value).alias("avg_path"), F.lit(int(value)).cast("long").alias("diameter"), F.lit(top["n"] if top else 0).cast("long").alias("n_nodes"))
    inside = labels.where(F.col("component") == top["component"]).select(F.col("node").alias("entity"))
    numbers = cut(numbered(inside).select(F.col("entity_id").cast("int").alias("to"), F.col("entity").alias("node")))
    both = both_ways(edges.select("src", "dst")).where("src <> dst").join(inside.withColumnRenamed("entity", "src"), "src", "left_semi")
    near = stored(mapped_ends(both, numbers), "near")
    keep = in_turn("paths")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("to") % WORD).cast("int"))
    state = keep(numbers.select(F.col("to").alias("node"), F.floor(F.col("to") / WORD).cast("int").alias("word"), bit.alias("seen"), bit.alias("new")))
    pairs, steps, d = 0, 0, 0
    while True:
        front = state.where("new <> 0").select(F.col("node").alias("a"), "word", "new")
        step = front.join(near, "a").groupBy(F.col("b").alias("node"), "word").agg(F.bit_or("new").alias("bits"))
        met = step.join(state.select("node", "word", "seen"), ["node", "word"], "full")
        seen, bits = F.coalesce("seen", F.lit(0).cast("long")), F.coalesce("bits", F.lit(0).cast("long"))
        state = keep(met.select("node", "word", seen.bitwiseOR(bits).alias("seen"), bits.bitwiseAND(F.bitwise_not(seen)).alias("new")))
        n = state.agg(F.sum(F.bit_count("new"))).first()[0]
        if not n:
            break
        d += 1
        pairs, steps = pairs + n, steps + d * n
    mean = F.round(F.lit(float(steps)) / F.lit(float(pairs)), 4)
    return spark.range(1).select(mean.alias("avg_path"), F.lit(d).cast("long").alias("diameter"), F.lit(top["n"]).cast("long").alias("n_nodes"))


def mapped_ends(both: DataFrame, numbers: DataFrame) -> DataFrame:
    """``a, b``: the numbers of ``src`` and ``dst``, by ``numbers`` (``node, to``), each pair once."""
    ends = looked_up(cut(both.select("src", "dst").distinct()), "src", numbers).withColumnRenamed("to", "a")
    return looked_up(cut(ends), "dst", numbers).select("a", F.col("to").alias("b"))


def top_relations(triplets: DataFrame, n: int = 5) -> DataFrame:
    return triplets.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(n)
