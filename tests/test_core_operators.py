"""Operators on rows written out, and against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.config import Config
from lodestar.functions import parsing, prompts, text, vectors
from lodestar.operators import evaluate, graph, index, merge, search, strategies, validate
from lodestar.sources import readers, writers
from lodestar.streaming import ingest


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n", [0, 1, 412, 413, 512, 513, 924, 925])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    found = text.chunks(spark.createDataFrame([(1, " ".join(words)), (2, None)], "doc_id long, text string")).orderBy("chunk_idx").collect()
    assert [r["text"] for r in found] == [" ".join(words[s : s + 512]) for s in range(0, n, 412)]


def test_budget_is_the_prefix_rule(spark):
    rnd = random.Random(1)
    rows = [(q, p, "x" * rnd.randrange(60)) for q in range(20) for p in range(rnd.randrange(12))]
    config = Config(context_tokens=40)
    found = search.token_budget(spark.createDataFrame(rows, "qid int, pos int, text string"), "qid", config)
    want = []
    for q in range(20):
        used = 0
        for _, p, t in (r for r in rows if r[0] == q):
            used += len(t) // 4
            if used > 40:
                break
            want.append((q, p))
    assert sorted((r["qid"], r["pos"]) for r in found.collect()) == want


def test_parsing(spark):
    fenced = '```json\n[["a","b","c"],["a","b"],["x","y","z","w"]]\n```'
    assert one(spark, parsing.triplets(F.col("c")), c=fenced) == [["a", "b", "c"]]
    assert one(spark, parsing.triplets(F.col("c")), c='"abc"') == [] and one(spark, parsing.triplets(F.col("c")), c="nothing") == []
    assert one(spark, parsing.judge_label(F.col("c")), c='{"label": "Correct"}') == "correct"
    assert one(spark, parsing.judge_label(F.col("c")), c="?") == "incomplete"
    assert one(spark, parsing.evaluation(F.col("c")), c="{")["sufficient"] is False
    assert one(spark, parsing.question_type(F.col("c")), c="so: full_context, or distributed") == "distributed"


@pytest.mark.parametrize(("answer", "refusal"), [(None, True), ("", True), ("I Cannot Answer it", True), ("yes", False)])
def test_refusals(spark, answer, refusal):
    assert spark.createDataFrame([(answer,)], "a string").select(text.is_refusal(F.col("a")).alias("x")).first()["x"] is refusal


def test_sentences_and_ids(spark):
    assert one(spark, text.sentences(F.col("t")), t=" A b.  C d! E?  ") == ["A b.", "C d!", "E?"]
    assert one(spark, text.query_id(F.lit("multi_hop"), F.lit(7))) == "multi_hop_0007"
    assert one(spark, text.query_id(F.lit("x"), F.lit(12345))) == "x_12345"


def test_prompts(spark):
    made = one(spark, prompts.sufficient(F.col("q"), F.lit("a"), F.col("c")), q="why", c="z" * 3000)
    assert [m["role"] for m in made] == ["system", "user"] and made[1]["content"].count("z") == prompts.CONTEXT_CHARS
    assert "Hops: 1" in one(spark, prompts.two_hop(F.lit("a"), F.lit("b"), F.lit("e")))[1]["content"]


def test_vectors(spark):
    same = one(spark, vectors.normalised(F.array(F.lit(3.0), F.lit(4.0))))
    assert same == [0.6, 0.8] and one(spark, vectors.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vectors.similarity(F.array(F.lit(0.0)), F.array(F.lit(2.0)), "euclidean")) == -2.0
    frame = spark.createDataFrame([(1, "a b b"), (2, ""), (3, None)], "k int, t string")
    array = {r["k"]: r["v"] for r in frame.select("k", vectors.hashed(F.col("t")).alias("v")).collect()}
    rows = {r["k"]: r["embedding"] for r in vectors.embedded(frame, "k", "t").collect()}
    assert array[1] == pytest.approx(rows[1]) and sum(rows[2]) == sum(rows[3]) == 0 and len(rows[3]) == 64


def test_blocks_do_not_change_the_search(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [1.0] * 8), (101, [1.0] * 8)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    queries = items.where("item_id % 7 = 0 or item_id > 99").withColumnRenamed("item_id", "qid")
    for skip in (False, True):
        found = search.block_top_k(queries, items, 4, block=9, skip_self=skip).collect()
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        want = []
        for q, v in rows:
            if q % 7 == 0 or q > 99:
                best = sorted(((-round(dot(v, w) / (dot(v, v) * dot(w, w)) ** 0.5, 9), i) for i, w in rows if not (skip and i == q)))[:4]
                want += [(q, i, k + 1) for k, (_, i) in enumerate(best)]
        assert sorted((r["qid"], r["item_id"], r["rank"]) for r in found) == sorted(want)


def test_thresholds(spark):
    found = spark.createDataFrame([(1, 0.3), (1, 0.5), (1, 0.7)], "qid int, similarity double")
    assert [r["similarity"] for r in search.thresholded(found, "intent").collect()] == [0.5, 0.7]
    assert [r["similarity"] for r in search.thresholded(found, "compat").collect()] == [0.3, 0.5]


def test_interleave_is_the_loop(spark):
    rnd = random.Random(2)
    of = lambda: [(q, p, rnd.choice([None, 1, 2, 3]), 0, rnd.choice(["", "a", "b", "c"])) for q in range(15) for p in range(rnd.randrange(1, 6))]
    a, b = of(), of()
    schema = "qid int, pos int, doc_id long, chunk_idx int, text string"
    found = merge.interleave(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    want = []
    for q in range(15):
        left, right, seen = [r for r in a if r[0] == q], [r for r in b if r[0] == q], set()
        for i in range(max(len(left), len(right))):
            for k, rows in enumerate((left, right)):
                if i < len(rows) and rows[i][4]:
                    key = rows[i][2:4] if rows[i][2] is not None else rows[i][4]
                    if key not in seen:
                        seen.add(key)
                        want.append((q, 2 * i + k, *rows[i][2:]))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_components_and_paths(spark):
    rnd = random.Random(5)
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [(f"b{rnd.randrange(9)}", f"b{rnd.randrange(9)}") for _ in range(12)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert {found[f"a{i}"] for i in range(41)} == {"a0"} and all(found[x] == found[y] for x, y in pairs)
    line = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    row = graph.path_metrics(line).first()
    assert (row["avg_path"], row["diameter"], row["n_nodes"]) == (1.6667, 3, 4)
    assert graph.path_metrics(line, Config(path_nodes=3)).first()["avg_path"] == -1.0
    assert graph.path_metrics(line.limit(0)).first()["n_nodes"] == 0


def test_pagerank_converges_and_keeps_its_mass(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a", 2.0), (1, "zz", 1.0), (2, "d", 1.0)], "qid int, node string, weight double")
    got = {(r["qid"], r["node"]): r["score"] for r in graph.pagerank(edges, seeds, 100, tolerance=1e-6).collect()}
    near = {"a": "bc", "b": "ac", "c": "abd", "d": "c"}
    for q, start in ((1, "a"), (2, "d")):
        x = {n: float(n == start) for n in near}
        for _ in range(200):
            x = {n: 0.15 * (n == start) + 0.85 * sum(x[m] / len(near[m]) for m in near[n]) for n in near}
        assert {n: got[q, n] for n in near} == pytest.approx(x, abs=1e-5)


def test_numbers_follow_the_names(spark):
    names = [f"n{i:03d}" for i in random.Random(1).sample(range(900), 300)]
    found = graph.numbered(spark.createDataFrame([(n,) for n in names], "entity string")).orderBy("entity_id").collect()
    assert [(r["entity_id"], r["entity"]) for r in found] == list(enumerate(sorted(names)))


def test_collapsed_edges_and_sources(spark):
    rows = [("a", "r1", "b", 1, 0, "t", 0), ("b", "r2", "a", 2, 0, "t", 0), ("a", "r1", "a", 3, 0, "t", 0), (" ", "r", "b", 4, 0, "t", 0), (None, "r", "b", 5, 0, "t", 0)]
    stated = spark.createDataFrame(rows, schemas.TRIPLETS)
    kept = graph.valid(stated)
    assert kept.count() == 3
    assert sorted(map(tuple, graph.collapsed(kept, ["doc_id"]).collect())) == [("a", "a", "r1", 3), ("a", "b", "r2", 2)]
    asked = spark.createDataFrame([(7, "b", "r1", "a", 0.5)], "qid int, subject string, relation string, object string, similarity double")
    assert [(r["doc_id"], r["similarity"]) for r in graph.sources(asked, kept).collect()] == [(1, 0.5)]


def test_chains_have_different_documents(spark):
    rnd = random.Random(4)
    rows = list({(f"e{rnd.randrange(6)}", rnd.randrange(12), 0) for _ in range(40)})
    found = index.chains(spark.createDataFrame(rows, "entity string, doc_id long, chunk_idx int"), 3).collect()
    held = {(e, d) for e, d, _ in rows}
    for r in found:
        assert len({r["doc_1"], r["doc_2"], r["doc_3"]}) == 3
        assert {(r["bridge_1"], r["doc_1"]), (r["bridge_1"], r["doc_2"]), (r["bridge_2"], r["doc_2"]), (r["bridge_2"], r["doc_3"])} <= held
    assert len({frozenset((r["doc_1"], r["doc_2"], r["doc_3"])) for r in found}) == len(found) > 0


def test_scores(spark):
    rows = [("1", "a b c", "A b d. x", ["a b d"]), ("2", "a", "I cannot answer", ["a"]), ("3", "a", "a", [])]
    pairs = spark.createDataFrame(rows, "qid string, reference string, prediction string, retrieved array<string>")
    got = {r["qid"]: r for r in evaluate.all_metrics(pairs).collect()}
    assert got["2"]["semantic_f1"] == got["2"]["coverage"] == 0 and got["2"]["faithfulness_hard"] is None and got["2"]["llm_label"] == "incomplete"
    assert got["3"]["semantic_f1"] == 1 and got["3"]["faithfulness_soft"] is None and got["3"]["llm_label"] == "correct"
    assert 0 < got["1"]["faithfulness_soft"] <= 1
    assert evaluate.summary(evaluate.all_metrics(pairs)).first()["n"] == 3


def test_scores_without_retrieval_and_spaces_with_zeros_or_few(spark):
    rows = [("1", "a", "a b.", []), ("2", "a", "a b.", None), ("3", "a", "I cannot answer", []), ("4", "a", "a b.", ["a b."])]
    pairs = spark.createDataFrame(rows, "qid string, reference string, prediction string, retrieved array<string>")
    got = {r["qid"]: (r["faithfulness_hard"], r["faithfulness_soft"]) for r in evaluate.faithfulness(pairs, split=True).collect()}
    assert got["1"] == got["2"] == (0.0, 0.0) and got["3"] == (None, None) and got["4"][0] == 1.0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "item_id long, embedding array<double>")
    assert evaluate.centroid_distances(some).first()["avg_centroid_distance"] == pytest.approx(1 - 0.5**0.5, abs=1e-6)
    assert tuple(evaluate.hubness(some, 3).first()) == (None, 0, 0.0)
    assert tuple(evaluate.hubness(some, 2).first())[1:] == (2, 2.0)
    report = evaluate.semantic_report(some).first()
    assert report["semantic_interference"]["hubness_score"] is None and report["semantic_interference"]["top_hubs"] == []
    assert evaluate.rank_hubs(spark.createDataFrame([(1, 0), (2, 3)], "item_id long, occurrence long")).count() == 1


def test_equal_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(12)], "item_id long, embedding array<double>")
    assert evaluate.two_nn(same).first()["intrinsic_dimension"] is None
    assert evaluate.two_nn(same.limit(2)).first()["valid_samples"] == 0


def test_validation(spark):
    leaks = validate.leaks(spark.createDataFrame([(1, "who is Ann", " ann ", True), (2, "x", "", False), (3, "x", "y", False)], "id int, question string, answer string, llm_knows boolean"))
    assert [r["leak_type"] for r in leaks.orderBy("id").collect()] == ["both", "exact_match", "none"]
    seen = validate.shortcuts(spark.createDataFrame([(1, "z", "a z"), (1, "z", "b"), (2, "q", "b")], "id int, answer string, text string"))
    assert {r["id"]: r["passed"] for r in seen.collect()} == {1: False, 2: True}


def test_files(spark, tmp_path):
    lines = [{"id": 1, "title": "T", "context": "c one"}, {"id": 1, "text": "later"}, {"doc_id": 2, "content": "two"}, {"id": 3}]
    (tmp_path / "lines.json").write_text("\n\n".join(map(json.dumps, lines)))
    (tmp_path / "array.json").write_text(json.dumps(lines))
    for name in ("lines.json", "array.json"):
        assert {r["doc_id"]: r["text"] for r in readers.read_corpus(spark, str(tmp_path / name)).collect()} == {1: "later", 2: "two"}
    (tmp_path / "triplets.json").write_text(json.dumps({"a|||r|||b": [{"doc_id": 1, "chunk_idx": 0, "source_text": "t"}, {"doc_id": 2}], "a|||b": [{"doc_id": 3}]}))
    assert sorted(r["doc_id"] for r in readers.read_triplets(spark, str(tmp_path / "triplets.json")).collect()) == [1, 2]
    (tmp_path / "types.json").write_text(json.dumps({"1": {"s": "distributed"}}))
    assert readers.read_types(spark, str(tmp_path / "types.json")).collect()[0]["type"] == "distributed"
    (tmp_path / "answers.json").write_text('{"id": "1", "rag_answer": "", "llm_answer": "x"}\n{"id": "1", "rag_answer": "y", "rounds": 2}\n{"id": "2", "rag_answer": null}')
    assert {r["qid"]: (r["answer"], r["rounds"]) for r in readers.read_answers(spark, str(tmp_path / "answers.json")).collect()} == {"1": ("y", 2), "2": ("", None)}
    shapes = [
        ({"id": "1", "chunks": [{"text": "a"}, {"doc_id": 3}]}, ["a", ""]),
        ({"id": "2", "history": [{"round": 0, "answer": "x", "context": "no"}, {"round": 1, "answer": "b", "context": "last"}]}, ["last"]),
        ({"id": "3"}, []),
        ({"id": "4", "source_sentences": ["p", "q"], "chunks": [{"text": "a"}]}, ["p", "q"]),
        ({"id": "5", "retrieved_chunks": [{"doc_id": 7, "chunk_idx": 1, "text": "[{"}]}, ["[{"]),
        ({"id": "6", "history": [{"round": 1, "answer": "b"}]}, []),
        ({"id": "7", "chunks": []}, []),
        ({"id": "8", "chunks": [{"text": "old"}]}, None),
        ({"id": "8", "chunks": ["new"]}, ["new"]),
    ]
    (tmp_path / "found.json").write_text("\n".join(json.dumps(r) for r, _ in shapes))
    assert {r["qid"]: r["retrieved"] for r in readers.read_retrievals(spark, str(tmp_path / "found.json")).collect()} == {r["id"]: want for r, want in shapes if want is not None}
    listed = sorted(map(tuple, readers.read_passages(spark, str(tmp_path / "found.json"), "chunks").collect()))
    assert listed == [("1", 0, None, None, "a"), ("1", 1, 3, None, ""), ("4", 0, None, None, "a"), ("8", 0, None, None, "new")]
    assert writers.place("/r/", "answers", "naive", "m", "d") == "/r/answers/naive/m/d"


def test_resuming(spark):
    asked = spark.createDataFrame([(0, "q"), (1, "q"), (2, ""), (None, "q"), (3, "q")], "qid long, question string")
    done = spark.createDataFrame([(1, "a"), (3, None)], "qid long, answer string")
    assert sorted(r["qid"] for r in merge.unanswered(asked, done).collect()) == [0, 3]


def test_stream(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    reply = lambda q: q.select("qid", F.upper("question").alias("answer"))
    for k in range(2):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"id": str(i), "question": f"q{i}"}) for i in (0, k, 5)))
        ingest.answer_stream(ingest.questions(spark, str(folder)), reply, str(out), str(tmp_path / "state")).awaitTermination()
    assert sorted((r["qid"], r["answer"]) for r in readers.read_answers(spark, str(out)).collect()) == [("0", "Q0"), ("1", "Q1"), ("5", "Q5")]
    assert spark.read.json(str(out)).count() == 3


def small_world(spark):
    texts = [(1, 0, "Anna lives near Bert. Bert sleeps."), (2, 0, "Bert knows Carla."), (3, 0, "Carla met Doris and Emilia."), (4, 0, "Xaver alone with Ypsilon.")]
    chunks = spark.createDataFrame(texts, "doc_id long, chunk_idx int, text string")
    return chunks, strategies.graph_of(graph.extract(chunks))


def test_graph_search_follows_edges(spark):
    chunks, world = small_world(spark)
    asked = spark.createDataFrame([("1", "Where is Anna"), ("2", "no names of them"), ("3", None)], "qid string, question string")
    found = strategies.graph_search(asked, world)
    nodes = {(r["qid"], r["entity"]): r["is_seed"] for r in found.nodes.collect()}
    assert nodes["1", "Anna"] and {e for q, e in nodes if q == "1"} >= {"Anna", "Bert", "Carla", "Doris", "Emilia"} and not any(q == "3" for q, _ in nodes)
    passages = strategies.source_passages(found.sources, chunks).where("qid = '1'").orderBy("pos").collect()
    assert passages[0]["doc_id"] == 1 and {r["doc_id"] for r in passages} == {1, 2, 3}  # 3 is two edges away
    assert [r["similarity"] for r in passages] == pytest.approx([1 - 0.01 * i for i in range(len(passages))])
    assert "Anna" in strategies.answered(asked, strategies.source_passages(found.sources, chunks), "graph").where("qid = '1'").first()["answer"]


def test_converged_pagerank_of_questions(spark):
    """All questions at once against each by itself, with names that occur in several."""
    rnd = random.Random(8)
    pairs = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(60)}
    both = pairs | {(b, a) for a, b in pairs}
    around = {n: [b for a, b in both if a == n] for n in {a for a, _ in both}}
    start = {q: {n: 1.0 + q for n in rnd.sample(sorted(around), 3)} for q in range(4)}
    seeds = spark.createDataFrame([(q, n, w) for q, ns in start.items() for n, w in ns.items()], "qid int, node int, weight double")
    got = {(r["qid"], r["node"]): r["score"] for r in graph.pagerank(spark.createDataFrame(list(pairs), "src int, dst int"), seeds, 100, tolerance=1e-7).collect()}
    for q, ns in start.items():
        x = {n: ns.get(n, 0) / sum(ns.values()) for n in around}
        for _ in range(150):
            x = {n: 0.15 * ns.get(n, 0) / sum(ns.values()) + 0.85 * sum(x[m] / len(around[m]) for m in around[n]) for n in around}
        assert {n: got.get((q, n), 0.0) for n in around} == pytest.approx(x, abs=1e-4)


def test_filtering_a_subgraph_keeps_seeds_first(spark):
    pairs = [(0, i) for i in range(1, 8)] + [(7, 8), (8, 9), (9, 99)]  # 99 is not among the nodes
    edges = spark.createDataFrame(pairs, "src int, dst int")
    around = {n: [b for p in pairs[:-1] for a, b in (p, p[::-1]) if a == n] for n in range(10)}
    x = {n: float(n == 9) for n in around}
    for _ in range(100):
        x = {n: 0.15 * (n == 9) + 0.85 * sum(x[m] / len(around[m]) for m in around[n]) for n in around}
    best = sorted(set(around) - {9}, key=lambda n: -x[n])[:2]
    nodes = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 1), (2, 2)], "qid int, node int")
    seeds = spark.createDataFrame([(1, 9, 1.0), (2, 1, 1.0)], "qid int, node int, weight double")
    kept = sorted((r["qid"], r["node"]) for r in graph.ppr_filtered(edges, nodes, seeds, Config(ppr_nodes=3)).collect())
    assert kept == sorted((1, n) for n in (9, *best)) + [(2, 1), (2, 2)]


def test_iterative_answers(spark):
    chunks, world = small_world(spark)
    asked = spark.createDataFrame([(1, "Where is Anna"), (2, "")], "qid long, question string")
    made, log = strategies.iterative(asked, lambda q: strategies.graph_passages(q, world, chunks))
    found = {r["qid"]: r for r in made.collect()}
    assert found[1]["answer"] == "Anna lives near Bert." and found[1]["rounds"] == 1
    assert "cannot answer" in found[2]["answer"]
    assert [r["round"] for r in log.where("qid = 1").orderBy("round").collect()] == [0, 1]


def test_a_sub_question_of_any_earlier_round_ends_the_work(spark):
    """The context names Aaaa, then Bbbb, then Aaaa again; the answer is always a refusal."""
    from dataclasses import replace

    from lodestar.providers import RULES

    names = ["Aaaa", "Bbbb"]
    asked = spark.createDataFrame([(1, "why")], "qid long, question string")
    seen = []

    def retrieve(q):
        seen.append(q.first()["question"])
        return spark.createDataFrame([(1, 0, len(seen), 0, names[(len(seen) - 1) % 2])], "qid long, pos int, doc_id long, chunk_idx int, text string")

    last = lambda c: F.slice(F.regexp_extract_all(c, F.lit("[A-Z][a-z]{3,}"), F.lit(0)), -1, 1)
    never = replace(RULES, answer=lambda q, c: F.lit(Config().refusal), extract_entities=lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(last(c)))
    made, log = strategies.iterative(asked, retrieve, Config(iterative_rounds=5), never)
    assert seen == ["why", "why Aaaa", "why Bbbb"] and made.first()["rounds"] == 3 and log.count() == 4


def test_long_lists_have_the_same_budget(spark):
    rnd = random.Random(6)
    rows = [(q, p, "x" * rnd.randrange(40)) for q in range(3) for p in range(400)]
    frame = spark.createDataFrame(rows, "qid int, pos int, text string")
    for most in (0, 150, 100_000):
        plain, wide = (sorted(map(tuple, search.token_budget(frame, "qid", Config(context_tokens=most), wide=w).select("qid", "pos", "running_tokens").collect())) for w in (False, True))
        assert plain == wide


def test_records_old_and_new(spark):
    rows = [(5, '["a", "r", "b"]'), (6, '{"triplet": ["c", "r", "d"], "doc_id": 9, "chunk_idx": 2, "source_text": "t"}'), (7, '["a", "b"]'), (8, "oops")]
    got = sorted(map(tuple, readers.from_records(spark.createDataFrame(rows, "doc_id long, content string")).collect()))
    assert got == [(5, "a", "r", "b", 5, 0, ""), (6, "c", "r", "d", 9, 2, "t")]


def test_questions_until_there_are_enough(spark):
    from lodestar.operators import generate

    pool, tries = spark.range(100), []

    def odd(tried):
        tries.append(tried.count())
        return tried.where("id % 10 = 1")

    got = [r["id"] for r in generate.until(pool, 3, odd, ["id"], batch=15).collect()]
    assert got == [1, 11, 21] and tries == [15, 15]
    assert generate.until(pool, 50, odd, ["id"], batch=15).count() == 10 and generate.until(pool.limit(0), 5, odd, ["id"]).count() == 0


def test_generated_questions(spark):
    from lodestar.operators import generate

    texts = [(d, 0, f"Bridge{'abcdefgh'[d % 3]} is known here as entry {d}. " + f"Person{'abcdefghijklmnop'[d]}x lives by the river with Commonname. " * 4) for d in range(12)]
    chunks = spark.createDataFrame(texts, "doc_id long, chunk_idx int, text string")
    held = index.entity_chunks(graph.valid(graph.extract(chunks)))
    made = generate.generated(generate.samples(held, chunks, 3, 2), chunks, 3, 5, 2, {"single_hop": 7}).collect()
    kinds = sorted((r["type"], r["id"]) for r in made)
    assert [k for k in kinds if k[0] == "single_hop"] == [("single_hop", f"single_hop_{i:04d}") for i in (7, 8, 9)]
    assert all(r["num_hops"] == len(r["doc_ids"]) == len(r["facts"]) for r in made if r["type"].startswith("multi_hop"))
    assert {r["type"] for r in made} >= {"single_hop", "summary"} and all(r["answer"] for r in made)


def test_reports(spark):
    empty = evaluate.structure_report(spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string, relation string")).first()
    assert empty["status"] == "failed" and empty["basic_stats"]["n_nodes"] == 0 and empty["connectivity"]["largest"] == 0 and empty["path_metrics"]["avg_path"] == -1.0
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("a", "c", "s")], "src string, dst string, relation string")
    made = evaluate.structure_report(nodes, edges).first()
    assert made["connectivity"].asDict() == {"n_components": 3, "largest": 3, "largest_ratio": 0.6, "connected": False}
    assert made["basic_stats"]["n_isolated"] == 2 and made["avg_clustering"] == 0.6 and [tuple(t) for t in made["relation_metrics"]["top"]] == [("r", 2), ("s", 1)]
    none = evaluate.semantic_report(spark.createDataFrame([], "item_id long, embedding array<double>")).first()
    assert none["status"] == "failed" and none["total_embeddings"] == 0 and none["semantic_complexity"] is None
    rnd = random.Random(2)
    some = evaluate.semantic_report(spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(40)], "item_id long, embedding array<double>"), 3).first()
    assert some["status"] == "success" and some["embedding_dimension"] == 6 and len(some["semantic_interference"]["top_hubs"]) == 5


def test_winners(spark):
    rows = [(1, "x", "correct"), (1, "y", "incomplete"), (2, "x", "incorrect"), (2, "y", "incomplete"), (3, "x", "correct"), (3, "y", "correct"), (4, "x", "correct")]
    got = {r["qid"]: r["winner"] for r in evaluate.compared(spark.createDataFrame(rows, "qid int, method string, llm_label string"), "x", "y").collect()}
    assert got == {1: "x", 2: "y", 3: None}


def test_stored_tables_can_be_cleared(spark):
    import os

    from lodestar import storage

    storage.clear(spark)
    kept = storage.stored(spark.range(5), "t")
    path = storage.WRITTEN[-1].removeprefix("file:")
    assert kept.count() == 5 and os.path.exists(path)
    assert storage.clear(spark) == 1 and not os.path.exists(path) and storage.clear(spark) == 0
