"""What a task holds does not grow with the table."""

import random
import uuid

import pyarrow as pa
from lodestar import storage
from lodestar.operators import ends, graph, index
from lodestar.sources import log, store
from pyspark.sql import functions as F


def test_many_rows_are_dealt_into_more_parts(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    rows = spark.range(5000).selectExpr("id % 500 as subject", "id % 7 as object", "id % 50 as doc_id")
    assert storage.dealt(rows, 400, "doc_id") is rows
    parts = storage.dealt(rows, 5000, "subject").rdd.glom().map(len).collect()
    assert len(parts) == 50 and max(parts) < 500
    got = {r["doc_id"]: r["n_entities"] for r in graph.entities_per_doc(rows.select("doc_id", *(F.col(c).cast("string") for c in ("subject", "object")))).collect()}
    want = {}
    for i in range(5000):
        want.setdefault(i % 50, set()).update((i % 500, i % 7))
    assert got == {k: len(v) for k, v in want.items()}


def test_tasks_join_edges_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "JOINED", 200)
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(40)] * 30 + [("alone", "alone"), ("n0", None)]
    table = pa.table({"src": [a for a, _ in edges], "dst": [b for _, b in edges]}).slice(0, 1200)
    kept = sum(b.num_rows for b in graph._forest(iter(table.to_batches(50))))
    assert kept < 60
    root = {x: x for e in edges for x in e if x}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {x: find(x) for e in edges[:-1] for x in e}
    rows = spark.createDataFrame(edges, "src string, dst string").repartition(5)
    got = {r["node"]: r["component"] for r in graph.components(rows).collect()}
    assert got == want


def test_stores_of_many_rows_have_more_buckets(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "BUCKET_ROWS", 100)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    store.append(spark.range(1000).selectExpr("id", "1 as n"), path, "id", 4)
    assert log.version(spark, path).layout["buckets"] == 16
    for n in (2, 3, 4, 5):
        store.append(spark.range(1000, 2000).selectExpr("id", f"{n} as n"), path, "id")
    assert store.compact_when_many(spark, path) and log.version(spark, path).layout["buckets"] == 64
    assert store.last(spark, path).groupBy("n").count().orderBy("n").collect() == [(1, 1000), (5, 1000)]


def test_chains_agree_with_plain_python(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    rnd = random.Random(3)
    rows = sorted({(rnd.choice("abcdefghij"), rnd.randrange(25), rnd.randrange(2)) for _ in range(120)})
    draws = {}
    for e, d, c in rows:
        made = hashlib.md5(f"42|{e}|{d}|{c}".encode()).hexdigest()
        draws[e, d] = min(made, draws.get((e, d), made))
    want = {}
    for start in sorted({d for _, d, _ in rows}):
        chain, last = [start], start
        for _ in range(3):
            near = [(v, e, d) for (e, d), v in draws.items() if d not in chain and (e, last) in draws]
            if not near:
                break
            _, e, last = min(near)
            chain += [e, last]
        if len(chain) == 7:
            want.setdefault(tuple(sorted(chain[::2])), tuple(chain))
    table = storage.cut(spark.createDataFrame(rows, "entity string, doc_id long, chunk_idx int"))
    assert sorted(tuple(r) for r in index.chains(table, 4).collect()) == sorted(want.values())


def test_one_long_text_is_not_copied_for_each_sentence(spark, monkeypatch):
    """Rows at the sentences' ends hold two words each, and tokens of any length are told apart."""
    long = "x" * 70 + "."
    text = " ".join(f"Dr. Who came by approx. {i} times {long} Then he left." for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, None), (3, " dr. \t who. ")], "doc_id long, text string")
    counts = {r["word"]: (r["n_ended"], r["n_open"]) for r in ends.word_counts(docs).collect()}
    assert counts["dr"] == (401, 0) and counts["then"] == (0, 400) and "x" * 70 not in counts
    learned = ends.Learned(spark.createDataFrame([("dr", 1, 0, 1.0), ("approx", 1, 0, 1.0)], "word string, n_ended long, n_open long, score double"), spark.createDataFrame([], "word string"))
    seen, plain = [], ends.looked_up
    monkeypatch.setattr(ends, "looked_up", lambda rows, *rest: seen.append(rows) or plain(rows, *rest))
    got = {r["doc_id"]: r["sentences"] for r in ends.with_sentences(docs, learned).collect()}
    assert got[2] == [] and got[3] == ["dr. \t who."] and len(got[1]) == 800 and got[1][0] == f"Dr. Who came by approx. 0 times {long}"
    told = seen[0]  # the ends of sentences, before abbreviations are looked up
    assert told.count() == 1202 and " AS all#" not in told._jdf.queryExecution().optimizedPlan().toString()
