"""Calls of models that fail, hang and answer badly, and tokens matched by vectors."""

import asyncio
import json
import time
import uuid
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import jobs
from lodestar.functions.calls import Limits, called
from lodestar.functions.vectors import one_hot
from lodestar.operators import evaluate, graph
from lodestar.providers import RULES
from lodestar.sources import readers
from lodestar.storage import cut


def test_every_row_ends_with_a_reply_or_in_the_queue(spark):
    tries = {}

    async def model(prompt):
        n = tries[prompt] = tries.get(prompt, 0) + 1
        kind, need = prompt.split()
        if n > int(need):
            return f"[{kind}]"
        if kind == "hangs":
            await asyncio.sleep(30)
        if kind == "raises":
            raise ValueError("no")
        return {"bad": "?", "none": None}[kind]

    kinds = [f"{k} {n}" for k in ("hangs", "raises", "bad", "none") for n in range(4)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)] + [(99, None)], "reply long, prompt string").withColumnRenamed("reply", "id").withColumn("error", F.lit(1))
    start = time.time()
    got = {r["id"]: r for r in called(rows, "prompt", model, Limits(4, 2, 3, 0.2, 0.01), lambda r: r.startswith("[")).collect()}
    assert time.time() - start < 25 and len(got) == 17
    for i, k in enumerate(kinds):
        kind, need = k.split()
        if int(need) < 3:
            assert tuple(got[i])[2:] == (f"[{kind}]", "done", int(need) + 1, None)
        else:
            error = {"hangs": "timeout", "raises": "ValueError: no", "bad": "bad reply", "none": "no reply"}[kind]
            assert tuple(got[i])[2:] == (None, "failed", 3, error)
    assert tuple(got[99])[2:] == (None, "failed", 0, "no prompt")
    assert called(rows.limit(0), "prompt", model).count() == 0


@pytest.mark.parametrize("plain", [False, True])
def test_no_more_calls_at_once_than_allowed(spark, tmp_path, plain):
    """Each call tells when it began and ended."""

    def note(begin):
        (tmp_path / uuid.uuid4().hex).write_text(json.dumps([begin, time.time()]))

    async def model(prompt):
        begin = time.time()
        await asyncio.sleep(0.02)
        note(begin)
        return "x"

    def plain_model(prompt):
        begin = time.time()
        time.sleep(0.02)
        note(begin)
        return "x"

    rows = spark.range(200, numPartitions=16).select("id", F.col("id").cast("string").alias("prompt"))
    assert called(rows, "prompt", plain_model if plain else model, Limits(concurrency=3, tasks=2)).where("status = 'done'").count() == 200
    spans = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    marks = sorted([(b, 1) for b, _ in spans] + [(e, -1) for _, e in spans])
    assert len(spans) == 200 and 3 <= max(np.cumsum([m for _, m in marks])) <= 6


def test_pauses_double(spark):
    async def model(prompt):
        return None

    start = time.time()
    row = called(spark.createDataFrame([("a",)], "prompt string"), "prompt", model, Limits(attempts=4, pause=0.2)).first()
    assert time.time() - start > 0.2 + 0.4 + 0.8 and row["attempts"] == 4


def test_chunks_that_failed_are_extracted_by_the_next_run(spark, tmp_path):
    corpus, out = tmp_path / "corpus.jsonl", str(tmp_path / "out")
    corpus.write_text("\n".join(json.dumps({"id": i, "text": f"Alpha{'x' * i} meets Berta number {i}"}) for i in range(6)))

    def model(works):
        async def reply(prompt):
            text = json.loads(prompt)[-1]["content"]
            return json.dumps([["a", "meets", text[-1]]]) if works or text[-1] in "024" else "broken"

        return replace(RULES, extract_triplets=graph.extractor(reply, Limits(pause=0.0)))

    jobs.chunk(spark, str(corpus), out)
    jobs.extract(spark, out, providers=model(False))
    ids = lambda: sorted(r["doc_id"] for r in readers.read_statements(spark, f"{out}/statements").collect())
    assert ids() == [0, 2, 4]
    assert {r["error"] for r in spark.read.json(f"{out}/failed").collect()} == {"bad reply"}
    jobs.extract(spark, out, providers=model(True))
    assert ids() == [0, 1, 2, 3, 4, 5]


def test_greedy_match_is_every_tokens_best_partner():
    rnd = np.random.default_rng(5)
    a, b = rnd.normal(size=(37, 8)), rnd.normal(size=(23, 8))
    a[3] = 0
    cosine = np.array([[x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) if x.any() else 0.0 for y in b] for x in a])
    want = cosine.max(axis=1).mean(), cosine.max(axis=0).mean()
    for block in (5, 23, 1024):
        assert evaluate.greedy_match(a, b, block) == pytest.approx(want)
    assert evaluate.greedy_match(a, b[:0]) == (0.0, 0.0)


def test_one_hot_vectors_give_the_token_score(spark):
    rows = [(1, "the cat sat the", "the dog sat"), (2, "", "a"), (3, None, "a b"), (4, "I cannot answer a", "a"), (5, "x\ty", "z"), (6, "Same Same", "same"), (7, "a", None)]
    pairs = cut(spark.createDataFrame(rows, "qid long, prediction string, reference string"))
    want = {r["qid"]: tuple(r)[1:] for r in evaluate.token_f1(pairs).collect()}
    for batch in (2, 32):
        got = {r["qid"]: tuple(r)[1:] for r in evaluate.semantic_f1(pairs, replace(RULES, embed_tokens=one_hot), batch).collect()}
        assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q]) for q in want)
    assert evaluate.semantic_f1(pairs.limit(0)).count() == 0


def test_one_hot_vectors_are_made_without_a_square_of_the_vocabulary():
    import tracemalloc

    texts = [" ".join(f"w{100 * i + j}" for j in range(100)) for i in range(32)]  # 3,200 words: their square is 82 MB
    tracemalloc.start()
    made = one_hot([*texts, "w1 w1"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(x.nbytes for x in made)
    assert peak < size + 8_000_000
    assert made[0].shape == (100, 3200) and made[0].sum() == 100
    assert (made[32][0] == made[32][1]).all() and (made[32][0] @ made[0].T).sum() == 1


def test_dimensions_that_one_side_lacks_change_no_score():
    a, b = np.eye(9)[[0, 1, 2, 5]], np.eye(9)[[1, 2, 7]]
    assert evaluate.greedy_match(a, b) == pytest.approx((0.5, 2 / 3))
    assert evaluate.greedy_match(a[:2], np.eye(9)[[7, 8]]) == (0.0, 0.0)
