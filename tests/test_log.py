"""Logs of records: the last written holds, writes are published at once, streams come once."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar import jobs
from lodestar.sources import log, readers, writers
from lodestar.streaming import ingest

ROW = "id string, rag_answer string, rounds int"


def rows(spark, n, answer, first=0, parts=1):
    return spark.range(first, first + n, 1, parts).select(F.col("id").cast("string").alias("id"), F.lit(answer).alias("rag_answer"), F.lit(2).alias("rounds"))


def held(spark, path):
    return {r["qid"]: r["answer"] for r in readers.read_answers(spark, str(path)).collect()}


@pytest.mark.parametrize("sizes", [(1, 301), (301, 1), (5, 2000, 1), (1, 1, 1)])
def test_the_last_append_holds(spark, tmp_path, sizes):
    for i, n in enumerate(sizes):
        writers.append_rows(rows(spark, n, f"a{i}", parts=1 + 3 * (i % 2)), str(tmp_path))
    want = {str(k): f"a{max(i for i, n in enumerate(sizes) if n > k)}" for k in range(max(sizes))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "2k"):  # blocks in any packing
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert held(spark, tmp_path) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert log.version(spark, str(tmp_path)).number == len(sizes)


def test_the_last_line_of_a_large_file_holds(spark, tmp_path):
    lines = [json.dumps({"id": str(i % 700), "rag_answer": f"a{i}" + "x" * 90}) for i in range(30_000)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        found = held(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {str(i % 700): f"a{i}" + "x" * 90 for i in range(30_000)}


def test_a_killed_rewrite_leaves_the_old_records(spark, tmp_path):
    path = str(tmp_path)
    writers.append_rows(rows(spark, 9, "old"), path)
    with pytest.raises(Exception, match="killed"):
        writers.replace_rows(rows(spark, 9, "new", parts=3).withColumn("rounds", F.when(F.col("id") == "8", F.raise_error(F.lit("killed")).cast("int")).otherwise(1)), path)
    rows(spark, 9, "new").write.json(f"{path}/batch=000000000002-0abc")  # written, but not published
    assert set(held(spark, path).values()) == {"old"}
    writers.replace_rows(log.read(spark, path, ROW).drop(log.AT).withColumn("rag_answer", F.lit("newer")), path)  # from itself
    assert set(held(spark, path).values()) == {"newer"} and len(held(spark, path)) == 9
    writers.append_rows(rows(spark, 2, "last"), path)
    log.compact(spark, path, ROW, "id")
    assert log.read(spark, path, ROW).count() == 9 and sorted(held(spark, path).values()) == ["last"] * 2 + ["newer"] * 7
    assert log.vacuum(spark, path, 1) >= 4
    assert sorted(held(spark, path).values()) == ["last"] * 2 + ["newer"] * 7
    assert {r["rounds"] for r in readers.read_answers(spark, path).collect()} == {2}


def test_a_first_write_that_died_holds_nothing(spark, tmp_path):
    rows(spark, 3, "x").write.json(f"{tmp_path}/batch=000000000001-0abc")
    assert held(spark, tmp_path) == {}


def test_two_writers_do_not_lose_each_other(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path), log._Folder.publish
    writers.append_rows(rows(spark, 3, "first"), path)

    def late(folder, version):
        monkeypatch.setattr(log._Folder, "publish", real)
        writers.append_rows(rows(spark, 1, "other"), path)
        return real(folder, version)

    monkeypatch.setattr(log._Folder, "publish", late)
    writers.append_rows(rows(spark, 2, "mine"), path)
    assert held(spark, path) == {"0": "mine", "1": "mine", "2": "first"}
    assert [b[6:18] for b in log.version(spark, path).batches] == ["000000000001", "000000000002", "000000000003"]


def test_files_of_others_come_before_the_first_version(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "1", "rag_answer": "plain"}\n{"id": "2", "rag_answer": "plain"}')
    writers.append_rows(rows(spark, 1, "appended", first=2), str(tmp_path))
    assert held(spark, tmp_path) == {"1": "plain", "2": "appended"}


def test_a_retry_keeps_all_fields(spark, tmp_path):
    out = tmp_path / "out"
    (tmp_path / "asks.json").write_text('{"id": "1", "question": "Who sings?"}\n{"id": "2", "question": "Who?"}')
    writers.append_rows(spark.createDataFrame([("1", None, 3), ("2", "kept", 1)], ROW), f"{out}/answers/iterative")
    writers.append_rows(spark.createDataFrame([("1", ["Anna sings."])], "id string, chunks array<string>"), f"{out}/retrievals/iterative")
    jobs.retry(spark, "iterative", str(out), str(tmp_path / "asks.json"))
    found = {r["qid"]: (r["answer"], r["rounds"]) for r in readers.read_answers(spark, f"{out}/answers/iterative").collect()}
    assert found == {"1": ("Anna sings.", 3), "2": ("kept", 1)}


def test_a_replayed_batch_is_taken_once_and_failures_come_up_again(spark, tmp_path, monkeypatch):
    out, asked = str(tmp_path / "out"), []

    def reply(todo):
        asked.append(sorted(r["qid"] for r in todo.collect()))
        return todo.select("qid", F.when((F.col("qid") != "1") | F.lit(len(asked) > 3), F.concat(F.lit("to "), "question")).alias("answer"))

    batch = lambda *ids: spark.createDataFrame([(i, f"q{i}") for i in ids], "qid string, question string")
    ingest.answer_batch(batch("0", "1"), 0, reply, out)
    ingest.answer_batch(batch("0", "1"), 0, reply, out)  # killed after it was published, and replayed
    with monkeypatch.context() as killed:  # killed before
        killed.setattr(log._Folder, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            ingest.answer_batch(batch("2"), 1, reply, out)
    ingest.answer_batch(batch("2"), 1, reply, out)
    ingest.answer_batch(batch("3"), 2, reply, out)
    assert asked == [["0", "1"], ["1", "2"], ["1", "2"], ["1", "3"]]
    found = log.read(spark, out, ROW).collect()
    assert sorted((r["id"], r["rag_answer"]) for r in found) == [(i, f"to q{i}") for i in "0123"]
    assert log.side(spark, out, "failed", ingest.QUEUE).count() == 0


def test_a_question_that_always_fails_ends_as_null(spark, tmp_path):
    out = str(tmp_path / "out")
    none = lambda todo: todo.select("qid", F.lit(None).cast("string").alias("answer"))
    for i in range(4):
        ingest.answer_batch(spark.createDataFrame([("a", "q")][: i == 0], "qid string, question string"), i, none, out, attempts=3)
    assert [(r["id"], r["rag_answer"]) for r in log.read(spark, out, ROW).collect()] == [("a", None)]
