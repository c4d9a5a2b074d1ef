import random

import pytest

import __spark_entry__
import corpus_pipeline
from lodestar.llm import resemblance

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (5000, rows[3]["text"], "en", "s", 1), (5000, rows[3]["text"], "en", "s", 1)], docs.schema)
    from lodestar.llm.common import stored

    now, counts = stored(docs.unionByName(odd), "t"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, SF)
        if name != "packing":
            assert made.columns == docs.columns
        now = stored(made, "t")
        counts.append(now.count())
    assert len(rows) + 4 >= counts[0] > counts[1] >= counts[2] == counts[3]
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("stage", ["near_duplicates", "decontamination"])
def test_stages_do_not_hang_on_how_scans_are_split(spark, tmp_path, monkeypatch, stage):
    from lodestar.llm import resemblance

    path, run = str(tmp_path / "docs"), dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.repartition(5).write.option("parquet.block.size", 20_000).parquet(path)
    want = run(spark, spark.read.parquet(path).coalesce(1), "/root/testdata/sf0.01").count()
    sizes = iter([90_000, 700_000, 50_000, 400_000, 128 << 20] * 20)
    for module, name in ((corpus_pipeline, "stored"), (corpus_pipeline, "cut"), (resemblance, "stored"), (resemblance, "cut")):

        def changed(*args, keep=getattr(module, name)):
            out = keep(*args)
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes)))
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            return out

        monkeypatch.setattr(module, name, changed)
    try:
        kept = run(spark, spark.read.parquet(path), "/root/testdata/sf0.01").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert want < docs.count() and kept == want


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, stage):
    """No rows; then nulls in all columns, a very long text, repeated rows, and columns with names that stages use."""
    run = dict(corpus_pipeline.STAGES)[stage]
    rnd = random.Random(3)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, toxicity double, found string, same string"
    rows = [(None,) * 9, (None,) * 9, (1, "", "en", "s", 0, 5, 0.1, "f", "s"), (2, long, "en", "s", len(long), 5, 0.9, "f", "s"), (3, "one two three", "en", "s", 13, 5, None, "f", "s"), (3, "one two three", "en", "s", 13, 5, None, "f", "s")]
    assert run(spark, spark.createDataFrame([], schema), SF).count() == 0
    docs = spark.createDataFrame(rows, schema)
    made = run(spark, docs, SF)
    got = made.collect()
    if stage == "packing":
        assert sum(r["length"] for r in got if r["doc_id"] == 2) > 60_000 and sum(r["doc_id"] is None for r in got) == 2
        return
    assert made.columns == docs.columns and set(map(tuple, got)) <= set(rows)
    assert len(got) == (3 if stage == "near_duplicates" else 6)


def test_registry():
    names = list(__spark_entry__.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def _sets(texts):
    split = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def _greedy(sets):
    """Numbers of the sets that are similar, by 0.8 or more, to no earlier one that stays."""
    stay = []
    for i, x in enumerate(sets):
        if not any(9 * len(x & sets[j]) >= 4 * (len(x) + len(sets[j])) for j in stay):
            stay.append(i)
    return stay


def test_near_duplicates_from_0_8_on(spark, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    line = [word() for _ in range(12)]  # a line that many texts have
    texts, planted = [None, "", "one", "One", "one two"], []
    for edits in range(10):  # single words, each in five shingles
        for _ in range(4):
            base = [word() for _ in range(200)] + line
            texts.append(" ".join(base))
            for at in rnd.sample(range(2, 198, 6), edits):
                base[at] = word()
            planted.append(len(texts))
            texts.append(" ".join(base))
    chain = [word() for _ in range(150)]
    for k in range(40):  # each is similar to its neighbours, not to those farther off
        texts.append(" ".join(chain[2 * k :] + [f"{k}{i}" for i in range(2 * k)]))
    sets = _sets(texts)
    both = [len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) for i in planted]
    assert sum(0.8 <= x < 0.85 for x in both) >= 4 and sum(0.7 < x < 0.8 for x in both) >= 4 and sum(0.9 <= x < 1 for x in both) >= 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = _greedy(sets)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == want
    for rounds, block, common in ((0, 8, 2), (9, 512, 10**9)):  # all in pairs of blocks; rounds and then pairs
        monkeypatch.setattr(resemblance, "ROUNDS", rounds)
        monkeypatch.setattr(resemblance, "BLOCK", block)
        monkeypatch.setattr(resemblance, "COMMON", common)
        gone = {r["doc_id"] for r in resemblance.later_copies(docs).collect()}
        assert [i for i in range(len(texts)) if i not in gone] == want


def test_fingerprints_alone_find_near_copies(spark):
    """Without any shared shingle in the lists, groups of near fingerprints still bring near copies together."""
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(900)]
    texts = [" ".join(words[:600]), " ".join(words[300:]), " ".join([*words[:598], "other", "end"]), " ".join(words[600:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").localCheckpoint()
    made = resemblance._described(docs, resemblance._common(docs)).localCheckpoint()
    groups = resemblance._near_fingerprints(made.select("doc_id", "n", "fp")).localCheckpoint()
    assert sorted(r["doc_id"] for r in groups.collect()) == [0, 2]
    gone = resemblance._later(docs, made, groups.limit(0).localCheckpoint(), groups)
    assert {r["doc_id"] for g in gone for r in g.collect()} == {2}


def test_tokenizer_model_is_made_only_where_needed():
    from lodestar.llm import packing
    from lodestar.llm.queries import tokenizer

    ids = packing.ids_of(tokenizer())
    assert ids is packing.ids_of(tokenizer()) and len(ids("some words")) and "model" not in vars(ids)
    assert ids("some  words").tolist() == ids.model.encode("some  words", add_special_tokens=False).ids
