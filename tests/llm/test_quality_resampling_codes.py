"""Quality rules, importance resampling and vector codes against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import codebooks, importance, quality
from lodestar.llm.queries import QUERIES

DOCS = "doc_id long, text string, source string, row long, host string, n_words long, place long"
SF = "/root/testdata/sf0.001"


def prose(rnd, n):
    return " ".join(rnd.choice(("Alpha", "beta", "gamma7", "del*ta", "ünï", "É", "zeta", "eta")) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    common = "This  Line is held by 12 documents of a host"
    out = [None, "", " \t\n ", prose(rnd, 5), prose(rnd, 30_000), "\n".join([prose(rnd, 9)] * 4), prose(rnd, 12) + " " + "x y z u v w a b c " * 3]
    out += [prose(rnd, 30) + "\n" + common.replace("12", str(i)) + "\n" + common for i in range(14)]
    out += [common + f"\nThis line is HELD by 99 Documents of a HOST\nown{i}" for i in range(13)]
    out += [out[7]] * 30 + ["a\x1cb c d\x0be\rf"]
    return [(None if i == 9 else i // 2, t, (None, "h", "h", "h")[i % 4]) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, s, 5, "x", 1, 2) for i, t, s in texts], DOCS)


def brute_quality(texts, limits):
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    plain = lambda line: " ".join(split("".join(c.lower() if "A" <= c <= "Z" else "0" if c in "123456789" else c for c in line)))
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, t, s in texts:
        hosts[s].add(t or "")
        for line in (t or "").split("\n"):
            if split(line):
                holders[s, plain(line)].add(t)
    for d, t, s in texts:
        t = t or ""
        words, lines = split(t), [x for x in t.split("\n") if split(x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        often = [x for x in lines if len(holders[s, plain(x)]) > max(limits.documents, limits.share * len(hosts[s]))]
        gone = sum(len(split(x)) for x in often)
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        kept = not failed and len(words) - gone >= limits.left * len(words)
        left = "\n".join(x for x in t.split("\n") if x not in often)
        yield (d, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), gone, failed, kept), left


@pytest.mark.parametrize("limits", [quality.Limits(), quality.Limits(documents=2, share=0.3, left=0.8)])
def test_quality(spark, texts, docs, limits):
    want = list(brute_quality(texts, limits))
    found = quality.judge(docs, limits=limits).select("doc_id", *quality.FIGURES, "removed_words", "base_failed", "kept")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((w[0] for w in want), key=repr)
    kept = quality.clean(docs, limits=limits)
    assert kept.columns == docs.columns
    assert sorted((r["text"] for r in kept.collect())) == sorted(left for w, left in want if w[-1])
    assert any(w[0][6] and w[0][-1] for w in want) and any(w[0][6] and not w[0][-1] and not w[0][-2] for w in want)


def test_quality_of_no_rows_and_of_a_hot_line(spark, docs):
    assert quality.judge(docs.limit(0)).count() == 0 == quality.clean(docs.limit(0)).count()
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line of every document\n"), F.repeat(F.concat(F.md5(F.col("id").cast("string")), F.lit(" ")), F.lit(2))).alias("text"), F.lit("h").alias("source"))
    found = quality.judge(rows, limits=quality.Limits(least_words=0)).groupBy("removed_words", "kept").count().collect()
    assert [tuple(r) for r in found] == [(7, False, 4000)]


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_resample(texts, target):
    s, t = Counter(), Counter()
    made = [brute_features(x) for _, x in texts]
    for _, f in made:
        s.update(f)
    for x in target:
        t.update(brute_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for (d, _), (n, f) in zip(texts, made, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fits = sorted((r for r in rows if r[-1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fits[: 25 * len(fits) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("far", [1, 1 << 44, -(1 << 46)])
def test_resampling(spark, far):
    rnd = random.Random(far)
    texts = [(None if i == 3 else i * far, t) for i, t in enumerate([None, "", "Ünï-cöde 12 a\x7fb", prose(rnd, 40), prose(rnd, 20_000), *(prose(rnd, rnd.randrange(60)) for _ in range(300))])]
    target = [prose(rnd, 40), None, "", "zeta1 eta2"]
    docs = spark.createDataFrame([(d, t, "x", 1, "h", 9, 9) for d, t in texts], DOCS).repartition(5)
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), block=64)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute_resample(texts, target), key=repr)


def test_resampling_of_repeated_rows_and_of_no_rows(spark):
    rows = spark.createDataFrame([(7, "word " * 30)] * 200 + [(8, "other " * 25)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    found = importance.resample(rows, none, block=32).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 51)) and len(found) == 201
    assert importance.resample(rows.limit(0), none).count() == 0


def test_radix_places_are_stable(spark):
    rnd = random.Random(1)
    keys = [(rnd.randrange(3), rnd.choice((0, 5, 1 << 30, (1 << 60) + rnd.randrange(9000)))) for _ in range(1000)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(keys)], "place long, a long, b long").withColumn("was", F.col("place"))
    found = {r["was"]: r["place"] for r in importance.radix_places(rows, ["a", "b"], 100).collect()}
    assert found == {i: p for p, i in enumerate(sorted(range(1000), key=lambda i: keys[i]))}


def brute_codes(rows, entries=256, parts=4, rounds=4):
    kept = [(k, lab, [math.floor(1024 * x) for x in v]) for k, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: np.array([((x[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)])
    for _ in range(rounds):
        label = near()
        for p in range(parts):
            for e in set(label[p].tolist()):
                own = x[label[p] == e, p]
                books[p, e] = own.sum(0) // len(own)
    label = near()
    error = sum(((x[:, p] - books[p][label[p]]) ** 2).sum(1) for p in range(parts))
    return [(r[0], r[1], tuple(label[:, i].tolist()), int(error[i])) for i, r in enumerate(kept)], books


@pytest.mark.parametrize(("n", "entries", "block"), [(900, 16, 128), (40, 256, 4096), (1500, 64, 700)])
def test_codes(spark, n, entries, block):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(12, 8))
    vectors = [(centres[i % 12] + rng.normal(size=8) * (0.02, 0.5)[i % 3 == 0]).astype(np.float32).tolist() for i in range(n)]
    vectors[5:30] = [vectors[4]] * 25
    rows = [(i // 2 if i % 7 else None, v, i % 3 or None) for i, v in enumerate(vectors)]
    odd = [(0, None, 1), (1, [], 1), (2, [float("nan")] + [0.0] * 7, 1), (3, [None] + [0.0] * 7, 1), (4, [float("inf")] + [0.0] * 7, 2)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, error long, codes string").repartition(3)
    found, books = codebooks.compress(table, carry=("label",), entries=entries, block=block)
    want, wanted = brute_codes(rows, entries)
    assert (books.astype(np.int64) == wanted).all()
    assert sorted(((r["vec_id"], r["label"], tuple(r["codes"]), r["error"]) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(2)
    points = np.floor(np.concatenate([c + rng.normal(size=(400, 6)) for c in rng.normal(size=(8, 6)) * 900]))
    order, tree = codebooks.cover_tree(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    placed = points[order]
    for b, e, c, n, r in zip(*(tree[k] for k in ("begin", "end", "child", "children", "radius")), strict=True):
        assert np.sqrt(((placed[b:e] - placed[b]) ** 2).sum(1)).max() <= r + 1e-9
        if n:
            heads = placed[tree["begin"][c : c + n]]
            apart = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(2)) + np.eye(n) * 1e9
            assert apart.min() > r / 2 - 1e-9 and tree["begin"][c] == b and tree["end"][c + n - 1] == e
    label, whole, compared = codebooks.assign(placed, tree, points[::400].copy())
    assert (label == ((placed[:, None] - points[None, ::400]) ** 2).sum(2).argmin(1)).all()
    assert compared == 0 and len(whole) < 100  # separate clusters go as whole subtrees


def test_codes_of_odd_tables(spark):
    shape = "vec_id long, embedding array<float>, label int"
    found, books = codebooks.compress(spark.createDataFrame([], shape))
    assert found.count() == 0 and books.size == 0
    rows = [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1), (3, [9e30] * 8, 1)]
    found = codebooks.compress(spark.createDataFrame(rows, shape))[0].collect()
    assert sorted(r["vec_id"] for r in found) == [1, 3]  # another length goes; what is too large counts as the bound
    with pytest.raises(ValueError, match="equal parts"):
        codebooks.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], shape))


def test_op12_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_resampling"](spark, SF).collect())) == sorted(brute_resample(docs, target))
