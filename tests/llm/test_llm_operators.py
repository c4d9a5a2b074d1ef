"""The training-data operators against brute force, and on rows that are null, empty, long or repeated."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import decontaminate, language, media, packing, pii, secrets, simhash, suffixes, toxicity, urls

DOCS = "doc_id long, text string, fp string, row long, lang string, n_chars long"  # names that operators use, too


def words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [words(rnd, n) for n in (300, 120, 40, 12, 3)]
    near = base[0].split()
    near[50] = "changed"
    long = words(rnd, 30_000)
    out = [None, "", " \t\n ", *base, base[0], base[1], " ".join(near), "x" + base[1][:900] + "y" + base[1][:500], long, long[1000:9000], "é ünï " * 90, "a" * 900, "一" * 300]
    return [(None if i == 5 else i - (i == 9), t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, None, 7) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash(spark, texts, docs, empty):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in texts]
    reach = list(range(len(texts)))
    for _ in texts:
        reach = [min(reach[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts))]
    least = {c: min((texts[i][0] for i in range(len(texts)) if reach[i] == c and texts[i][0] is not None), default=None) for c in set(reach)}
    want = sorted(((d, format(p, "016x"), least[c]) for (d, _), p, c in zip(texts, prints, reach, strict=True)), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("n", "block", "flips"), [(400, 512, 2), (700, 64, 1)])
def test_links_are_a_forest_of_all_links(spark, n, block, flips):
    rnd = random.Random(n)
    seeds = [rnd.getrandbits(64) for _ in range(20)]
    fps = sorted({s ^ sum(1 << rnd.randrange(64) for _ in range(flips)) & (1 << 64) - 1 for s in seeds for _ in range(n // 20)} | {0, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() >= 1 for a, b in found)

    def classes(pairs):
        parent = {x: x for x in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        return {frozenset(y for y in signed if root(y) == root(x)) for x in signed}

    assert classes(found) == classes([(a, b) for a in signed for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_other_radii(radius):
    rnd = np.random.RandomState(radius)
    fps = rnd.randint(0, 1 << 62, 90).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(1), fps ^ np.uint64(0b1010100)]))
    a, _ = simhash.forest(fps, np.zeros(len(fps), np.int64), radius)
    near = {int(x) for i, x in enumerate(fps) for j, y in enumerate(fps) if i != j and int(x ^ y).bit_count() <= radius}
    assert set(a.tolist()) <= near and (len(near) > 0) == (len(a) > 0)


def test_suffixes(spark, texts, docs, empty):
    data, length = [(t or "").encode() for _, t in texts], suffixes.LENGTH
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    want = []
    for (doc_id, _), d in zip(texts, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        want.append((doc_id, len(d), len(d) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    found = suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert suffixes.remove_repeats(empty).count() == 0


def test_large_buckets_are_divided(spark, monkeypatch):
    rnd = random.Random(9)
    passage = words(rnd, 130)
    rows = [(i, words(rnd, 20) + " " + passage[rnd.randrange(60) :][: 430 + rnd.randrange(300)] + " " + words(rnd, 20)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, suffixes.remove_repeats(docs).drop("kept").collect()))
    monkeypatch.setattr(suffixes, "MOST", 3)
    assert sorted(map(tuple, suffixes.remove_repeats(docs).drop("kept").collect())) == whole
    assert sum(r[2] for r in whole) > 60 * 300


def test_results_do_not_hang_on_how_scans_are_split(spark, tmp_path, monkeypatch):
    """Between two passes over the table its splits change, as when executors join or are lost."""
    rnd = random.Random(3)
    passage = words(rnd, 120)
    rows = [(i, f"{words(rnd, 60)} {passage if i % 3 == 0 else ''} {words(rnd, 30)}") for i in range(200)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    want = sorted(map(tuple, suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()))
    assert sum(r[2] > 0 for r in want) == 67
    sizes, keep = iter([9000, 70_000, 5000, 40_000, 128 << 20] * 20), suffixes.stored

    def stored(df, name):
        out = keep(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes)))
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        return out

    monkeypatch.setattr(suffixes, "stored", stored)
    try:
        assert sorted(map(tuple, suffixes.remove_repeats(spark.read.parquet(path)).drop("kept").collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    from lodestar.llm import common

    monkeypatch.setattr(common, "HOT", 2)
    many = spark.createDataFrame([(i, 7 if i < 4000 else i % 5) for i in range(5000)], "i int, k long")
    keys = many.groupBy("k").count().withColumnRenamed("count", "n")
    joined = common.spread_join(many, keys.where("k <> 3"), ["k"])
    assert sorted((r["i"], r["n"]) for r in joined.collect()) == [(i, 4000 if i < 4000 else 200) for i in range(5000) if i < 4000 or i % 5 != 3]


def test_suffix_order_is_lexicographic():
    rnd = np.random.RandomState(3)
    text = np.concatenate([rnd.randint(97, 99, 400), np.tile([97, 98, 97], 120), rnd.randint(97, 99, 100)]).astype(np.uint8)
    order, _ = suffixes.suffix_order(text, np.arange(len(text)), len(text))
    raw = bytes(text) + bytes(2000)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: raw[i : i + len(text)])
    shifts = suffixes._shifts()
    assert (shifts < suffixes.V).all()


def test_packing(spark, texts, docs, empty):
    file = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(file)
    model.encode_special_tokens = True
    ids = [[*model.encode(t or "", add_special_tokens=False).ids, 0] for _, t in texts]
    rows = packing.pack_documents(docs, file, group=8).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    want = sorted(((d, s, min(1024, len(x) - s), zlib.crc32(np.array(x[s : s + 1024], "<u4").tobytes()), len(x)) for (d, _), x in zip(texts, ids, strict=True) for s in range(0, len(x), 1024)), key=repr)
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows), key=repr) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in b)
        assert [r["offset"] for r in b] == np.r_[0, np.cumsum([r["length"] for r in b])][:-1].tolist()
        assert total <= 1024 and all(r["sequence_tokens"] == total and r["padded_tokens"] == (total if total.bit_count() == 1 else 1024) for r in b)
    assert packing.pack_documents(empty, file).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rnd = np.random.RandomState(1)
    lengths = rnd.randint(1, 1025, 500)
    bins, offsets = packing.first_fit_decreasing(lengths)
    room = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(1024)
        assert (bins[i], offsets[i]) == (k, 1024 - room[k])
        room[k] -= lengths[i]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_tokenizer(name):
    ids, model = packing.Ids(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    model.encode_special_tokens = True
    for text in ("", " ", "Hello  world's\n\n  <|endoftext|> ça 你好 \u2003x\x85y", "a" * 5000, " " * 3000 + "b", "1234 56,7%%% \t\r\n"):
        assert ids(text).tolist() == model.encode(text, add_special_tokens=False).ids
    assert (ids.fast is None) == name.startswith("word")


def test_decontamination(spark, docs, empty):
    rnd = random.Random(2)
    items = [words(rnd, n) for n in (40, 25, 9, 4)] + [None, ""]
    w = items[0].split()
    moved = " ".join(w[20:] + ["zz"] + w[:20])
    broken = " ".join(x if i % 5 else "q" for i, x in enumerate(w))
    rows = [(0, "aa bb " + items[0].upper().replace(" ", ", ") + " cc"), (1, moved), (2, broken), (3, items[1]), (None, items[2]), (3, items[1]), (4, items[3]), (5, None), (6, "")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    want = [(0, 0), (1, 0), (3, 1), (3, 1), (None, 2), (4, 3)]
    assert sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert decontaminate.leaks(docs, bench).count() == 0
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_are_those_of_tiling_every_pair(spark, monkeypatch):
    """With common seeds dealt out by salts, one item at a time, repeated items and a very long text."""
    rnd = random.Random(8)
    monkeypatch.setattr(decontaminate, "SALTED", 4)
    monkeypatch.setattr(decontaminate, "TOGETHER", 1)
    common = words(rnd, 12)
    items = [f"{words(rnd, rnd.randrange(1, 30))} {common if i % 3 == 0 else ''} {words(rnd, rnd.randrange(0, 12))}".strip() for i in range(30)] + [common, "solo", ""]
    texts = [words(rnd, 20_000) + " " + items[4] + " " + items[7]]
    for i in range(60):
        parts = items[rnd.randrange(33)].split()
        cut_at = sorted(rnd.sample(range(len(parts) + 1), min(2, len(parts) + 1)))
        moved = parts[cut_at[-1] :] + ["q"] * rnd.randrange(2) + parts[: cut_at[0]] + parts[cut_at[0] : cut_at[-1]][: rnd.randrange(1, 40)]
        texts.append(" ".join(words(rnd, 5).split() + moved + words(rnd, 5).split()) if i % 5 else f"{common} {words(rnd, 4)}")
    bench = [(i, t) for i, t in enumerate(items)] + [(3, items[3])]
    want = []
    for d, text in enumerate(texts):
        for i, t in enumerate(items):
            vocab, a, b = {}, decontaminate.tokens(text), decontaminate.tokens(t)
            x, y = (np.array([vocab.setdefault(w, len(vocab)) for w in ws], np.int64) for ws in (a, b))
            covered = sum(n for _, _, n in decontaminate.tile(x, y, min(5, len(y)))) if len(y) else 0
            if len(y) and covered >= 0.8 * len(y):
                want.append((d, i, covered))
    found = decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["covered_tokens"]) for r in found.collect()) == want and len(want) > 30


def test_tiling_finds_the_longest_first():
    rnd = np.random.RandomState(0)
    for _ in range(30):
        doc, item = rnd.randint(0, 4, 60), rnd.randint(0, 4, 30)
        doc_free, item_free, want, n = np.ones(60, bool), np.ones(30, bool), 0, 30
        while n >= 3:
            for d in range(61 - n):
                for i in range(31 - n):
                    if doc_free[d : d + n].all() and item_free[i : i + n].all() and (doc[d : d + n] == item[i : i + n]).all():
                        doc_free[d : d + n] = item_free[i : i + n] = False
                        want += n
            n -= 1
        assert sum(t[2] for t in decontaminate.tile(doc, item, 3)) == want


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base_spans(patterns, test, text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if test(kind, m))
    return [sum(x[3] == kind for x in found) for kind in patterns], ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def noisy(rnd, parts, n):
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(n)]


def test_pii(spark, docs, empty):
    rnd = random.Random(4)
    parts = ["a.b", "@", "x-1", ".", "+", "1", "22", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "(", ")", "192.168.0.1", "256.1.1.1", "é", "😀", "00012.", "user@mail.example.com", "+1 (555) 010-9999", "\n", "5500000000000004"]
    texts = [*noisy(rnd, parts, 300), None, "", "7" * 20_000, "1 " * 4000, "a" * 100_000 + "@b.c", "+" + "(" * 5000, ("a@b.co " * 700)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pii int")).collect()}
    for i, t in rows:
        counts, spans = base_spans(PII, valid, t)
        assert [got[i][f"n_{k}"] for k in PII] == counts, t
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert ",".join(x for x in got[i]["spans"].split(",") if x and not x.startswith("iban")) == spans
    assert pii.digest(empty).count() == 0 and pii.find(docs).count() == docs.count()


def test_pii_checksums_and_context(spark):
    rows = [(0, "pay to IBAN DE89 3704 0044 0532 0130 00 today"), (1, "IBAN DE89 3704 0044 0532 0130 01"), (2, "call 4111 1111 1111 1111"), (3, "visa card 4111 1111 1111 1111")]
    found = {r["doc_id"]: r["pii"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x["kind"], x["start"], x["end"]) for x in found[0]] == [("iban", 12, 39)]
    assert found[1] == [] or all(x["kind"] != "iban" for x in found[1])
    assert found[3][0]["score"] > found[2][0]["score"]


SECRETS = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def test_secrets(spark, docs, empty):
    rnd = random.Random(6)
    parts = ["Password", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJ0123456789", "deadbeefdeadbeef", "abc", "é", "secret", "x/y+z", "0123456789ab", "\n", "ghp_" + "a1" * 18]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate([*noisy(rnd, parts, 300), None, "", "f" * 50_000, "token=" + "a" * 50_000])]
    least = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    want = []
    for i, t in rows:
        counts, spans = base_spans(SECRETS, lambda kind, m: least[kind](m), t)
        want.append((i, *counts, hashlib.sha256(spans.encode()).hexdigest()))
    found = secrets.digest(spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, secrets string, may int"))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert secrets.digest(empty).count() == 0 and secrets.find(docs).count() == docs.count()


def test_redaction(spark):
    rows = [(0, "a password=b7db7aa4a5fcc78305 z", 30, 1), (1, None, 0, 1), (2, "clean", 5, 1)]
    out = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found int")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(0, "a [SECRET] z", 12, 1), (1, None, 0, 1), (2, "clean", 5, 1)]


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{16,}+") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]{14,}+") == [[frozenset({"aki", "kia"})]]
    grams = secrets.trigram_query("(?:token|secret)x")
    assert grams == [sorted([frozenset({"tok", "oke", "ken", "enx"}), frozenset({"sec", "ecr", "cre", "ret", "etx"})], key=sorted)]


def test_urls(spark):
    rows = [
        (0, "http://A.Example.ORG/es/x", "example.org/es/", "block"), (1, "https://notexample.org/es/", "org/", "allow"), (2, "x://example.org/en/17?q", "example.org/en/1", "block"),
        (3, "http://org", None, "allow"), (4, "http://x.com/fr/?a", "com/fr/", "allow"), (5, "http://x.com/de/a", "com/de/", "block"), (6, None, None, "allow"), (7, "nourl", None, "allow"),
        (8, "http://www.spam-farm.example.net/en/1", None, "block"), (9, "http://spam-farm.example.org/fr/1", "org/", "allow"), (10, "http://x.net/a?PHPSESSID=1", None, "block"), (11, "", None, "allow"),
        (12, "http://x.net/spam/farm", None, "allow"), (13, "://?#", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, u, "mine", 1) for i, u, _, _ in rows], "page_id long, url string, host string, verdict int")
    got = {r["page_id"]: r for r in urls.judge(frame).collect()}
    assert [(i, u, got[i]["rule"], got[i]["verdict"]) for i, u, _, _ in rows] == rows
    assert (got[0]["host"], got[0]["path"]) == ("a.example.org", "/es/x") and (got[6]["host"], got[13]["host"]) == ("", "")
    assert urls.judge(frame.limit(0)).count() == 0


LANGS = {"aa": "kata mero lino supa", "bb": "schtröm grüff knorz pfahl", "cc": "вода небо земля"}


def test_a_long_rule_list_runs_few_rules(spark, monkeypatch):
    """20,000 rules against running all of them; every rule is filed, and a URL tries a handful."""
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    hosts = [f"{name()}.{rnd.choice(['com', 'org', 'net'])}" for _ in range(20_000)]
    rules = [urls.host_rule(rnd.choice(["allow", "block"]), h, rnd.choice(["/", "/a/", "/b"])) for h in hosts] + [r for r in urls.default_rules() if not r.on_host]
    assert all(all(r.tokens) for r in rules)
    pages = [(i, f"http://{rnd.choice(['', 'www.', 'x.y.'])}{rnd.choice(hosts)}{rnd.choice(['', '/', '/a/1', '/b?q', '/c'])}") for i in range(120)]
    pages += [(200, "http://my-adult.site/"), (201, "http://q.de/?jsessionid=1"), (202, "http://xxx.de"), (203, "http://x.de/" + "long/" * 50_000), (204, None), (204, "")]
    tried = []
    found = {(r["page_id"], r["url"]): (r["rule"], r["verdict"], r["pattern"]) for r in urls.judge(spark.createDataFrame(pages, "page_id int, url string"), rules).collect()}
    for page, url in pages:
        host, path = urls.parts(url)
        fits = [(r.weight, -k, r) for k, r in enumerate(rules) if r.on_host and re.compile(r.pattern, re.DOTALL).match(host + path)] if url and page < 200 and page % 6 == 0 else None
        if fits is not None:
            best = max(fits, key=lambda x: x[:2])[2] if fits else None
            assert found[page, url][0] == (best and best.name)
            tried.append(bool(best))
    assert any(tried) and found[200, pages[120][1]][1:] == ("block", "adult") and found[201, pages[121][1]][2] == "session-trap" and found[202, pages[122][1]][1] == "block"
    assert found[204, None] == (None, "allow", None)


def test_language(spark, empty):
    rnd = random.Random(8)
    say = lambda k, n: " ".join(rnd.choice(LANGS[k].split()) + rnd.choice(["", ",", "."]) for _ in range(n))
    train = [(i, say(k, 30), k, "x") for i, k in enumerate(list(LANGS) * 20)] + [(99, None, "aa", "x"), (98, "zz", None, "x")]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string, score string"))
    long = say("aa", 30_000)
    rows = [(0, say("aa", 9)), (1, say("bb", 9)), (2, say("cc", 9)), (3, None), (4, ""), (5, "123 _ !"), (None, say("aa", 20) + " | " + say("bb", 8)), (7, long), (8, "漢字")]
    got = {r["doc_id"]: r for r in language.label(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 5, None, 7)] == ["aa", "bb", "cc", "und", "und", "und", "aa", "aa"]
    assert got[8]["lang_pred"] in LANGS
    mixed = got[None]["spans"]
    text = rows[6][1]
    assert [x["lang"] for x in mixed] == ["aa", "bb"] and text[mixed[0]["start"] : mixed[0]["end"]] == text.split(" | ")[0].rstrip(",.")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.label(empty, model).count() == 0
    none = language.fit(empty)
    assert {r["lang_pred"] for r in language.label(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()} == {"und"}


def test_word_scores_are_sums_over_ngrams():
    """Against n-grams taken one by one, with scripts that some languages do not write."""
    rnd = np.random.RandomState(3)
    n_scripts = len(language.NAMES)
    written = np.ones((n_scripts, 3), bool)
    written[language.NAMES.index("Greek")] = [False, True, False]
    written[language.NAMES.index("Han")] = False
    model = language.Model(["a", "b", "c"], rnd.normal(-5, 1, (1 << language.BITS, 3)).astype(np.float32), written)
    tried = ["a", "über", "λόγος", "漢字", "word" * 30, "ß"]
    got = model.scores(tried)
    for w, row in zip(tried, got, strict=True):
        padded, total = f" {w} ", np.zeros(3)
        for n in language.ORDERS:
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram[0] == gram[-1] == " ":  # a whole word between its spaces is no n-gram
                    continue
                h = 0
                for c in gram:
                    h = (h * 0x100000001B3 + ord(c)) & (1 << 64) - 1
                total += model.log_p[((h ^ n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - language.BITS)]
        may = written[language.scripts([w])[0]]
        total = np.where(may, total, -np.inf) if may.any() else np.zeros(3)
        assert row == pytest.approx(np.maximum(total - total.max(), -language.MOST), abs=1e-3)


def test_languages_tie_and_columns_clash(spark):
    train = spark.createDataFrame([(i, "same words here", k) for i, k in enumerate("ba" * 10)], "doc_id long, text string, lang string")
    model = language.fit(train)
    docs = spark.createDataFrame([(1, "same words here", "x", 1.0, None, "w"), (1, "same words here", "x", 1.0, None, "w")], "doc_id long, text string, lang_pred string, score double, spans string, word string")
    got = language.label(docs, model).collect()
    assert [(r["doc_id"], r["lang_pred"], r["score"]) for r in got] == [(1, "a", 1.0)] * 2 and got[0].__fields__ == ["doc_id", "lang_pred", "score", "spans"]


def test_held_out_languages(spark):
    from lodestar.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    found = QUERIES["op3_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r["lang"] == r["lang_pred"] for r in found.where("held_out and lang is not null and lang_pred <> 'und'").collect()]
    assert len(held) > 100 and sum(held) / len(held) > 0.98


def test_viterbi_is_the_best_path():
    rnd = np.random.RandomState(2)
    sizes = np.array([5, 0, 3, 1, 6])
    scores = rnd.normal(0, 2, (sizes.sum(), 3)).astype(np.float32)
    labels = language.viterbi(scores, sizes, 1.5)
    at = 0
    for n in sizes:
        own = scores[at : at + n].astype(float)
        value = lambda p: sum(own[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        paths = [tuple((x // 3**i) % 3 for i in range(n)) for x in range(3**n)]
        assert value(tuple(labels[at : at + n])) == pytest.approx(max(map(value, paths)), abs=1e-4)
        at += n


def test_toxicity(spark, empty):
    rnd = random.Random(3)
    rows = [(i, words(rnd, 60) + (" you idiot scum" if i % 3 == 0 else "") + " " + words(rnd, 20), i % 3 == 0) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "idiot scum you idiot scum", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 4] + [(None, 1), (901, None), (7, 0), (7, 0)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == y for i, _, y in rows)
    assert got[900] == got[901] < 0.5
    assert toxicity.score(empty, model).count() == 0
    assert {r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_scores_are_sums_of_weights(spark):
    """Against counts and sums in plain Python; a very long text, equal texts and clashing columns."""
    rnd = random.Random(6)
    rows = [(i, words(rnd, 15) + (" badword" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(80)]
    long = words(rnd, 40_000) + " badword badword"
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(100, long, 0.5, "x"), (101, rows[0][1], 0.5, "x"), (102, rows[0][1], 0.5, "x")], "doc_id long, text string, toxicity double, bucket string")
    model = toxicity.fit(docs.limit(80), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int"), features=300)
    held = [{*toxicity.buckets(t).tolist()} for _, t, _ in rows]
    n = [sum(y == k for *_, y in rows) for k in (0, 1)]
    support = {}
    for b in set().union(*held):
        seen = [sum(b in h and y == k for h, (*_, y) in zip(held, rows, strict=True)) for k in (0, 1)]
        ratio = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
        support[b] = abs(ratio) / np.sqrt(1 / (seen[1] + 1) + 1 / (seen[0] + 1))
    kept = {b for b in range(1 << toxicity.BITS) if model.slot[b] < 300}
    assert len(kept) == 300 and kept <= set(support) and min(support[b] for b in kept) >= max(support[b] for b in set(support) - kept) - 1e-9
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, text in [(r[0], r[1]) for r in rows[:10]] + [(100, long)]:
        total = model.intercept + sum(model.weights[model.slot[b]] for b in {*toxicity.buckets(text).tolist()} & kept)
        assert got[i]["toxicity"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    assert got[0]["toxicity"] == got[101]["toxicity"] == got[102]["toxicity"] and got[0]["bucket"] == "x" and len(got) == 83


def test_held_out_toxicity(spark):
    from lodestar.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    found = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    held = found.where("held_out").collect()
    right, toxic = [r["predicted"] == r["toxic"] for r in held], [r["predicted"] == 1 for r in held if r["toxic"] == 1]
    assert len(held) > 500 and sum(right) / len(right) > 0.95 and sum(toxic) / len(toxic) > 0.65


def test_media_odd_pictures(spark):
    """A large picture beside its crop, a one-pixel picture, and an empty article."""
    rnd = np.random.RandomState(1)
    large = rnd.randint(0, 256, (250, 250)).repeat(4, 0).repeat(4, 1).astype(np.uint8)
    images = [large, np.ascontiguousarray(large[300:700, 200:]), np.zeros((1, 1), np.uint8), np.zeros((40, 40), np.uint8)]
    frame = spark.createDataFrame([(i, im.shape[1], bytearray(im.tobytes()), "k", 1) for i, im in enumerate(images)], "id long, width int, pixels binary, key string, row int")
    assert {r["id"]: r["class_id"] for r in media.copies(frame).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert media.picture({"article": None, "number": None}).size == media.picture({"article": "", "number": 3}).size == media.picture({"article": "", "number": 1}).size


def test_media(spark):
    rnd = np.random.RandomState(4)
    blocks = lambda: rnd.randint(0, 256, (40, 40)).repeat(4, 0).repeat(4, 1)
    one, two = blocks(), blocks()
    images = [one, one[12:, 20:], (one * 0.7 + 20), two, two[:, :-30], blocks(), one, one[:10, :10]]
    rows = [(i, im.shape[1], bytearray(im.astype(np.uint8).tobytes()), 1) for i, im in enumerate(images)] + [(None, 3, None, 1), (50, None, None, 1), (51, 7, bytearray(b"abc"), 1), (52, 7, bytearray(b"abc"), 1)]
    got = {r["id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "id long, width int, pixels binary, word int")).collect()}
    assert [got[i] for i in range(8)] == [0, 0, 0, 3, 3, 5, 0, 7]
    assert got[52] == 51 and got[50] == 50 and got[None] is None
    assert media.copies(spark.createDataFrame([], "id long, width int, pixels binary")).count() == 0


def test_turned_and_resized_images_are_copies(spark):
    rnd = np.random.RandomState(12)
    base, other = (rnd.randint(0, 256, (30, 30)).repeat(8, 0).repeat(8, 1) for _ in range(2))
    images = [base, np.rot90(base), np.rot90(base, 2)[20:, 30:], base.repeat(2, 0).repeat(2, 1), other, rnd.randint(0, 256, (30, 30)).repeat(8, 0).repeat(8, 1)]
    rows = [(i, im.shape[1], bytearray(np.ascontiguousarray(im).astype(np.uint8).tobytes())) for i, im in enumerate(images)]
    got = {r["id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "id long, width int, pixels binary")).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 0, 0, 4, 5]


def test_classes_of_copies_are_those_of_equal_keys(spark):
    """Against plain Python: words by brute force, keys of every image, and what they link."""
    rnd = np.random.RandomState(2)
    pool = [rnd.randint(0, 256, (10, 10)).repeat(4, 0).repeat(4, 1) for _ in range(70)]
    images = [np.hstack([pool[a], pool[b]]) for a, b in rnd.randint(0, 70, (30, 2))] + [pool[0][:20], pool[1][:, 8:] * 0.8]
    images = [im.astype(np.uint8) for im in images]
    points = media.all_keypoints(images)
    prints = {p[4] for ps in points for p in ps}
    plain = lambda p: p & (1 << 64) - 1
    word = {p: min((q for q in prints if plain(p ^ q).bit_count() <= media.RADIUS), key=plain) for p in prints}
    different = {(im.shape, im.tobytes()): n for n, im in enumerate(images)}.values()
    shared = {w for w in word.values() if sum(any(word[p[4]] == w for p in points[n]) for n in different) > 1}
    reach, first = list(range(len(images))), {}
    for n, ps in enumerate(points):
        keys = [("same", images[n].shape, images[n].tobytes())]
        ps = [p for p in ps if word[p[4]] in shared]
        if len(ps) > 1:
            y, x, scale, words_of, turn = (np.array(c) for c in zip(*sorted((p[1], p[0], p[2], word[p[4]], p[3]) for p in ps), strict=True))
            keys += media.pair_keys(x.astype(float), y.astype(float), scale, turn, words_of.astype(np.int64).view(np.uint64)).tolist()
        for k in keys:
            a, b = reach[n], reach[first.setdefault(k, n)]
            reach = [min(a, b) if r in (a, b) else r for r in reach]
    rows = [(i, im.shape[1], bytearray(np.ascontiguousarray(im).tobytes())) for i, im in enumerate(images)]
    got = {r["id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "id long, width int, pixels binary")).collect()}
    assert 5 < len(set(reach)) < len(images) - 3 and [len({got[i] for i in range(len(images)) if reach[i] == r}) for r in set(reach)] == [1] * len(set(reach)) and len(set(got.values())) == len(set(reach))


def test_turned_images_keep_their_descriptors():
    rnd = np.random.RandomState(7)
    image = rnd.randint(0, 256, (16, 16)).repeat(8, 0).repeat(8, 1).astype(np.uint8)
    a = [p for p in media.keypoints(image) if p[2] == 0]
    b = [p for p in media.keypoints(np.rot90(image)) if p[2] == 0]
    near = sum(any((x[4] ^ y[4]) & (1 << 64) - 1 and ((x[4] ^ y[4]) & (1 << 64) - 1).bit_count() <= 12 or x[4] == y[4] for y in b) for x in a)
    assert near >= len(a) // 2


def test_corners_close_by_and_repeated_are_kept():
    rnd = np.random.RandomState(9)
    close = 0
    for _ in range(5):
        at = [(x, y) for x, y, scale, *_ in media.keypoints(rnd.randint(0, 256, (40, 40)).repeat(4, 0).repeat(4, 1).astype(np.uint8)) if scale == 0]
        close += sum(max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 10 for i, a in enumerate(at) for b in at[:i])
    assert close > 0
    assert len(media.keypoints(np.tile(rnd.randint(0, 256, (8, 8)).repeat(4, 0).repeat(4, 1), (4, 4)).astype(np.uint8))) > 1
