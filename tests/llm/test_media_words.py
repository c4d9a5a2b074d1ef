"""Descriptors within the radius have a word in common, others have none."""

import numpy as np

from lodestar.llm import media


def test_descriptors_with_different_smallest_words_are_linked(spark, monkeypatch):
    """1 is within a bit of 0, 3 is within a bit of 1, not of 0: their smallest words are 0 and 1."""
    end = 0x0F0F_3C3C_5A5A_6699
    pictures = {10: [1, end], 11: [3, end], 12: [0], 13: [15, end]}
    rows = [(n, bytearray([n]), [(10.0 + 20 * i, 10.0, 0, 0, d) for i, d in enumerate(ds)]) for n, ds in pictures.items()]
    made = spark.createDataFrame(rows, f"id long, same binary, points array<struct<{media.POINT}>>")
    monkeypatch.setattr(media, "described", lambda images, decode: made)
    images = spark.createDataFrame([], "id long, width int, pixels binary")
    assert {r["id"]: r["class_id"] for r in media.copies(images).collect()} == {10: 10, 11: 10, 12: 12, 13: 13}


def test_words_are_those_of_near_pairs(spark):
    rnd = np.random.RandomState(5)
    fps = rnd.randint(-(1 << 62), 1 << 62, 40)
    fps = np.unique(np.concatenate([fps, *(fps ^ (1 << rnd.randint(0, 62, 40)) for _ in range(3)), fps[:20] ^ 5]))
    rows = [(int(f), int(rnd.randint(1, 4)), int(low), int(low + rnd.randint(0, 2))) for f, low in zip(fps, rnd.randint(0, 4, len(fps)))]
    seen = {r[0]: r[2:] for r in rows}
    got = {r["descriptor"]: r for r in media._words(spark.createDataFrame(rows, "fp long, n long, low long, high long").localCheckpoint(), 1).collect()}
    words = {f: set(got[f]["words"]) if f in got else set() for f in seen}
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for a in seen:
        assert a in words[a] or seen[a][0] == seen[a][1]
        if a in got:
            assert got[a]["least"] == min((b for b in seen if bits(a, b) <= 1), key=lambda x: x & (1 << 64) - 1)
        for b in seen:
            several = len({*seen[a], *seen[b]}) > 1
            assert a == b or bool({a, b} & words[a] & words[b]) == (bits(a, b) <= 1 and several)
