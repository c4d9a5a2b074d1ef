"""Copies of images by local descriptors.

Corners are found at several scales (small images are enlarged first); each gets an
orientation from the centre of mass around it and 64 binary tests of blurred pixels, turned
by that orientation.  Distinct descriptors are joined through Hamming tables.  A descriptor's
visual words are itself and each commoner one within ``RADIUS`` bits, so of two descriptors
within the radius one is a word of the other.  Two that only have a third as a word in common
are not taken as equal: a key tells whether a word is the descriptor itself.  (What descriptors
reach over several such steps is no word: plain patches chain into one that says nothing.)

Consensus is geometric: keypoints whose words no other image has are left out, every other
one is put together with each of its nearest ones, and the pair's keys hold a word of each, the step between their scales, and where the second
lies as seen from the first, turned and scaled by the first's own.  Two images with an equal
key, one of them with the word itself in each place, have two descriptors within the radius
of the other's that agree on one shift, scale and turn.  Equality carries over from image
to image, so all that have a key are linked to the first of them and no partner is left out;
links grow with the keypoints, not with the square of a group of copies.

Images of equal pixels are merged first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, small, spread_join, stored, together
from .components import components

SCALES = 2
ENLARGED = ((28, 2), (56, 1))  # images with a side below so many pixels are doubled up to so often
NEAR = 8  # a corner is the strongest of so many pixels around
PATCH = 8  # tests lie within this distance of a corner
TURNS = 32
RADIUS = 1
AROUND = 3  # a keypoint is put together with so many
APART = 3  # that lie so many pixels away at least, at the keypoint's scale
FEW, REACH = 256, 64
STEP = 4  # the place of the other one counts in steps of so many pixels
PIXELS = 500_000  # so many are worked on at once
POINT = "x: float, y: float, scale: int, turn: int, descriptor: long"


def _tests() -> np.ndarray:
    """(turn, test, end, axis): where to look for each orientation; the drawing is part of the format."""
    draw = np.random.RandomState(64).normal(0, PATCH / 2.5, (64, 2, 2))
    draw *= np.minimum(1, PATCH / np.maximum(1e-9, np.hypot(draw[..., 0], draw[..., 1])))[..., None]
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), np.sin(angle)], 1), np.stack([-np.sin(angle), np.cos(angle)], 1)], 2)
    return np.rint(np.einsum("txy,pky->tpkx", turn, draw)).astype(np.int64)


TESTS = _tests()
_AROUND = np.mgrid[-8:9, -8:9]
_DISC = (_AROUND**2).sum(0) <= 64
_K = np.uint64(0x9E3779B97F4A7C15)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r + 1 pixels along the last two axes; beyond the edges are zeros.

    Running sums may wrap; their differences fit, so all sums are exact.
    """
    n, height, width = 2 * r + 1, *a.shape[-2:]
    down = np.zeros((*a.shape[:-2], height + n, width), np.int32)
    np.cumsum(a, -2, np.int32, down[..., r + 1 : r + 1 + height, :])
    down[..., r + 1 + height :, :] = down[..., r + height : r + 1 + height, :]
    a = down[..., n:, :] - down[..., :-n, :]
    along = np.zeros((*a.shape[:-1], width + n), np.int32)
    np.cumsum(a, -1, np.int32, along[..., r + 1 : r + 1 + width])
    along[..., r + 1 + width :] = along[..., r + width : r + 1 + width]
    return along[..., n:] - along[..., :-n]


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """Largest value within r pixels along the last two axes, by doubling."""
    padded = np.full((*a.shape[:-2], a.shape[-2] + 2 * r, a.shape[-1] + 2 * r), -np.inf, a.dtype)
    padded[..., r:-r, r:-r] = a
    have, want = 1, 2 * r + 1
    while have < want:
        step = min(have, want - have)
        padded = np.maximum(padded[..., :-step, :], padded[..., step:, :])
        padded = np.maximum(padded[..., :, :-step], padded[..., :, step:])
        have += step
    return padded


def _corners(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, y, x, turn, descriptor) of the corners of grey images of one size, at this scale."""
    edge = PATCH + 1
    gy, gx = np.zeros_like(images), np.zeros_like(images)
    gy[:, 1:-1], gx[:, :, 1:-1] = images[:, 2:] - images[:, :-2], images[:, :, 2:] - images[:, :, :-2]
    xx, yy, xy = (_box(g, 2).astype(np.float32) for g in (gx * gx, gy * gy, gx * gy))
    strength = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
    strength[:, :edge] = strength[:, -edge:] = strength[:, :, :edge] = strength[:, :, -edge:] = -np.inf
    least = np.maximum(0, np.float32(0.01) * strength.max((1, 2), keepdims=True))
    i, y, x = np.nonzero((strength == _highest(strength, NEAR)) & (strength > least))
    around = images[i[:, None, None], y[:, None, None] + _AROUND[0], x[:, None, None] + _AROUND[1]] * _DISC
    turn = np.rint(np.arctan2((around * _AROUND[0]).sum((1, 2)), (around * _AROUND[1]).sum((1, 2))) * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
    smooth, at = _box(images, 2), TESTS[turn]
    ends = smooth[i[:, None, None], y[:, None, None] + at[..., 1], x[:, None, None] + at[..., 0]]
    bits = np.packbits(ends[..., 0] < ends[..., 1], axis=1, bitorder="little")
    return i, y, x, turn, np.ascontiguousarray(bits).view("<i8")[:, 0]


def all_keypoints(images: list[np.ndarray]) -> list[list[tuple[float, float, int, int, int]]]:
    """(x, y, scale, turn, descriptor) of each grey image, in pixels of the image.

    Images of one size are worked on together.
    """
    out: list[list] = [[] for _ in images]
    sizes: dict[tuple, list[int]] = {}
    for n, image in enumerate(images):
        sizes.setdefault(image.shape, []).append(n)
    for (height, width), members in sizes.items():
        doubled = next((k for side, k in ENLARGED if 0 < min(height, width) < side), 0)
        many = max(1, PIXELS // max(1, (height * width) << (2 * doubled)))
        for begin in range(0, len(members), many):
            part = members[begin : begin + many]
            stack = np.stack([images[n] for n in part]).astype(np.int32)
            stack = stack.repeat(1 << doubled, 1).repeat(1 << doubled, 2)
            for scale in range(-doubled, SCALES):
                h, w = stack.shape[1:]
                if min(h, w) <= 2 * (PATCH + 1):
                    break
                i, y, x, turn, words = _corners(stack)
                grow = 2.0**scale
                for n, *point in zip(i.tolist(), (x * grow).tolist(), (y * grow).tolist(), [scale] * len(i), turn.tolist(), words.tolist(), strict=True):
                    out[part[n]].append(tuple(point))
                stack = stack[:, : h // 2 * 2, : w // 2 * 2].reshape(len(part), h // 2, 2, w // 2, 2).sum((2, 4), dtype=np.int32) >> 2
    return out


def keypoints(image: np.ndarray) -> list[tuple[float, float, int, int, int]]:
    """The same of one image."""
    return all_keypoints([image])[0]


def _nearest(x: np.ndarray, y: np.ndarray, size: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, other): places of each keypoint and of each of its ``AROUND`` nearest.

    ``tie`` is added to distances and is small, so that equal ones don't hang on the order.  In an image of over ``FEW`` keypoints only those within ``REACH`` rows of pixels are looked
    at: a strip of the image, in which there are enough.
    """
    one, other = [], []
    order = np.argsort(y, kind="stable") if len(x) > FEW else np.arange(len(x))
    step = FEW if len(x) <= FEW else FEW // 4
    for begin in range(0, len(x), step):
        p = order[begin : begin + step]
        q = order
        if len(x) > FEW:
            rows = y[order]
            q = np.sort(order[np.searchsorted(rows, y[p[0]] - REACH, "left") : np.searchsorted(rows, y[p[-1]] + REACH, "right")])
        far = np.hypot(x[q][None] - x[p][:, None], y[q][None] - y[p][:, None]) / size[p][:, None]
        far[far < APART] = np.inf
        far += tie[q]
        many = min(AROUND, len(q))
        near = np.argpartition(far, many - 1, axis=1)[:, :many]
        there = np.isfinite(np.take_along_axis(far, near, 1))
        one.append(np.repeat(p, there.sum(1)))
        other.append(q[near[there]])
    return np.concatenate(one), np.concatenate(other)


def word_keys(x: np.ndarray, y: np.ndarray, scale: np.ndarray, turn: np.ndarray, least: np.ndarray, many: np.ndarray, words: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of each keypoint of an image with its nearest ones, and their kinds; each once.

    A keypoint has ``many`` of the ``words``, which come one after another; ``other`` tells
    words that are not the descriptor itself.  A kind is 2 if the first one's word is such,
    plus 1 if the second one's is.  ``least`` decides which of equally near ones is taken.
    """
    if len(x) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    size = 2.0**scale
    p, q = _nearest(x, y, size, ((least.astype(np.uint64) * _K) >> np.uint64(54)).astype(np.float64) * 1e-6)
    angle = 2 * np.pi * turn[p] / TURNS
    dx, dy, cos, sin = (x[q] - x[p]) / size[p], (y[q] - y[p]) / size[p], np.cos(angle), np.sin(angle)
    place = (scale[q] - scale[p], np.rint((cos * dx + sin * dy) / STEP), np.rint((cos * dy - sin * dx) / STEP))
    begin, made = np.cumsum(many) - many, many[p] * many[q]
    at = np.repeat(np.arange(len(p)), made)  # every word of the one with every word of the other
    nth = np.arange(len(at)) - np.repeat(np.cumsum(made) - made, made)
    one, two = begin[p[at]] + nth // many[q[at]], begin[q[at]] + nth % many[q[at]]
    key = words[one].astype(np.uint64) * _K + words[two].astype(np.uint64)
    for part in place:
        key = (key ^ (key >> np.uint64(29))) * _K + part[at].astype(np.int64).astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * _K
    key ^= key >> np.uint64(29)
    kind = (2 * other[one] + other[two]).astype(np.int32)
    order = np.lexsort((kind, key))
    key, kind = key[order], kind[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])] if len(key) else np.zeros(0, bool)
    return key[new], kind[new]


def pair_keys(x: np.ndarray, y: np.ndarray, scale: np.ndarray, turn: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The same hashes where each keypoint has one word."""
    return word_keys(x, y, scale, turn, word, np.ones(len(x), np.int64), word, np.zeros(len(x), np.int32))[0]


def grey(row: dict) -> np.ndarray | None:
    """The image of a row with ``width, pixels`` (rows of one byte a pixel); None if it is null, empty or ragged."""
    width, pixels = row["width"], row["pixels"]
    return np.frombuffer(pixels, np.uint8).reshape(-1, width) if pixels and width and len(pixels) % width == 0 else None


def described(images: DataFrame, decode: Callable[[dict], np.ndarray | None] = grey) -> DataFrame:
    """``id, same, points`` of ``images``: ``same`` is a hash of the pixels, ``points`` are the keypoints.

    ``decode`` makes a grey image of a row's other columns, on the executors, so pixels are
    neither shuffled nor sent between processes.
    """
    kind = pa.struct([("x", pa.float32()), ("y", pa.float32()), ("scale", pa.int32()), ("turn", pa.int32()), ("descriptor", pa.int64())])
    names = [x.split(": ")[0] for x in POINT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                images, same = [], []
                for row in batch.drop_columns(["id"]).to_pylist():
                    image = decode(row)
                    image = np.zeros((0, 0), np.uint8) if image is None else image
                    known = b"%d:" % image.shape[1] + image.tobytes() if image.size else repr(sorted(row.items())).encode()
                    same.append(hashlib.md5(known).digest())
                    images.append(image)
                found = [[dict(zip(names, p, strict=True)) for p in points] for points in all_keypoints(images)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(same, pa.binary()), pa.array(found, pa.list_(kind))], ["id", "same", "points"])

    return images.withColumn("id", F.col("id").cast("long")).mapInArrow(run, f"id long, same binary, points array<struct<{POINT}>>")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, points`` with words to ``row, key, kind``."""
    for batch in batches:
        rows, keys, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for row, points in zip(batch.column("row").to_pylist(), batch.column("points"), strict=True):
            *place, descriptor, words = points.values.flatten()  # lists come in no order
            x, y, scale, turn, least = (np.asarray(c) for c in place)
            order = np.lexsort((least, scale, x, y))
            words = words.take(pa.array(order))
            many, words = (np.asarray(c, np.int64) for c in (pa.compute.list_value_length(words), words.flatten()))
            other = (words != np.repeat(np.asarray(descriptor)[order], many)).astype(np.int32)
            x, y, scale, turn, least = (c[order] for c in (x.astype(np.float64), y.astype(np.float64), scale, turn, least.astype(np.int64).view(np.uint64)))
            key, kind = word_keys(x, y, scale, turn, least, many, words.view(np.uint64), other)
            rows.append(np.full(len(key), row))
            keys.append(key)
            kinds.append(kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds))], ["row", "key", "kind"])


def _all_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Every two fingerprints within ``radius`` in a group, the larger first."""
    a, b = simhash.pairs(fps, group, radius)
    return np.maximum(fps[a], fps[b]), np.minimum(fps[a], fps[b])


def _words(seen: DataFrame, radius: int) -> DataFrame:
    """``descriptor, least, words`` of the descriptors of ``seen`` that may be matched in another image.

    ``seen`` has ``fp, n, low, high``: how often a descriptor is there, in which image first
    and last.  Of two within ``radius`` in several images, the commoner one is a word of both;
    ``least`` is the smallest one within reach.
    """
    near = cut(simhash.links(seen.select("fp"), radius, within=_all_pairs).select("a", "b").distinct())
    ends = small(cut(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()))
    known = cut(seen.join(ends, "fp", "left_semi"))
    of = lambda c: small(known).select(F.col("fp").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "low", "high")))
    pairs = near.join(of("a"), "a").join(of("b"), "b")
    word = F.when(F.col("n_a") > F.col("n_b"), F.col("a")).otherwise(F.col("b"))
    pairs = pairs.select("a", "b", F.when(F.least("low_a", "low_b") < F.greatest("high_a", "high_b"), word).alias("word"))
    turned = F.array(F.struct(F.col("a").alias("fp"), F.col("b").alias("near")), F.struct(F.col("b").alias("fp"), F.col("a").alias("near")))
    own = seen.where("low < high").select("fp", F.col("fp").alias("near"), F.col("fp").alias("word"))
    least = F.least(simhash.unsigned("fp"), F.min(simhash.unsigned("near")))
    found = together(own, pairs.select("word", F.explode(turned).alias("t")).select("t.*", "word")).groupBy("fp").agg(least.alias("least"), F.collect_set("word").alias("words"))
    return found.where(F.size("words") > 0).select(F.col("fp").alias("descriptor"), simhash.unsigned("least").alias("least"), "words")


def copies(images: DataFrame, decode: Callable[[dict], np.ndarray | None] = grey, columns: tuple[str, ...] = ("width", "pixels"), radius: int = RADIUS) -> DataFrame:
    """``id, class_id, n_points`` for each row of ``images`` (``id`` and what ``decode`` needs).

    ``class_id`` is the smallest id of the class that is not null, itself included.  Rows of
    equal width and pixels are one class; null, empty or ragged images are copies only of
    their equals, and so are images with fewer than two corners.  Rows that repeat stay.  An
    empty table gives no rows; other columns are not read.
    """
    rows = stored(described(images.select("id", *columns), decode).withColumn("row", F.monotonically_increasing_id()), "described")
    merged = cut(rows.groupBy("same").agg(F.min("row").alias("row"), F.min("id").alias("first_id"), F.count("*").alias("n")))
    points = rows.join(merged.select("row"), "row", "left_semi").select("row", F.explode("points").alias("p")).select("row", "p.*")
    seen = stored(points.groupBy(F.col("descriptor").alias("fp")).agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high")), "seen")
    words = stored(_words(seen, radius), "words")
    held = points.join(words, "descriptor").groupBy("row").agg(F.collect_list(F.struct("x", "y", "scale", "turn", "least", "descriptor", "words")).alias("points"))  # as many as an image has
    keys = stored(held.mapInArrow(_keys, "row long, key long, kind int"), "keys")
    first = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("row")))
    found = keys.groupBy("key").agg(first(0).alias("both"), first(1).alias("one"), first(2).alias("two"), F.count("*").alias("n")).where("n > 1 and (both is not null or one + two is not null)")
    found = cut(found.select("key", F.coalesce("both", F.least("one", "two")).alias("first"), F.col("both").isNull().alias("across"), "n"))
    linked = spread_join(keys, found, ["key"]).where("row <> first and (not across or kind in (1, 2))").select("row", "first").distinct()
    classes = components(linked, "row", "first")
    named = cut(merged.join(classes.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row")))
    least = cut(named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count("*").alias("members")))
    named = cut(spread_join(named, least, ["label"], "members").select("same", "class_id", "n"))
    return spread_join(rows.select("id", "same", F.size("points").alias("n_points")), named, ["same"]).select("id", "class_id", "n_points")


CELL = 4  # pixels of a word along each axis


def picture(row: dict) -> np.ndarray:
    """A picture of a page's article, made from all of its words.

    A word is a square of four grey cells; there are about as many lines as words in a line.
    By the page's id, the picture is left as it is, cropped at one side or another, or has
    its contrast changed, so pages with the same article have edited copies of one picture.
    A null or empty article is one black word, a null number counts as 0.
    """
    words = (row["article"] or "").split()
    codes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))
    wide = max(1, int(np.ceil(np.sqrt(len(codes)))))
    codes = np.r_[codes, np.zeros(-len(codes) % wide, np.uint32)].reshape(-1, wide)
    cells = np.stack([np.stack([(codes >> (8 * (2 * a + b))) & 0xFF for b in (0, 1)], 2) for a in (0, 1)], 1)
    image = cells.reshape(2 * len(codes), 2 * wide).repeat(CELL // 2, 0).repeat(CELL // 2, 1).astype(np.float32)
    kind = (row["number"] or 0) % 6
    if kind == 2 and min(image.shape) > 16:
        image = image[8:, 12:]
    elif kind == 3:
        image = 0.7 * image + 30
    elif kind == 4:
        image = image[: len(image) * 3 // 4]
    elif kind == 5:
        image = 255 - 0.8 * (255 - image[:, : -16 if image.shape[1] > 20 else None])
    return image.astype(np.uint8)


def articles(pages: DataFrame) -> DataFrame:
    """``id, number, article`` of ``pages``: what ``picture`` needs."""
    text = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), "<[^>]*>", " ")
    return pages.select(F.col("page_id").cast("long").alias("id"), F.col("page_id").cast("long").alias("number"), text.alias("article"))
