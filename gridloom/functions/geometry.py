"""Boxes, points and sizes as column expressions.

Frames are explicit: norm1000 (0..1000), norm01 and pixels. Boxes are x1, y1, x2, y2 unless a name says xywh.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes, 0 without a strict overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shared = w * h
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(F.try_divide(shared, area(a) + area(b) - shared))


def iou_crowd(det: tuple[Column, ...], gt: tuple[Column, ...], crowd: Column) -> Column:
    """Overlap of two xywh boxes; over the detection's area alone where the other is a crowd region."""
    w = F.least(det[0] + det[2], gt[0] + gt[2]) - F.greatest(det[0], gt[0])
    h = F.least(det[1] + det[3], gt[1] + gt[3]) - F.greatest(det[1], gt[1])
    shared, own = w * h, det[2] * det[3]
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(F.try_divide(shared, F.when(crowd, own).otherwise(own + gt[2] * gt[3] - shared)))


def area(box: tuple[Column, ...]) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def norm_to_abs(value: Column, dim: Column) -> Column:
    """A coordinate of 0..1000 in pixels, held inside the image."""
    return F.least(F.greatest(value * dim / 1000, F.lit(0.0)), dim - 1)


def norm_to_abs_box(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """A norm1000 box in pixels with its corners in order."""
    x1, y1, x2, y2 = (norm_to_abs(v, d) for v, d in zip(box, (width, height, width, height)))
    return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)


def unscale(coords: Column, scale: Column) -> Column:
    """Coordinates of two or four numbers divided by the resize scale; others become null."""
    return F.when(F.size(coords).isin(2, 4), F.transform(coords, lambda v: v / scale))


def norm_to_pixel_span(low: Column, high: Column, dim: Column) -> Column:
    """(low, high) in whole pixels, half to even, held in 0..dim; a collapsed span is widened by one, null if it cannot be."""
    a, b = (F.least(F.greatest(F.bround(v * dim / 1000), F.lit(0)), dim).cast("int") for v in (low, high))
    collapsed = F.when(b < dim, F.struct(a.alias("low"), (b + 1).alias("high"))).when(a > 0, F.struct((a - 1).alias("low"), b.alias("high")))
    return F.when(b > a, F.struct(a.alias("low"), b.alias("high"))).when(b == a, collapsed)


def to_norm1000(box: tuple[Column, ...], width: Column, height: Column, kind: Column) -> Column:
    """A box of named or guessed kind (pixel, norm01, norm1000) as whole 0..1000 numbers; null without area or if not finite."""
    finite = F.lit(True)
    for v in box:
        finite &= F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    most = F.greatest(*[F.abs(v) for v in box])
    name = F.lower(F.coalesce(kind, F.lit("")))
    small = most <= 1.5
    factors = [F.when(name.contains("norm1000"), F.lit(1.0)).when(name.contains("norm01") | ((name != "pixel") & small), F.lit(1000.0)).when(name == "pixel", 1000.0 / d).when(most <= 1000, F.lit(1.0)).otherwise(1000.0 / d) for d in (width, height)]
    xs, ys = (F.array_sort(F.array(box[i] * f, box[i + 2] * f)) for i, f in enumerate(factors))
    whole = lambda v: F.least(F.greatest(F.bround(v), F.lit(0.0)), F.lit(1000.0)).cast("int")
    x1, y1, x2, y2 = whole(xs[0]), whole(ys[0]), whole(xs[1]), whole(ys[1])
    return F.when(finite & (x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def size_bucket(pixels: Column) -> Column:
    """small, medium or large by area, as usual for detection scores."""
    return F.when(pixels < 32 * 32, "small").when(pixels < 96 * 96, "medium").otherwise("large")


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 10, "6-10").when(n <= 15, "11-15").when(n <= 20, "16-20").otherwise("20+")


def point_in_box(x: Column, y: Column, box: tuple[Column, ...]) -> Column:
    """Whether a point lies in a box or on its border, whatever the order of the corners."""
    return x.between(F.least(box[0], box[2]), F.greatest(box[0], box[2])) & y.between(F.least(box[1], box[3]), F.greatest(box[1], box[3]))


def center(box: tuple[Column, ...]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def crop_span(low: Column, high: Column, dim: Column) -> Column:
    """(low, high) of a crop in whole pixels of an image, at least one pixel wide."""
    a = F.least(F.greatest(F.bround(low), F.lit(0)), dim - 1).cast("int")
    b = F.least(F.greatest(F.bround(high), F.lit(0)), dim).cast("int")
    return F.struct(a.alias("low"), F.greatest(b, a + 1).alias("high"))


def resize_short_side(width: Column, height: Column, short: int, longest: int) -> Column:
    """(scale, width, height) after the short side is brought to a length, held back by the longest side allowed."""
    scale = F.least(F.lit(float(short)) / F.least(width, height), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(scale.alias("scale"), F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def resize_long_edge(width: Column, height: Column, longest: int) -> Column:
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(scale.alias("scale"), F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def patch_grid(width: Column, height: Column, patch: int = 14, merge: int = 2, most_tokens: int = 25600) -> Column:
    """(columns, rows, tokens) of the patches of an image that is scaled to a token limit and padded to whole cells."""
    tokens = (width / patch) * (height / patch)
    scale = F.when(tokens > most_tokens, F.sqrt(F.lit(float(most_tokens)) / tokens)).otherwise(1.0)
    cell = patch * merge
    side = lambda d: (F.ceil(F.floor(d * scale) / cell) * merge).cast("int")
    columns, rows = side(width), side(height)
    return F.struct(columns.alias("columns"), rows.alias("rows"), F.floor(columns * rows / (merge * merge)).cast("int").alias("tokens"))


def frame_indices(total: Column, fps: Column, target_fps: float, most: int) -> Column:
    """Evenly spaced frame numbers of a clip sampled at a rate, from 1 to ``most`` of them."""
    n = F.least(F.greatest(F.bround(total / fps * target_fps), F.lit(1.0)), F.lit(float(most)), total).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, F.lit(0)).otherwise(F.bround(i * (total - 1) / (n - 1)).cast("int")))


def pixel_cap(frames: Column, height: Column, width: Column, budget: int) -> Column:
    """The scale that keeps frames x height x width within a budget, 1 if it does."""
    pixels = frames * height * width
    return F.when(pixels > budget, F.sqrt(F.lit(float(budget)) / pixels)).otherwise(1.0)


def oks(gt: Column, pred: Column, pixels: Column, sigma: float = 0.025) -> Column:
    """Keypoint similarity over the named points that both maps have; 0 without area or shared points."""
    shared = F.filter(F.map_keys(gt), lambda k: F.array_contains(F.map_keys(pred), k))
    far = lambda k: F.pow(gt[k][0] - pred[k][0], 2) + F.pow(gt[k][1] - pred[k][1], 2)
    total = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.exp(-far(k) / (F.lit(2 * sigma * sigma) * pixels)))
    return F.when((pixels <= 0) | (F.size(shared) == 0), 0.0).otherwise(total / F.size(shared))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def stable_fraction(text: Column, seed: Column) -> Column:
    """A number in 0..1 that depends on a seed and a text alone (53-bit part of a sha2 digest)."""
    digest = F.sha2(F.concat(seed.cast("string"), F.lit(":"), text), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def digest_fraction(text: Column, seed: int) -> Column:
    """A number in 0..1 from the eight-byte BLAKE2b digest of the seed, a zero and the text: splits as tools with that digest make them.

    No such digest is in the JVM, so texts go through Python in batches; stable_fraction is the faster one where the very split does not matter.
    """

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        head = f"{seed}\0".encode()
        one = lambda t: int.from_bytes(hashlib.blake2b(head + t.encode(), digest_size=8).digest(), "big") / float(1 << 64)
        return texts.map(one, na_action="ignore").astype("float64")

    return run(text)
