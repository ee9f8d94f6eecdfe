"""Masks as column-major run lengths, and polygons, for pandas UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


MASKS_A_BATCH = 2000

def encode(mask: np.ndarray) -> list[int]:
    """Run lengths of a 0/1 array in column order, beginning with zeros."""
    flat = np.asarray(mask, dtype=np.uint8).ravel(order="F")
    if not len(flat):
        return [0]
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(flat)]])).tolist()
    return runs if flat[0] == 0 else [0, *runs]


def decode(runs: list[int], height: int, width: int) -> np.ndarray:
    values = np.repeat(np.arange(len(runs)) % 2, runs).astype(np.uint8)
    return values.reshape((height, width), order="F")


def to_string(runs: list[int]) -> str:
    """The compact text of run lengths: differences to the run two before, five bits a letter, low bits first."""
    out = []
    for i, run in enumerate(runs):
        x = run - runs[i - 2] if i > 2 else run
        while True:
            bits = x & 0x1F
            x >>= 5
            more = not (x == 0 and not bits & 0x10 or x == -1 and bits & 0x10)
            out.append(chr((bits | 0x20 if more else bits) + 48))
            if not more:
                break
    return "".join(out)


def from_string(text: str) -> list[int]:
    runs, at = [], 0
    while at < len(text):
        x = shift = 0
        while True:
            c = ord(text[at]) - 48
            x |= (c & 0x1F) << shift
            shift += 5
            at += 1
            if not c & 0x20:
                if c & 0x10:
                    x |= -1 << shift
                break
        runs.append(x + runs[-2] if len(runs) > 2 else x)
    return runs


def area(runs) -> int:
    return int(sum(runs[1::2]))


def box_runs(x1: int, y1: int, x2: int, y2: int, height: int, width: int) -> list[int]:
    """Run lengths of a filled box."""
    x1, x2, y1, y2 = max(x1, 0), min(x2, width), max(y1, 0), min(y2, height)
    if x2 <= x1 or y2 <= y1:
        return [height * width]
    rows, runs = y2 - y1, [x1 * height + y1]
    for _ in range(x2 - x1 - 1):
        runs += [rows, height - rows]
    runs += [rows, height * width - ((x2 - 1) * height + y2)]
    if rows == height:
        return [x1 * height, (x2 - x1) * height, height * width - x2 * height]
    return runs


def bounds(runs, height: int) -> tuple[int, int, int, int]:
    """x, y, width and height of the box around a mask."""
    ends = np.cumsum(runs)
    starts, stops = ends[0::2][: len(runs) // 2], ends[1::2]
    keep = stops > starts
    starts, stops = starts[keep], stops[keep] - 1
    if not len(starts):
        return 0, 0, 0, 0
    x1, x2 = int((starts // height).min()), int((stops // height).max())
    spans = stops // height > starts // height
    y1 = 0 if spans.any() else int((starts % height).min())
    y2 = height - 1 if spans.any() else int((stops % height).max())
    return x1, y1, x2 - x1 + 1, y2 - y1 + 1


def iou(a, b, crowd: bool = False) -> float:
    """Overlap of two masks of one size by merging their runs; over the first one's area if the second is a crowd; -1 for other sizes."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    if ends_a[-1] != ends_b[-1]:
        return -1.0
    edges = np.unique(np.concatenate([[0], ends_a, ends_b]))
    left, size = edges[:-1], np.diff(edges)
    on_a = np.searchsorted(ends_a, left, side="right") % 2 == 1
    on_b = np.searchsorted(ends_b, left, side="right") % 2 == 1
    shared, whole = int(size[on_a & on_b].sum()), int(size[on_a].sum() if crowd else size[on_a | on_b].sum())
    return shared / whole if whole else 0.0


def _marked(masks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends of all runs within their mask, the first run of each mask, pixels of each mask)"""
    lengths = np.fromiter(map(len, masks), dtype=np.int64, count=len(masks))
    first = np.concatenate([[0], np.cumsum(lengths)])
    reach = np.concatenate([[0], np.cumsum(np.concatenate(masks).astype(np.int64))])
    before = reach[first[:-1]]
    return reach[1:] - np.repeat(before, lengths), first, reach[first[1:]] - before


def iou_batch(a: list, b: list, crowd: np.ndarray) -> np.ndarray:
    """iou of many pairs of masks at once: all runs are merged in one sorted line, on which each pair has a stretch of its own."""
    if not a:
        return np.zeros(0)
    (ends_a, first_a, pixels_a), (ends_b, first_b, pixels_b) = _marked(a), _marked(b)
    step = int(max(pixels_a.max(), pixels_b.max())) + 1
    ends_a += np.repeat(np.arange(len(a)) * step, np.diff(first_a))
    ends_b += np.repeat(np.arange(len(b)) * step, np.diff(first_b))
    edges = np.unique(np.concatenate([np.arange(len(a)) * step, ends_a, ends_b]))
    left, size = edges[:-1], np.diff(edges)
    pair = left // step
    on = lambda ends, first: (np.searchsorted(ends, left, side="right") - first[pair]) % 2 == 1
    inside = left - pair * step < pixels_a[pair]
    on_a, on_b = on(ends_a, first_a) & inside, on(ends_b, first_b) & inside
    total = lambda chosen: np.bincount(pair[chosen], weights=size[chosen], minlength=len(a))
    shared, whole = total(on_a & on_b), np.where(crowd, total(on_a), total(on_a | on_b))
    return np.where(pixels_a != pixels_b, -1.0, np.where(whole > 0, shared / np.where(whole > 0, whole, 1), 0.0))


def holds_point(runs, height: int, width: int, x: float, y: float) -> bool:
    column, row = int(x), int(y)
    if not (0 <= column < width and 0 <= row < height):
        return False
    return bool(np.searchsorted(np.cumsum(runs), column * height + row, side="right") % 2)


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def convex_iou(a, b) -> float:
    """Overlap of two convex polygons given as flat coordinates; 0 with fewer than three corners or no area."""
    if len(a) < 6 or len(b) < 6:
        return 0.0
    p, q = (np.asarray(v, dtype=float)[: len(v) // 2 * 2].reshape(-1, 2) for v in (a, b))
    p, q = (v if polygon_area(v) > 0 else v[::-1] for v in (p, q))
    area_p, area_q, out = polygon_area(p), polygon_area(q), p
    if area_p <= 0 or area_q <= 0:
        return 0.0
    for start, end in zip(q, np.roll(q, -1, axis=0)):
        if not len(out):
            return 0.0
        side = (end[0] - start[0]) * (out[:, 1] - start[1]) - (end[1] - start[1]) * (out[:, 0] - start[0])
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if (side[i] >= 0) != (side[j] >= 0):
                kept.append(out[i] + (out[j] - out[i]) * (side[i] / (side[i] - side[j])))
        out = np.array(kept).reshape(-1, 2)
    shared = abs(polygon_area(out)) if len(out) > 2 else 0.0
    return shared / (area_p + area_q - shared)


def iou_rle(a: Column, b: Column, crowd: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series, c: pd.Series) -> pd.Series:
        known = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        out = np.full(len(x), np.nan)
        for at in range(0, len(known), MASKS_A_BATCH):
            rows = known[at : at + MASKS_A_BATCH]
            out[rows] = iou_batch(x.iloc[rows].tolist(), y.iloc[rows].tolist(), c.iloc[rows].fillna(False).to_numpy(dtype=bool))
        return pd.Series(out).where(~np.isnan(out), None)

    return run(a, b, crowd)


def iou_polygon(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if p is None or q is None else convex_iou(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def rle_area(runs: Column) -> Column:
    """Area of run lengths, without leaving the JVM."""
    return F.aggregate(F.transform(runs, lambda r, i: F.when(i % 2 == 1, r.cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, r: s + r)


def box_to_rle(x1: Column, y1: Column, x2: Column, y2: Column, height: int, width: int) -> Column:
    """Run lengths of a filled box, column by column, without leaving the JVM; a box without pixels gives one empty run."""
    whole = height * width
    left, right = F.greatest(x1.cast("int"), F.lit(0)), F.least(x2.cast("int"), F.lit(width))
    top, bottom = F.greatest(y1.cast("int"), F.lit(0)), F.least(y2.cast("int"), F.lit(height))
    rows = bottom - top
    between = F.flatten(F.array_repeat(F.array(rows, height - rows), right - left - 1))
    runs = F.concat(F.array(left * height + top), between, F.array(rows, whole - ((right - 1) * height + bottom)))
    full = F.array(left * height, (right - left) * height, whole - right * height)
    return F.when((right <= left) | (bottom <= top), F.array(F.lit(whole))).when(rows == height, full).otherwise(runs)


def mask_holds_point(runs: Column, x: Column, y: Column, height: int, width: int) -> Column:
    @F.pandas_udf("boolean")
    def run(r: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([holds_point(m, height, width, p, q) for m, p, q in zip(r, a, b)])

    return run(runs, x, y)
