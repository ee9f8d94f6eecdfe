"""Detection scores over cells of overlap threshold, area range and number of detections, made an image at a time.

The rules are those of COCO and LVIS: a detection is a hit in a cell if it takes an annotated box that counts there; it is left out of
account if it takes an ignored box, or none while its own area is out of range. A box is ignored if it is marked so, is a crowd, or has
an area out of range. A box with id 0 can be taken but counts as not taken, as in the tools that read an id of 0 as "none".

A detection has a bit for each of the 40 cells, so all cells are matched at once, and what leaves an image is two numbers a detection. Rows
by detection and cell are never made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.coco import AREAS, MOST_DETECTIONS
from gridloom.operators.metrics import SCORE_BINS, THRESHOLDS

CELLS, N_AREAS = len(THRESHOLDS) * len(AREAS), len(AREAS)  # a cell's number is that of its threshold times N_AREAS plus that of its area
LEVELS, CHUNK = 101, 131_072
ALL = np.int64((1 << CELLS) - 1)
BOX = ("x1", "y1", "x2", "y2")
COLUMNS = ("image_id", "cat", "detected", "ord", *BOX, "score", "box_id", "crowd", "ignore", "open")


def _mask(cells: Iterator[int]) -> np.int64:
    return np.int64(sum(1 << c for c in cells))


def _outside(size: np.ndarray) -> np.ndarray:
    """The cells whose area range does not hold a size."""
    out = np.zeros(len(size), np.int64)
    for a, (_, low, high) in enumerate(AREAS):
        out |= np.where((size < low) | (size > high), _mask(range(a, CELLS, N_AREAS)), 0)
    return out


def _match(gt: dict, det: dict, n_cats: int) -> tuple[np.ndarray, np.ndarray]:
    """(hit, out) of each detection, a bit a cell. Both sides are in the order of image, category and rank."""
    hit, out, done = (np.zeros(len(det["ord"]), np.int64) for _ in range(3))
    ignored = np.where(gt["ignore"] | gt["crowd"], ALL, _outside(gt["size"]))
    keys = gt["image"] * n_cats + gt["cat"]
    low, high = (np.searchsorted(keys, det["image"] * n_cats + det["cat"], side) for side in ("left", "right"))
    n = np.where(det["cat"] < 0, 0, high - low)
    d = np.repeat(np.arange(len(n)), n)
    g = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    w, h = (np.minimum(gt[b][g], det[b][d]) - np.maximum(gt[a][g], det[a][d]) for a, b in (("x1", "x2"), ("y1", "y2")))
    shared = np.where((w <= 0) | (h <= 0), 0.0, w * h)
    with np.errstate(divide="ignore", invalid="ignore"):
        iou = np.where(shared > 0, shared / (gt["size"][g] + det["size"][d] - shared), 0.0)
    near = iou >= THRESHOLDS[0]
    d, g, iou = d[near], g[near], iou[near]
    at = np.lexsort((-g, -iou, d))  # of a detection the greater overlap, the later box of equals
    d, g, iou = d[at], g[at], iou[at]
    above = np.array([(1 << k * N_AREAS) - 1 for k in range(len(THRESHOLDS) + 1)], np.int64)[np.searchsorted(THRESHOLDS, iou, "right")]
    turn = np.arange(len(d)) - np.searchsorted(d, d, "left")
    used, reusable = np.zeros(len(keys), np.int64), gt["crowd"]
    # Detections of a rank are of different images or categories, so they take their boxes at once: one edge each in a turn.
    for ranked in _split(det["rank"][d]):
        turns = [ranked[x] for x in _split(turn[ranked])]
        for of in (~ignored, ignored):  # boxes that count before ignored ones
            for e in turns:
                i, j = d[e], g[e]
                taken = above[e] & ~used[j] & ~done[i] & of[j]
                done[i] |= taken
                used[j] |= np.where(reusable[j], 0, taken)
                hit[i] |= np.where(gt["real"][j], taken, 0)
                out[i] |= taken & ignored[j]
    out |= _outside(det["size"]) & ~hit
    return hit, out | np.where(det["open"], ALL & ~hit, 0)


def _split(values: np.ndarray) -> list[np.ndarray]:
    """The places of each value, values rising."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(order) else []


def _bit_sums(masks: np.ndarray, starts: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """(start, cell): how many masks from a start to the next have the cell's bit."""
    if not len(masks):
        return np.zeros((len(starts), CELLS), np.int64)
    bits = (((masks >> c) & 1) if keep is None else ((masks >> c) & keep) for c in range(CELLS))
    return np.stack([np.add.reduceat(b, starts) for b in bits], axis=1)


def _of_chunk(t: pa.Table, schema: pa.Schema, curves: bool) -> pa.RecordBatch:
    """Sums by category and, for curves, the masks by category and bin of scores; t has whole images."""
    coded = t["cat"].combine_chunks().dictionary_encode()
    names = coded.dictionary
    cat = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    col = {c: t[c].to_numpy() for c in ("image_id", "ord", *BOX, "score", "box_id")} | {c: pc.fill_null(t[c], False).to_numpy() for c in ("detected", "crowd", "ignore", "open")}
    first, image = np.unique(col["image_id"], return_inverse=True)
    col |= {"image": image.astype(np.int64), "cat": cat, "size": (col["x2"] - col["x1"]) * (col["y2"] - col["y1"]), "real": pc.fill_null(pc.not_equal(t["box_id"], 0), False).to_numpy()}
    side = lambda places, *by: {c: v[at] for at in [places[np.lexsort([x[places] for x in (*reversed(by), cat, image)])]] for c, v in col.items()}
    gt, det = side(np.flatnonzero(~col["detected"]), col["ord"]), side(np.flatnonzero(col["detected"]), -col["score"], col["ord"])
    new = np.flatnonzero(np.diff(det["image"] * (len(names) + 1) + det["cat"], prepend=-2))
    det["rank"] = np.arange(len(det["ord"])) - np.repeat(new, np.diff(new, append=len(det["ord"]))) + 1
    det = {c: v[det["rank"] <= max(MOST_DETECTIONS)] for c, v in det.items()}
    hit, out = _match(gt, det, len(names) + 1)

    order = np.lexsort((det["rank"], det["image"], -det["score"], det["cat"]))
    seen, score, cats, rank = ~out[order] & ALL, det["score"][order], det["cat"][order], det["rank"][order]
    tp, rows = hit[order] & seen, []
    new = np.flatnonzero(np.diff(cats, prepend=-2))
    sums = [np.stack([_bit_sums(m, new, (rank <= most).astype(np.int64)) for most in MOST_DETECTIONS], axis=2) for m in (seen, tp)]
    counts = dict(zip(cats[new].tolist(), zip(np.diff(new, append=len(cats)).tolist(), *sums)))
    empty = (0, *[np.zeros((CELLS, len(MOST_DETECTIONS)), np.int64)] * 2)
    countable = ~(gt["ignore"] | gt["crowd"])
    within = ~_outside(gt["size"])
    positives = np.stack([np.bincount(gt["cat"][countable] + 1, (within[countable] >> a) & 1, len(names) + 1) for a in range(N_AREAS)], axis=1).astype(np.int64)
    name = lambda c: None if c < 0 else names[c].as_py()
    for c in sorted({*counts, *gt["cat"].tolist()}):
        n, s, h = counts.get(c, empty)
        rows.append((name(c), None, None, n, None, None, positives[c + 1].tolist(), s.ravel().tolist(), h.ravel().tolist(), None))
    if curves and len(cats):
        bins = -np.floor(score * SCORE_BINS).astype(np.int64)
        new = np.flatnonzero((np.diff(cats, prepend=-2) != 0) | (np.diff(bins, prepend=bins[0] - 1) != 0))
        s, h = _bit_sums(seen, new), _bit_sums(tp, new)
        for k, (a, b) in enumerate(zip(new, np.append(new[1:], len(cats)))):
            flat = score[a] == score[b - 1]
            flags = zlib.compress(tp[a:b].tobytes() + seen[a:b].tobytes() + (b"" if flat else score[a:b].tobytes()), 1)
            rows.append((name(cats[a]), bins[a], first[0], b - a, score[b - 1], score[a], None, s[k].tolist(), h[k].tolist(), flags))
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def cell_rows(boxes: DataFrame, curves: bool = True) -> DataFrame:
    """Sums over all cells by category and part of the images (bin is null), and for curves the masks of the detections by bin of scores.

    boxes has COLUMNS: annotated boxes (box_id, crowd, ignore) and detections (score) of images, open where an unmatched detection
    is out of account. An image's rows follow each other in one partition, and partitions hold ranges of image_id, rising within.
    Sums have a number for each cell and, where bin is null, for each of MOST_DETECTIONS within it.
    """
    kind, image = boxes.schema["cat"].dataType.simpleString(), boxes.schema["image_id"].dataType.simpleString()
    numbers = pa.list_(pa.int64())
    out = pa.schema([("cat", pa.string()), ("bin", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("positives", numbers), ("seen", numbers), ("hits", numbers), ("flags", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK:
                t = pa.Table.from_batches(held)
                images = t["image_id"].to_numpy()
                if (np.diff(images) < 0).any():
                    raise ValueError("images must rise within a partition")
                whole = int(np.searchsorted(images, images[-1]))  # the last image may go on
                if whole:
                    yield _of_chunk(t.slice(0, whole), out, curves)
                held = t.slice(whole).to_batches()
        if sum(map(len, held)):
            yield _of_chunk(pa.Table.from_batches(held), out, curves)

    if (kind, image) != ("string", "bigint"):
        raise TypeError("cat must be a string and image_id a bigint")
    listed = "array<bigint>"
    return boxes.select(*COLUMNS).mapInArrow(of, f"cat string, bin bigint, first bigint, n bigint, low double, high double, positives {listed}, seen {listed}, hits {listed}, flags binary")


def _cell(number: Column) -> list[Column]:
    threshold, area = F.array(*map(F.lit, THRESHOLDS)), F.array(*[F.lit(a) for a, _, _ in AREAS])
    return [F.get(threshold, F.floor(number / N_AREAS).cast("int")).alias("threshold"), F.get(area, (number % N_AREAS).cast("int")).alias("area")]


def cell_counts(rows: DataFrame) -> DataFrame:
    """(cat, threshold, area, most, n, seen, hits): the detections of a category, and of the first so many of an image those in account and the hits."""
    flat = rows.filter("bin is null").select("cat", "n", F.posexplode(F.arrays_zip("seen", "hits")).alias("_at", "_v"))
    sums = flat.groupBy("cat", "_at").agg(F.sum("n").alias("n"), F.sum("_v.seen").alias("seen"), F.sum("_v.hits").alias("hits"))
    most = F.get(F.array(*map(F.lit, MOST_DETECTIONS)), (F.col("_at") % len(MOST_DETECTIONS)).cast("int")).alias("most")
    return sums.select("cat", *_cell(F.floor(F.col("_at") / len(MOST_DETECTIONS))), most, "n", "seen", "hits")


def _positives(rows: DataFrame) -> DataFrame:
    """(cat, positives): how many boxes count in each area range."""
    return rows.filter("bin is null and cat is not null").groupBy("cat").agg(F.array(*[F.sum(F.get("positives", F.lit(a))) for a in range(N_AREAS)]).alias("positives"))


def _defined(rows: DataFrame) -> DataFrame:
    """(cat, cell, positives) of the cells with any, as scores of others are undefined."""
    cells = F.inline(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.struct(c.alias("cell"), F.get("positives", (c % N_AREAS).cast("int")).alias("n"))))
    return _positives(rows).select("cat", cells).filter("n > 0")


def cell_recalls(rows: DataFrame) -> DataFrame:
    """(cat, threshold, area, most, recall): the recall with so many detections of an image and category at most."""
    wide = _defined(rows).select("cat", *_cell(F.col("cell")), "n")
    return cell_counts(rows).drop("n").join(wide, ["cat", "threshold", "area"]).select("cat", "threshold", "area", "most", (F.col("hits") / F.col("n")).alias("recall"))


def _first_hits(n: int) -> np.ndarray:
    """By level, the number of the hit whose recall is the first to exceed it."""
    levels = np.arange(LEVELS) * 0.01
    k = np.maximum(1, np.floor(levels * n).astype(np.int64) - 1)
    for _ in range(4):
        k += ~(k / n > levels)
    return k


def _curve(t: pa.Table) -> pa.Table:
    """Of the parts of a group in order, by cell: the greatest precision, and that from each level's first hit to the group's end."""
    t = t.sort_by("first")
    parts, scores = [np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in t["flags"]], []
    for part, n, low in zip(parts, t["n"].to_pylist(), t["low"].to_pylist()):
        scores.append(part[2 * n :].view(np.float64) if len(part) > 2 * n else np.full(n, low))
    order = np.argsort(-np.concatenate(scores), kind="stable")
    tp, seen = (np.concatenate([p[k * n : (k + 1) * n] for p, n in zip(parts, t["n"].to_pylist())])[order] for k in (0, 1))
    before, positives = t["before"][0].as_py(), t["positives"][0].as_py()
    targets = [_first_hits(n) if n else None for n in positives]
    rows = []
    for c in range(CELLS):
        hits = np.flatnonzero((tp >> c) & 1)
        if (first := targets[c % N_AREAS]) is None or not len(hits):
            continue
        ranks = before[c]["seen"] + np.cumsum((seen >> c) & 1)[hits]
        had = before[c]["hits"]
        ahead = np.maximum.accumulate(((had + np.arange(1, len(hits) + 1)) / (ranks + 2.2e-16))[::-1])[::-1]
        reached = first[(first > had) & (first <= had + len(hits))]
        rows.append((t["cat"][0].as_py(), c, t["bin"][0].as_py(), t["part"][0].as_py(), ahead[0], ahead[reached - had - 1].tolist()))
    types = [("cat", pa.string()), ("cell", pa.int32()), ("bin", pa.int64()), ("part", pa.int64()), ("peak", pa.float64()), ("reached", pa.list_(pa.float64()))]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(types)], names=[n for n, _ in types])


def cell_precisions(rows: DataFrame) -> DataFrame:
    """(cat, threshold, area, ap): the mean precision over the recall levels; cells without positives are absent.

    Bins follow each other by score. Where all detections of a bin have one score, so order by image, its parts of the images follow each
    other too; the parts of other bins are sorted together. Counts before a group and precisions after it come from sums over the groups.
    """
    bins, groups = rows.filter("bin is not null"), ["cat", "bin", "part"]
    spans = bins.groupBy("cat", "bin").agg((F.min("low") == F.max("high")).alias("_flat"))
    bins = bins.join(spans, ["cat", "bin"]).withColumn("part", F.when(F.col("_flat"), F.col("first")).otherwise(F.lit(0).cast("bigint")))
    sums = bins.select(*groups, F.posexplode(F.arrays_zip("seen", "hits")).alias("cell", "_v")).groupBy(*groups, "cell").agg(F.sum("_v.seen").alias("seen"), F.sum("_v.hits").alias("hits"))
    earlier = W.partitionBy("cat", "cell").orderBy("bin", "part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*groups, "cell", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("seen", "hits")])
    before = sums.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("cell", "seen", "hits"))).alias("before"))
    found = bins.select(*groups, "first", "n", "low", "flags").join(before, groups).join(_positives(rows), "cat").groupBy(*groups).applyInArrow(_curve, "cat string, cell int, bin bigint, part bigint, peak double, reached array<double>")
    later = W.partitionBy("cat", "cell").orderBy(F.col("bin").desc(), F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("_after", F.coalesce(F.max("peak").over(later), F.lit(0.0))).select("cat", "cell", F.aggregate("reached", F.lit(0.0), lambda s, p: s + F.greatest(p, "_after")).alias("_sum"))
    ap = found.groupBy("cat", "cell").agg((F.sum("_sum") / LEVELS).alias("ap"))
    return _defined(rows).join(ap, ["cat", "cell"], "left").select("cat", *_cell(F.col("cell")), F.coalesce("ap", F.lit(0.0)).alias("ap"))
