import random
from pathlib import Path

import pytest

from gridloom.operators import cells, layout
from gridloom.operators.coco import AREAS, MOST_DETECTIONS
from gridloom.operators.metrics import THRESHOLDS
from gridloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "image_id long, cat string, detected boolean, ord int, x1 double, y1 double, x2 double, y2 double, score double, box_id long, crowd boolean, ignore boolean, open boolean"


def made(seed, images, score):
    rng, rows = random.Random(seed), []
    for i in range(images):
        for c in "ab":
            for k in range(rng.randrange(4)):
                x, y, w = rng.choice([0, 10, 200]), rng.choice([0, 8]), rng.choice([20, 60, 120])
                box = (float(x), float(y), float(x + w), float(y + w))
                rows.append((i, c, False, k, *box, None, i * 10 + k, rng.random() < 0.2, rng.random() < 0.2, False))
                for d in range(rng.randrange(3)):
                    rows.append((i, c, True, 4 * k + d, *(v + rng.choice([0, 0, 2, 4]) for v in box), score(rng), None, False, False, c == "a" and i % 5 == 0))
    return rows


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    size = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / (size(a) + size(b) - w * h)


def by_hand(rows, cat, t, low, high):
    """(average precision, recalls) of a cell, None without positives."""
    flags, positives = [], 0
    off = lambda r: not low <= (r[6] - r[4]) * (r[7] - r[5]) <= high
    for i in sorted({r[0] for r in rows}):
        gt = sorted(r for r in rows if r[:3] == (i, cat, False))
        out = {r[3]: r[10] or r[11] or off(r) for r in gt}
        positives += sum(not v for v in out.values())
        used = set()
        for rank, d in enumerate(sorted((r for r in rows if r[:3] == (i, cat, True)), key=lambda r: (-r[8], r[3])), 1):
            free = [(out[g[3]], -iou(g[4:8], d[4:8]), -g[3], g) for g in gt if g[3] not in used and iou(g[4:8], d[4:8]) >= t]
            g = min(free)[3] if free else None
            if g and not g[10]:
                used.add(g[3])
            hit = bool(g and g[9] != 0)
            ignored = bool(g and out[g[3]]) or not hit and (off(d) or d[12])
            flags.append((-d[8], i, rank, hit and not ignored, not ignored))
    if not positives:
        return None
    curve, tp, seen = [], 0, 0
    for *_, hit, counts in sorted(flags):
        tp, seen = tp + hit, seen + counts
        if counts:
            curve.append((tp / positives, tp / seen))
    levels = [max((p for r, p in curve if r > k * 0.01), default=0.0) for k in range(101)]
    return sum(levels) / 101, [sum(h for *_, rank, h, _ in flags if rank <= m) / positives for m in MOST_DETECTIONS]


@pytest.mark.parametrize("score", [lambda rng: rng.choice([0.25, 0.5, 0.75]), lambda rng: rng.choice([0.5, 0.75]) + rng.random() / 9000, lambda rng: rng.random()])
def test_against_a_loop(spark, monkeypatch, score):
    monkeypatch.setattr(cells, "CHUNK", 40)  # many parts of the images, so bins of several scores meet across parts
    rows = made(3, 60, score)
    boxes = spark.createDataFrame(rows, SCHEMA).repartitionByRange(3, "image_id").sortWithinPartitions("image_id")
    found = cells.cell_rows(boxes).cache()
    ap = {(r.cat, r.threshold, r.area): r.ap for r in cells.cell_precisions(found).collect()}
    recall = {(r.cat, r.threshold, r.area, r.most): r.recall for r in cells.cell_recalls(found).collect()}
    found.unpersist()
    for cat in "ab":
        for t in THRESHOLDS:
            for area, low, high in AREAS:
                want = by_hand(rows, cat, t, low, high)
                assert (want is None) == ((cat, t, area) not in ap)
                if want:
                    assert abs(ap[cat, t, area] - want[0]) < 1e-9, (cat, t, area)
                    assert [recall[cat, t, area, m] for m in MOST_DETECTIONS] == pytest.approx(want[1])


def test_rows_out_of_order_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(cells, "CHUNK", 40)
    boxes = spark.createDataFrame(made(3, 60, lambda rng: 0.5), SCHEMA).coalesce(1).sortWithinPartitions("image_id", ascending=False)
    with pytest.raises(Exception, match="images must rise"):
        cells.cell_rows(boxes).collect()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["a14_coco_cell_ap", "a16_lvis_table", "a15_coco_table", "a17_standard_table"])
def test_no_row_by_detection_and_cell_is_kept(spark, monkeypatch, name):
    kept, cut = [], layout.cut
    monkeypatch.setattr("gridloom.plans.detection.cut", lambda df: kept.append(cut(df)) or kept[-1])
    assert registry.queries()[name](spark, FOLDER).count()
    assert sum(df.count() for df in kept) < 1000  # some 5,000 detections in 40 cells each


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["j8_cell_grid", "a13_coco_cells"])
def test_counts_join_no_rows_by_detection_and_cell(spark, name):
    assert "Join" not in registry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
