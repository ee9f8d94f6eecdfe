import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import masks as R

MASK = st.integers(1, 9).flatmap(lambda h: st.integers(1, 9).flatmap(lambda w: st.lists(st.integers(0, 1), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))))


@settings(max_examples=200, deadline=None)
@given(MASK)
def test_round_trips(mask):
    runs = R.encode(mask)
    assert (R.decode(runs, *mask.shape) == mask).all() and R.from_string(R.to_string(runs)) == runs
    assert R.area(runs) == mask.sum()
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            assert R.holds_point(runs, *mask.shape, x + 0.4, y + 0.4) == bool(mask[y, x])
    assert not R.holds_point(runs, *mask.shape, mask.shape[1], 0)


@settings(max_examples=100, deadline=None)
@given(MASK, st.randoms())
def test_iou_against_arrays(mask, rng):
    other = np.array([[rng.randint(0, 1) for _ in row] for row in mask])
    union = (mask | other).sum()
    assert np.isclose(R.iou(R.encode(mask), R.encode(other)), (mask & other).sum() / union if union else 0)
    assert np.isclose(R.iou(R.encode(mask), R.encode(other), True), (mask & other).sum() / mask.sum() if mask.sum() else 0)
    assert R.iou([4], [5]) == -1


@settings(max_examples=100, deadline=None)
@given(st.tuples(*[st.integers(-2, 12)] * 4))
def test_boxes(box):
    x1, y1, x2, y2 = box
    mask = np.zeros((8, 10), dtype=int)
    mask[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)] = 1
    runs = R.box_runs(x1, y1, x2, y2, 8, 10)
    assert (R.decode(runs, 8, 10) == mask).all()
    if mask.any():
        ys, xs = np.nonzero(mask)
        x, y, w, h = R.bounds(R.encode(mask), 8)
        assert (x, w) == (xs.min(), xs.max() - xs.min() + 1)
        assert y <= ys.min() and y + h >= ys.max() + 1


def test_polygons():
    square = [0, 0, 2, 0, 2, 2, 0, 2]
    assert R.convex_iou(square, square) == 1 and R.convex_iou(square, [1, 1, 3, 1, 3, 3, 1, 3]) == 1 / 7
    assert R.convex_iou(square, square[::-1]) == 1 and R.convex_iou(square, [0, 0, 1, 1]) == 0 and R.convex_iou(square, [5, 5, 6, 5, 6, 6]) == 0
    assert np.isclose(R.convex_iou(square, [0, 0, 2, 0, 0, 2]), 0.5)


def test_many_pairs_at_once_are_as_one_by_one(spark):
    rng = np.random.default_rng(5)

    def mask():
        cuts = np.sort(rng.choice(121, rng.integers(1, 9), replace=False))
        return np.diff(np.concatenate([[0], cuts, [120]])).tolist()

    a, b, crowd = [mask() for _ in range(300)] + [[5, 5]], [mask() for _ in range(300)] + [[120]], rng.random(301) < 0.3
    want = [R.iou(x, y, c) for x, y, c in zip(a, b, crowd)]
    assert np.allclose(R.iou_batch(a, b, crowd), want) and len(R.iou_batch([], [], np.zeros(0, bool))) == 0
    rows = [(*rng.integers(-3, 14, 2).tolist(), *rng.integers(0, 16, 2).tolist()) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int").select("*", R.box_to_rle(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 10, 12).alias("runs"))
    assert all(r.runs == R.box_runs(r.a, r.b, r.c, r.d, 10, 12) for r in df.collect())
    some = spark.createDataFrame([(a[0], b[0], False), (None, b[0], True), (a[1], b[1], None)], "a array<int>, b array<int>, c boolean").select(R.iou_rle(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()
    assert [r.v is None for r in some] == [False, True, False]
