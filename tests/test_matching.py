import random

from gridloom.operators.matching import iou_edges, match_coco, match_greedy, suppress
from gridloom.operators.metrics import pr_curve

EDGE = "k int, gt_ord int, pred_ord int, iou double"


def greedy(edges):
    used, out = set(), set()
    for g in sorted({e[0] for e in edges}):
        free = [(-v, p) for a, p, v in edges if a == g and p not in used]
        if free:
            p = min(free)[1]
            used.add(p)
            out.add((g, p))
    return out


def test_greedy_against_a_loop(spark):
    rng, rows = random.Random(4), []
    for k in range(60):
        rows += [(k, g, p, rng.choice([0.5, 0.6, 0.7])) for g in range(5) for p in range(5) if rng.random() < 0.6]
    got = {}
    for r in match_greedy(spark.createDataFrame(rows, EDGE), ["k"]).collect():
        got.setdefault(r.k, set()).add((r.gt_ord, r.pred_ord))
    for k in range(60):
        assert got.get(k, set()) == greedy([r[1:] for r in rows if r[0] == k])


def coco(edges):
    used, out = set(), set()
    for d in sorted({e[0] for e in edges}):
        free = [(ignore, -v, -g, crowd) for a, g, v, ignore, crowd in edges if a == d and g not in used]
        if free:
            _, _, g, crowd = min(free)
            out.add((d, -g))
            if not crowd:
                used.add(-g)
    return out


def test_coco_against_a_loop(spark):
    rng, rows = random.Random(6), []
    for k in range(60):
        flags = [(rng.random() < 0.3, rng.random() < 0.2) for _ in range(4)]
        rows += [(k, d, g, rng.choice([0.5, 0.6]), *flags[g]) for d in range(5) for g in range(4) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "k int, det_rank int, gt_rank int, iou double, ignore boolean, crowd boolean")
    got = {}
    for r in match_coco(df, ["k"]).collect():
        got.setdefault(r.k, set()).add((r.det_rank, r.gt_rank))
    for k in range(60):
        assert got.get(k, set()) == coco([(d, g, v, i, c) for kk, d, g, v, i, c in rows if kk == k])


def test_empty_and_partition_invariance(spark):
    empty = spark.createDataFrame([], EDGE)
    assert match_greedy(empty, ["k"]).count() == 0
    rows = [(1, g, p, 0.5 + (g * p % 5) / 10) for g in range(6) for p in range(6)]
    df = spark.createDataFrame(rows, EDGE)
    assert sorted(match_greedy(df.repartition(5), ["k"]).collect()) == sorted(match_greedy(df.coalesce(1), ["k"]).collect())


def test_grid_gives_each_pair_once(spark):
    rng = random.Random(9)
    box = lambda i: (1, i, *(v := [rng.uniform(-50, 300), rng.uniform(-50, 300)]), v[0] + rng.uniform(1, 200), v[1] + rng.uniform(1, 200))
    schema = "k int, ord int, x1 double, y1 double, x2 double, y2 double"
    a, b = spark.createDataFrame([box(i) for i in range(40)], schema), spark.createDataFrame([box(i) for i in range(40)], schema)
    plain = sorted((r.gt_ord, r.pred_ord) for r in iou_edges(a, b, ["k"], 0.01).collect())
    assert sorted((r.gt_ord, r.pred_ord) for r in iou_edges(a, b, ["k"], 0.01, grid=64).collect()) == plain and plain


def test_suppression(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.0, 0.0, 10.0, 9.0, 0.8), (1, 2, 20.0, 20.0, 30.0, 30.0, 0.1)]
    df = spark.createDataFrame(rows, "k int, ord int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.ord for r in suppress(df, ["k"], 0.5).collect()) == [0, 2]


def test_curve(spark):
    dets = spark.createDataFrame([("a", 0.9, 1, True), ("a", 0.8, 2, False), ("a", 0.7, 3, True)], "cat string, score double, ord int, hit boolean")
    curve = {r.level: r.precision for r in pr_curve(dets, spark.createDataFrame([("a", 2), ("b", 1)], "cat string, n long")).filter("cat = 'a'").collect()}
    assert abs(curve[0] - 1) < 1e-9 and abs(curve[49] - 1) < 1e-9 and abs(curve[60] - 2 / 3) < 1e-9 and curve[100] == 0
