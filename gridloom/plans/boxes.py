"""Queries of matching, detection scores and curves over boxes derived from lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import geometry as G
from gridloom.operators import matching as M
from gridloom.operators import metrics as A
from gridloom.sources.tables import table

ALL = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def gt_boxes(spark: SparkSession, folder: str, ranges: bool = False, part: Column | None = None) -> DataFrame:
    """image_id, ord, cat and a box for each line of an order; with ranges, partitions hold ranges of image_id, rising within.

    part, which l_orderkey decides, is a further column, by which the rows are laid out.
    """
    lines, keys = table(spark, folder, "lineitem"), ["l_orderkey"]
    if ranges:
        lines = lines.repartitionByRange("l_orderkey")
    elif part is not None:
        lines, keys = lines.withColumn("part", part).repartition("part"), ["part", "l_orderkey"]
    lines = lines.withColumn("ord", F.row_number().over(W.partitionBy(*keys).orderBy(*ALL.split(", "))))
    x1, y1 = F.expr("cast(l_partkey % 300 as double)"), F.expr("cast((l_suppkey * 7) % 300 as double)")
    return lines.select(
        F.col("l_orderkey").alias("image_id"), "ord", F.col("l_returnflag").alias("cat"), x1.alias("x1"), y1.alias("y1"),
        (x1 + 60 + F.expr("(l_partkey * 3) % 200")).alias("x2"), (y1 + 60 + F.expr("(l_suppkey * 5) % 200")).alias("y2"),
        F.expr("l_partkey % 17 = 0").alias("crowd"), F.expr("l_suppkey % 11 = 0").alias("ignore"),
        *keys[:-1],
    )


PREDICTED = "ord % 6 <> 0"
PRED = {"x1": "x1 + (ord * 3) % 11", "y1": "y1 + (ord * 5) % 13", "x2": "x2 + (ord * 7) % 17", "y2": "y2 - (ord * 2) % 9", "score": "((ord * 37) % 100) / 100.0D"}


def pred_boxes(gt: DataFrame, *kept: str) -> DataFrame:
    return gt.filter(PREDICTED).selectExpr("image_id", "ord", "cat", *[f"{e} as {c}" for c, e in PRED.items()], *kept)


BOXES = f"""
gt AS (
  SELECT l_orderkey AS image_id, ord, l_returnflag AS cat, x1, y1, x1 + 60 + (l_partkey * 3) % 200 AS x2, y1 + 60 + (l_suppkey * 5) % 200 AS y2,
    l_partkey % 17 = 0 AS crowd, l_suppkey % 11 = 0 AS ignore
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ALL})::INT AS ord, (l_partkey % 300)::DOUBLE AS x1, ((l_suppkey * 7) % 300)::DOUBLE AS y1 FROM lineitem)),
pred AS (
  SELECT image_id, ord, cat, x1 + (ord * 3) % 11 AS x1, y1 + (ord * 5) % 13 AS y1, x2 + (ord * 7) % 17 AS x2, y2 - (ord * 2) % 9 AS y2, ((ord * 37) % 100) / 100.0::DOUBLE AS score
  FROM gt WHERE ord % 6 <> 0)"""
IOU = """CASE WHEN least(g.x2, p.x2) <= greatest(g.x1, p.x1) OR least(g.y2, p.y2) <= greatest(g.y1, p.y1) THEN 0.0 ELSE
  (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1))
  / ((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1))) END"""
EDGES = f"edges AS (SELECT g.image_id, g.ord AS g, p.ord AS p, {IOU} AS iou FROM gt g JOIN pred p USING (image_id) WHERE {IOU} >= 0.5)"


def boxes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    gt = gt_boxes(spark, folder)
    return gt, pred_boxes(gt)


def j3_iou_join(spark, folder):
    gt, pred = boxes(spark, folder)
    return M.iou_edges(gt, pred, ["image_id"], 0.5).select("image_id", "gt_ord", "pred_ord", F.round("iou", 9).alias("iou"))


def j3_iou_grid(spark, folder):
    """The same pairs by way of grid cells."""
    gt, pred = boxes(spark, folder)
    return M.iou_edges(gt, pred, ["image_id"], 0.5, grid=128).select("image_id", "gt_ord", "pred_ord", F.round("iou", 9).alias("iou"))


J3 = f"WITH {BOXES}, {EDGES} SELECT image_id, g AS gt_ord, p AS pred_ord, round(iou, 9) AS iou FROM edges"


def g6_iou_box(spark, folder):
    gt, pred = boxes(spark, folder)
    pairs = gt.alias("g").join(pred.alias("p"), (F.col("g.image_id") == F.col("p.image_id")) & (F.col("g.ord") == F.col("p.ord")))
    return pairs.select(F.col("g.image_id"), F.col("g.ord"), F.round(G.iou(M._box("g"), M._box("p")), 9).alias("iou"))


G6 = f"WITH {BOXES} SELECT g.image_id, g.ord, round({IOU}, 9) AS iou FROM gt g JOIN pred p USING (image_id, ord)"


def m1_match_greedy(spark, folder):
    gt, pred = boxes(spark, folder)
    return M.match_greedy(M.iou_edges(gt, pred, ["image_id"], 0.5), ["image_id"])


M1 = f"""WITH RECURSIVE {BOXES}, {EDGES},
w(image_id, k, gs, ps) AS (
  SELECT image_id, 0, []::INT[], []::INT[] FROM (SELECT DISTINCT image_id FROM edges)
  UNION ALL
  SELECT w.image_id, w.k + 1,
    CASE WHEN count(e.p) > 0 THEN list_append(first(w.gs), w.k + 1) ELSE first(w.gs) END,
    CASE WHEN count(e.p) > 0 THEN list_append(first(w.ps), arg_min(e.p, (-e.iou, e.p))) ELSE first(w.ps) END
  FROM w LEFT JOIN edges e ON e.image_id = w.image_id AND e.g = w.k + 1 AND NOT list_contains(w.ps, e.p)
  WHERE w.k < (SELECT max(g) FROM edges) GROUP BY w.image_id, w.k)
SELECT image_id, unnest(gs) AS gt_ord, unnest(ps) AS pred_ord FROM w WHERE k = (SELECT max(g) FROM edges)"""


def _scores(spark, folder):
    gt, pred = boxes(spark, folder)
    return A.detection_scores(gt, pred, ["image_id"])


def a1_det_pr(spark, folder):
    """Precision and recall of each image at each threshold."""
    return _scores(spark, folder).select("image_id", F.round("threshold", 2).alias("threshold"), "n_gt", "n_pred", "matched", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_A1 = f"""WITH RECURSIVE {BOXES},
edges AS (SELECT g.image_id, g.ord AS g, p.ord AS p, {IOU} AS iou FROM gt g JOIN pred p USING (image_id) WHERE {IOU} >= 0.5),
t AS (SELECT (50 + 5 * i) / 100.0::DOUBLE AS threshold FROM range(10) r(i)),
w(image_id, threshold, k, ps) AS (
  SELECT image_id, threshold, 0, []::INT[] FROM (SELECT DISTINCT image_id FROM edges), t
  UNION ALL
  SELECT w.image_id, w.threshold, w.k + 1, CASE WHEN count(e.p) > 0 THEN list_append(first(w.ps), arg_min(e.p, (-e.iou, e.p))) ELSE first(w.ps) END
  FROM w LEFT JOIN edges e ON e.image_id = w.image_id AND e.g = w.k + 1 AND e.iou >= w.threshold AND NOT list_contains(w.ps, e.p)
  WHERE w.k < (SELECT max(g) FROM edges) GROUP BY w.image_id, w.threshold, w.k),
m AS (SELECT image_id, threshold, len(ps) AS matched FROM w WHERE k = (SELECT max(g) FROM edges)),
n AS (SELECT image_id, count(*) AS n_gt, count(*) FILTER (WHERE ord % 6 <> 0) AS n_pred FROM gt GROUP BY image_id),
s AS (SELECT n.image_id, threshold, n_gt, n_pred, coalesce(matched, 0) AS matched,
  CASE WHEN n_pred = 0 THEN 0.0 ELSE coalesce(matched, 0) / n_pred END AS precision, CASE WHEN n_pred = 0 THEN 0.0 ELSE coalesce(matched, 0) / n_gt END AS recall
  FROM n CROSS JOIN t LEFT JOIN m USING (image_id, threshold))"""
A1 = _A1 + " SELECT image_id, round(threshold, 2) AS threshold, n_gt, n_pred, matched, round(precision, 9) AS precision, round(recall, 9) AS recall FROM s"


def a11_macro_table(spark, folder):
    scores = _scores(spark, folder).withColumn("dataset", F.expr("concat('d', image_id % 4)"))
    return A.macro_table(scores, ["dataset"]).withColumn("threshold", F.round("threshold", 2))


A11 = _A1 + """, means AS (SELECT 'd' || (image_id % 4) AS dataset, threshold, count(*) AS images, avg(recall) AS r, avg(precision) AS p FROM s GROUP BY ALL)
SELECT dataset, round(threshold, 2) AS threshold, images, round(r, 9) AS recall, round(p, 9) AS precision, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM means"""


def a11_overall(spark, folder):
    """Means over the thresholds of the macro table."""
    return a11_macro_table(spark, folder).groupBy("dataset").agg(F.round(F.avg("recall"), 6).alias("mr"), F.round(F.avg("precision"), 6).alias("mp"), F.round(F.avg("f1"), 6).alias("mf1"))


A11_OVERALL = f"SELECT dataset, round(avg(recall), 6) AS mr, round(avg(precision), 6) AS mp, round(avg(f1), 6) AS mf1 FROM ({A11}) GROUP BY dataset"


def _coco_matches(spark, folder):
    gt, pred = boxes(spark, folder)
    keys = ["image_id", "cat"]
    ranked = pred.withColumn("det_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), "ord")))
    sides = gt.withColumn("gt_rank", F.row_number().over(W.partitionBy(*keys).orderBy("ord")))
    pairs = sides.alias("g").join(ranked.alias("p"), [F.col("g.image_id") == F.col("p.image_id"), F.col("g.cat") == F.col("p.cat")])
    edges = pairs.select("g.image_id", "g.cat", "gt_rank", "det_rank", "ignore", "crowd", G.iou(M._box("g"), M._box("p")).alias("iou")).filter("iou >= 0.5")
    return sides, ranked, M.match_coco(edges, keys)


def m2_match_coco(spark, folder):
    return _coco_matches(spark, folder)[2].select("image_id", "cat", "gt_rank", "det_rank")


_M2 = f"""WITH RECURSIVE {BOXES},
sides AS (SELECT *, row_number() OVER (PARTITION BY image_id, cat ORDER BY ord)::INT AS gt_rank FROM gt),
dets AS (SELECT *, row_number() OVER (PARTITION BY image_id, cat ORDER BY score DESC, ord)::INT AS det_rank FROM pred),
edges AS (SELECT g.image_id, g.cat, gt_rank, det_rank, ignore, crowd, {IOU} AS iou FROM sides g JOIN dets p USING (image_id, cat) WHERE {IOU} >= 0.5),
w(image_id, cat, k, gs, ds, used) AS (
  SELECT image_id, cat, 0, []::INT[], []::INT[], []::INT[] FROM (SELECT DISTINCT image_id, cat FROM edges)
  UNION ALL
  SELECT w.image_id, w.cat, w.k + 1,
    CASE WHEN count(e.gt_rank) > 0 THEN list_append(first(w.gs), arg_min(e.gt_rank, (e.ignore::INT, -e.iou, -e.gt_rank))) ELSE first(w.gs) END,
    CASE WHEN count(e.gt_rank) > 0 THEN list_append(first(w.ds), w.k + 1) ELSE first(w.ds) END,
    CASE WHEN count(e.gt_rank) > 0 AND NOT arg_min(e.crowd, (e.ignore::INT, -e.iou, -e.gt_rank)) THEN list_append(first(w.used), arg_min(e.gt_rank, (e.ignore::INT, -e.iou, -e.gt_rank))) ELSE first(w.used) END
  FROM w LEFT JOIN edges e ON e.image_id = w.image_id AND e.cat = w.cat AND e.det_rank = w.k + 1 AND NOT list_contains(w.used, e.gt_rank)
  WHERE w.k < (SELECT max(det_rank) FROM edges) GROUP BY w.image_id, w.cat, w.k),
matches AS (SELECT image_id, cat, unnest(gs) AS gt_rank, unnest(ds) AS det_rank FROM w WHERE k = (SELECT max(det_rank) FROM edges))"""
M2 = _M2 + " SELECT image_id, cat, gt_rank, det_rank FROM matches"


def _coco_flags(spark, folder):
    sides, ranked, matches = _coco_matches(spark, folder)
    keys = ["image_id", "cat"]
    joined = ranked.join(matches, [*keys, "det_rank"], "left").join(sides.select(*keys, "gt_rank", "ignore"), [*keys, "gt_rank"], "left")
    return sides, joined.select(*keys, "det_rank", "score", "ord", F.col("gt_rank").isNotNull().alias("hit"), F.coalesce("ignore", F.lit(False)).alias("ignored"))


def a13_coco_eval_image(spark, folder):
    """Per image and category: hits, misses and ignored detections."""
    _, flags = _coco_flags(spark, folder)
    return flags.groupBy("image_id", "cat").agg(F.count_if(F.expr("hit and not ignored")).alias("tp"), F.count_if(F.expr("not hit and not ignored")).alias("fp"), F.count_if(F.expr("ignored")).alias("ignored"))


_FLAGS = """, flags AS (SELECT d.image_id, d.cat, d.det_rank, score, d.ord, m.gt_rank IS NOT NULL AS hit, coalesce(s.ignore, false) AS ignored
FROM dets d LEFT JOIN matches m USING (image_id, cat, det_rank) LEFT JOIN sides s ON s.image_id = m.image_id AND s.cat = m.cat AND s.gt_rank = m.gt_rank)"""
A13 = _M2 + _FLAGS + " SELECT image_id, cat, count(*) FILTER (hit AND NOT ignored) AS tp, count(*) FILTER (NOT hit AND NOT ignored) AS fp, count(*) FILTER (ignored) AS ignored FROM flags GROUP BY ALL"


def _curve(spark, folder):
    sides, flags = _coco_flags(spark, folder)
    positives = sides.filter("not ignore").groupBy("cat").agg(F.count("*").alias("n"))
    order = F.struct("image_id", "det_rank")
    return A.pr_curve(flags.filter("not ignored").select("cat", "score", order.alias("ord"), "hit"), positives)


def a14_coco_pr_curve(spark, folder):
    return _curve(spark, folder).select("cat", "level", F.round("precision", 9).alias("precision"))


_CURVE = """, pos AS (SELECT cat, count(*) AS n FROM sides WHERE NOT ignore GROUP BY cat),
ranked AS (SELECT cat, row_number() OVER o AS rank, sum(hit::INT) OVER (o ROWS UNBOUNDED PRECEDING) AS tp, n FROM flags JOIN pos USING (cat) WHERE NOT ignored WINDOW o AS (PARTITION BY cat ORDER BY score DESC, image_id, det_rank)),
curve AS (SELECT cat, rank, tp / n AS recall, max(tp / (rank + 2.2e-16)) OVER (PARTITION BY cat ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision FROM ranked),
reached AS (SELECT cat, i AS level, arg_min(precision, rank) AS precision FROM curve, range(101) r(i) WHERE recall > i * 0.01::DOUBLE GROUP BY ALL),
levels AS (SELECT cat, i AS level, coalesce(precision, 0) AS precision FROM (SELECT cat, i FROM pos, range(101) r(i)) LEFT JOIN reached ON reached.cat = pos.cat AND level = i)"""
_CURVE = _CURVE.replace("(SELECT cat, i FROM pos, range(101) r(i)) LEFT JOIN reached ON reached.cat = pos.cat AND level = i)", "(SELECT cat, i FROM pos, range(101) r(i)) x LEFT JOIN (SELECT cat, level AS i, precision FROM reached) y USING (cat, i))")
A14 = _M2 + _FLAGS + _CURVE + " SELECT cat, level::INT AS level, round(precision, 9) AS precision FROM levels"


def a15_coco_summary(spark, folder):
    """Per category: average precision at the overlap of 0.5 and the recall still reached at a precision of 0.7 and 0.5."""
    curve = _curve(spark, folder)
    reach = lambda p: F.round(F.coalesce(F.max(F.when(F.col("precision") >= p, F.col("level"))), F.lit(0)) * 0.01, 9)
    return curve.groupBy("cat").agg(F.round(F.avg("precision"), 9).alias("ap50"), reach(0.7).alias("recall_p70"), reach(0.5).alias("recall_p50"), F.round(F.max("precision"), 9).alias("most_precision"))


A15 = _M2 + _FLAGS + _CURVE + """ SELECT cat, round(avg(precision), 9) AS ap50, round(coalesce(max(level) FILTER (precision >= 0.7), 0) * 0.01::DOUBLE, 9) AS recall_p70,
round(coalesce(max(level) FILTER (precision >= 0.5), 0) * 0.01::DOUBLE, 9) AS recall_p50, round(max(precision), 9) AS most_precision FROM levels GROUP BY cat"""


def a16_lvis_summary(spark, folder):
    """Average precision by frequency group of the categories."""
    groups = F.create_map(F.lit("R"), F.lit("r"), F.lit("N"), F.lit("c"), F.lit("A"), F.lit("f"))
    ap = _curve(spark, folder).groupBy("cat").agg(F.avg("precision").alias("ap"))
    return ap.groupBy(groups[F.col("cat")].alias("frequency")).agg(F.round(A.positive_mean(F.col("ap")), 9).alias("ap"))


A16 = _M2 + _FLAGS + _CURVE + """ SELECT CASE cat WHEN 'R' THEN 'r' WHEN 'N' THEN 'c' ELSE 'f' END AS frequency, round(coalesce(avg(ap) FILTER (ap > 0), 0), 9) AS ap
FROM (SELECT cat, avg(precision) AS ap FROM levels GROUP BY cat) GROUP BY ALL"""


def a19_report_pr(spark, folder):
    """Means over the categories with a value above 0, and the F1 of the means."""
    s = a15_coco_summary(spark, folder).agg(A.positive_mean(F.col("most_precision")).alias("p"), A.positive_mean(F.col("recall_p50")).alias("r"))
    return s.select(F.round("p", 9).alias("precision"), F.round("r", 9).alias("recall"), F.round(G.f1(F.col("p"), F.col("r")), 9).alias("f1"))


A19 = f"""SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1
FROM (SELECT coalesce(avg(most_precision) FILTER (most_precision > 0), 0) AS p, coalesce(avg(recall_p50) FILTER (recall_p50 > 0), 0) AS r FROM ({A15}))"""


def points(pred: DataFrame) -> DataFrame:
    x, y = G.center(tuple(F.col(c) for c in M.BOX))
    return pred.select("image_id", "cat", "ord", (x + F.expr("(ord * 11) % 90")).alias("x"), y.alias("y"))


POINTS = "points AS (SELECT image_id, cat, ord, (x1 + x2) / 2 + (ord * 11) % 90 AS x, (y1 + y2) / 2 AS y FROM pred)"


def m3_match_pointing(spark, folder):
    gt, pred = boxes(spark, folder)
    return M.match_pointing(gt, points(pred), ["image_id", "cat"])


_M3 = f"""WITH RECURSIVE {BOXES}, {POINTS},
edges AS (SELECT g.image_id, g.cat, g.ord AS g, p.ord AS p FROM gt g JOIN points p ON g.image_id = p.image_id AND g.cat = p.cat AND p.x BETWEEN g.x1 AND g.x2 AND p.y BETWEEN g.y1 AND g.y2),
w(image_id, cat, k, gs, ps) AS (
  SELECT image_id, cat, 0, []::INT[], []::INT[] FROM (SELECT DISTINCT image_id, cat FROM edges)
  UNION ALL
  SELECT w.image_id, w.cat, w.k + 1, CASE WHEN count(e.p) > 0 THEN list_append(first(w.gs), w.k + 1) ELSE first(w.gs) END, CASE WHEN count(e.p) > 0 THEN list_append(first(w.ps), min(e.p)) ELSE first(w.ps) END
  FROM w LEFT JOIN edges e ON e.image_id = w.image_id AND e.cat = w.cat AND e.g = w.k + 1 AND NOT list_contains(w.ps, e.p)
  WHERE w.k < (SELECT max(g) FROM edges) GROUP BY w.image_id, w.cat, w.k),
matches AS (SELECT image_id, cat, unnest(gs) AS gt_ord, unnest(ps) AS pred_ord FROM w WHERE k = (SELECT max(g) FROM edges))"""
M3 = _M3 + " SELECT image_id, cat, gt_ord, pred_ord FROM matches"


def a4_pointing_pr(spark, folder):
    gt, pred = boxes(spark, folder)
    matched = M.match_pointing(gt, points(pred), ["image_id", "cat"]).groupBy("image_id").agg(F.count("*").alias("matched"))
    counts = gt.groupBy("image_id").agg(F.count("*").alias("n_gt"), F.count_if(F.expr("ord % 6 <> 0")).alias("n_pred")).join(matched, "image_id", "left").na.fill(0)
    precision, recall = A.precision_recall(F.col("matched"), F.col("n_gt"), F.col("n_pred"))
    return counts.select("image_id", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"))


A4 = _M3 + """, n AS (SELECT image_id, count(*) AS n_gt, count(*) FILTER (ord % 6 <> 0) AS n_pred FROM gt GROUP BY image_id), m AS (SELECT image_id, count(*) AS c FROM matches GROUP BY image_id)
SELECT image_id, round(CASE WHEN n_pred = 0 THEN 0 ELSE coalesce(c, 0) / n_pred END, 9) AS precision, round(CASE WHEN n_pred = 0 THEN 0 ELSE coalesce(c, 0) / n_gt END, 9) AS recall FROM n LEFT JOIN m USING (image_id)"""


def j4_containment_join(spark, folder):
    gt, pred = boxes(spark, folder)
    p = points(pred)
    on = (F.col("g.image_id") == F.col("p.image_id")) & G.point_in_box(F.col("p.x"), F.col("p.y"), M._box("g"))
    return gt.alias("g").join(p.alias("p"), on).groupBy("g.image_id").agg(F.count("*").alias("pairs"))


J4 = f"WITH {BOXES}, {POINTS} SELECT g.image_id, count(*) AS pairs FROM gt g JOIN points p ON g.image_id = p.image_id AND p.x BETWEEN g.x1 AND g.x2 AND p.y BETWEEN g.y1 AND g.y2 GROUP BY g.image_id"


def a7_gui_acc(spark, folder):
    """Per image: whether any predicted centre lies in the first annotated box."""
    gt, pred = boxes(spark, folder)
    x, y = G.center(M._box("p"))
    first = gt.filter("ord = 1")
    hits = first.alias("g").join(pred.alias("p"), F.col("g.image_id") == F.col("p.image_id"), "left")
    return hits.groupBy("g.image_id").agg(F.coalesce(F.bool_or(G.point_in_box(x, y, M._box("g"))), F.lit(False)).cast("int").alias("hit"))


A7 = f"WITH {BOXES} SELECT g.image_id, coalesce(bool_or((p.x1 + p.x2) / 2 BETWEEN g.x1 AND g.x2 AND (p.y1 + p.y2) / 2 BETWEEN g.y1 AND g.y2), false)::INT AS hit FROM gt g LEFT JOIN pred p USING (image_id) WHERE g.ord = 1 GROUP BY g.image_id"


def a20_sspro_acc(spark, folder):
    """Accuracy overall and per source and type."""
    hits = a7_gui_acc(spark, folder).selectExpr("hit", "element_at(array('pc', 'mobile', 'web'), cast(image_id % 3 as int) + 1) as source", "if(image_id % 2 = 0, 'text', 'icon') as type")
    return hits.groupingSets([[], ["source", "type"]], "source", "type").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 9).alias("accuracy"))


A20 = f"SELECT source, type, count(*) AS n, round(avg(hit), 9) AS accuracy FROM (SELECT hit, ['pc', 'mobile', 'web'][image_id % 3 + 1] AS source, CASE WHEN image_id % 2 = 0 THEN 'text' ELSE 'icon' END AS type FROM ({A7})) GROUP BY GROUPING SETS ((), (source, type))"


def nms_boxes(spark, folder):
    _, pred = boxes(spark, folder)
    return M.suppress(pred, ["image_id"], 0.5)


NMS = f"""WITH RECURSIVE {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS k FROM pred),
w(image_id, k, kept) AS (
  SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[] FROM r
  UNION ALL
  SELECT w.image_id, w.k + 1, CASE WHEN bool_or(coalesce({IOU}, 0) > 0.5) THEN first(w.kept) ELSE list_append(first(w.kept), w.k + 1) END
  FROM w JOIN r g ON g.image_id = w.image_id AND g.k = w.k + 1 LEFT JOIN r p ON p.image_id = w.image_id AND list_contains(w.kept, p.k)
  GROUP BY w.image_id, w.k),
last AS (SELECT image_id, unnest(kept) AS k FROM w QUALIFY w.k = max(w.k) OVER (PARTITION BY image_id))
SELECT image_id, ord FROM last JOIN r USING (image_id, k)"""


def a2_refer_pr(spark, folder):
    """Scores of a sample whatever the categories, at the overlap of 0.5."""
    gt, pred = boxes(spark, folder)
    one = A.detection_scores(gt.withColumn("cat", F.lit("")), pred.withColumn("cat", F.lit("")), ["image_id"], (0.5,))
    return one.select("image_id", "matched", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


A2 = _A1 + " SELECT image_id, matched, round(precision, 9) AS precision, round(recall, 9) AS recall FROM s WHERE threshold = 0.5"


def a12_size_pr(spark, folder):
    """Share of annotated boxes that are matched, by size."""
    gt, pred = boxes(spark, folder)
    matched = M.match_greedy(M.iou_edges(gt, pred, ["image_id"], 0.5), ["image_id"])
    rows = gt.join(matched, (gt.image_id == matched.image_id) & (gt.ord == matched.gt_ord), "left")
    return rows.groupBy(G.size_bucket(G.area(tuple(gt[c] for c in M.BOX))).alias("size")).agg(F.count("*").alias("boxes"), F.round(F.avg(matched.gt_ord.isNotNull().cast("int")), 9).alias("recall"))


A12 = f"""SELECT CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END AS size, count(*) AS boxes, round(avg((m.gt_ord IS NOT NULL)::INT), 9) AS recall
FROM (WITH {BOXES} SELECT * FROM gt) g LEFT JOIN ({M1}) m ON m.image_id = g.image_id AND m.gt_ord = g.ord GROUP BY ALL"""


def f2_positive_only(spark, folder):
    """Predictions of categories that the image has, all of them where it has no annotation."""
    gt, pred = boxes(spark, folder)
    shown = gt.filter("cat <> 'A' and image_id % 5 <> 0")
    has = shown.select("image_id").distinct().withColumn("annotated", F.lit(True))
    kept = pred.join(shown.select("image_id", "cat").distinct().withColumn("known", F.lit(True)), ["image_id", "cat"], "left").join(has, "image_id", "left")
    return kept.filter("known or annotated is null").select("image_id", "ord")


F2 = f"WITH {BOXES}, shown AS (SELECT DISTINCT image_id, cat FROM gt WHERE cat <> 'A' AND image_id % 5 <> 0) SELECT p.image_id, p.ord FROM pred p WHERE EXISTS (SELECT 1 FROM shown s WHERE s.image_id = p.image_id AND s.cat = p.cat) OR NOT EXISTS (SELECT 1 FROM shown s WHERE s.image_id = p.image_id)"


def f3_lvis_exhaustive(spark, folder):
    """Detections of an image's positive or negative categories, ignored where the category is not annotated exhaustively."""
    gt, pred = boxes(spark, folder)
    sets = gt.groupBy("image_id").agg(F.collect_set("cat").alias("pos"), F.min("ord").alias("one")).selectExpr("image_id", "pos", "if(image_id % 3 = 0, array('A'), array()) as neg", "if(image_id % 4 = 0, array('R'), array()) as not_exhaustive")
    rows = pred.withColumn("cat", F.expr("if(ord % 3 = 0, 'A', cat)")).join(sets, "image_id").filter("array_contains(array_union(pos, neg), cat)")
    return rows.select("image_id", "ord", F.expr("array_contains(not_exhaustive, cat)").alias("ignored"))


F3 = f"""WITH {BOXES}, d AS (SELECT image_id, ord, CASE WHEN ord % 3 = 0 THEN 'A' ELSE cat END AS cat FROM pred)
SELECT image_id, ord, image_id % 4 = 0 AND cat = 'R' AS ignored FROM d WHERE (image_id, cat) IN (SELECT image_id, cat FROM gt) OR (image_id % 3 = 0 AND cat = 'A')"""


def c20_stable_desc_sort(spark, folder):
    _, pred = boxes(spark, folder)
    return pred.select("image_id", "ord", F.row_number().over(W.partitionBy("image_id").orderBy(F.col("score").desc(), "ord")).alias("rank"))


C20 = f"WITH {BOXES} SELECT image_id, ord, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord)::INT AS rank FROM pred"


def c21_top_k_per_group(spark, folder):
    _, pred = boxes(spark, folder)
    ranks = pred.withColumn("rank", F.row_number().over(W.partitionBy("image_id", "cat").orderBy(F.col("score").desc(), "ord")))
    return ranks.filter("rank <= 2").select("image_id", "cat", "ord", "rank")


C21 = f"WITH {BOXES} SELECT image_id, cat, ord, row_number() OVER (PARTITION BY image_id, cat ORDER BY score DESC, ord)::INT AS rank FROM pred QUALIFY rank <= 2"


def j6_duplicate_predictions(spark, folder):
    _, pred = boxes(spark, folder)
    pairs = M.iou_edges(pred, pred, ["image_id"], 0.9).filter("gt_ord < pred_ord and iou > 0.9")
    return pairs.select("image_id", F.col("gt_ord").alias("a"), F.col("pred_ord").alias("b"))


J6 = f"WITH {BOXES} SELECT g.image_id, g.ord AS a, p.ord AS b FROM pred g JOIN pred p ON g.image_id = p.image_id AND g.ord < p.ord WHERE {IOU} > 0.9"


def a6_hallucination_acc(spark, folder):
    """Of images with and without a target, the share of those that rightly have or lack a prediction of at least 0.5; every fifth image has no target."""
    gt, pred = boxes(spark, folder)
    counts = gt.select("image_id", F.expr("image_id % 5 > 0").alias("target")).distinct().join(pred.filter("score >= 0.5").groupBy("image_id").count(), "image_id", "left")
    return counts.groupBy("target").agg(F.count("*").alias("images"), F.round(F.avg((F.col("count").isNotNull() == F.col("target")).cast("int")), 9).alias("accuracy"))


A6 = f"""WITH {BOXES} SELECT target, count(*) AS images, round(avg(((c IS NOT NULL) = target)::INT), 9) AS accuracy
FROM (SELECT DISTINCT image_id, image_id % 5 > 0 AS target FROM gt) i LEFT JOIN (SELECT image_id, count(*) AS c FROM pred WHERE score >= 0.5 GROUP BY image_id) USING (image_id) GROUP BY target"""


def a9_count_mae(spark, folder):
    gt, _ = boxes(spark, folder)
    return gt.groupBy("image_id").agg((F.count_if(F.expr("ord % 6 <> 0")) - F.count("*")).alias("d")).agg(F.round(F.avg(F.abs("d")), 9).alias("mae"))


A9 = f"WITH {BOXES} SELECT round(avg(abs(d)), 9) AS mae FROM (SELECT count(*) FILTER (ord % 6 <> 0) - count(*) AS d FROM gt GROUP BY image_id)"


def a10_instruction_following(spark, folder):
    """Per image: the share of annotated categories that are predicted with a score of at least 0.5."""
    gt, pred = boxes(spark, folder)
    sets = gt.groupBy("image_id").agg(F.collect_set("cat").alias("want")).join(pred.filter("score >= 0.5").groupBy("image_id").agg(F.collect_set("cat").alias("have")), "image_id", "left")
    return sets.select("image_id", F.round(F.size(F.array_intersect("want", F.coalesce("have", F.array()))) / F.size("want"), 9).alias("share"))


A10 = f"""WITH {BOXES} SELECT image_id, round(len(list_intersect(want, coalesce(have, []))) / len(want), 9) AS share FROM (SELECT image_id, list(DISTINCT cat) AS want FROM gt GROUP BY image_id)
LEFT JOIN (SELECT image_id, list(DISTINCT cat) AS have FROM pred WHERE score >= 0.5 GROUP BY image_id) USING (image_id)"""


def a8_wrong_rejection_rate(spark, folder):
    """Share of images whose predictions hold a null although there is something to find (F10 averaged)."""
    gt, _ = boxes(spark, folder)
    flags = gt.groupBy("image_id").agg(F.bool_or(F.expr("ord = 7")).alias("null_inside"))
    return flags.agg(F.round(F.avg(F.col("null_inside").cast("int")), 9).alias("rate"))


A8 = f"WITH {BOXES} SELECT round(avg(f::INT), 9) AS rate FROM (SELECT image_id, bool_or(ord = 7) AS f FROM gt GROUP BY image_id)"

_NAMES = {
    "j3_iou_join": J3, "j3_iou_grid": J3, "g6_iou_box": G6, "m1_match_greedy": M1, "a1_det_pr": A1, "a11_macro_table": A11, "a11_overall": A11_OVERALL, "m2_match_coco": M2, "a13_coco_eval_image": A13, "a14_coco_pr_curve": A14,
    "a15_coco_summary": A15, "a16_lvis_summary": A16, "a19_report_pr": A19, "m3_match_pointing": M3, "a4_pointing_pr": A4, "j4_containment_join": J4, "a7_gui_acc": A7, "a20_sspro_acc": A20, "nms_boxes": NMS, "a2_refer_pr": A2, "a12_size_pr": A12,
    "f2_positive_only": F2, "f3_lvis_exhaustive": F3, "c20_stable_desc_sort": C20, "c21_top_k_per_group": C21, "j6_duplicate_predictions": J6, "a6_hallucination_acc": A6, "a9_count_mae": A9, "a10_instruction_following": A10, "a8_wrong_rejection_rate": A8,
}
QUERIES = {name: globals()[name] for name in _NAMES}
SQL = dict(_NAMES)
