"""Detection scores over all overlap thresholds, area ranges and numbers of detections, over boxes derived from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import cells, coco
from gridloom.operators import matching as M
from gridloom.operators.layout import cut
from gridloom.plans.boxes import BOXES, IOU, PRED, PREDICTED, gt_boxes

SIZE = "(x2 - x1) * (y2 - y1)"


def _cell_rows(spark, folder, lvis: bool = False, curves: bool = True) -> DataFrame:
    """The sums and curves of all cells; a line gives its annotated box and its detection side by side, so lines are shuffled once."""
    flags = lambda crowd, ignore: (crowd.alias("crowd"), ignore.alias("ignore"))
    annotated = F.struct(F.lit(False).alias("detected"), *M.BOX, F.lit(None).cast("double").alias("score"), F.expr("(image_id - 1) * 100 + ord - 1").alias("box_id"), *flags(F.col("crowd"), F.col("ignore")))
    detection = F.struct(F.lit(True).alias("detected"), *[F.expr(e).alias(c) for c, e in PRED.items()], F.lit(None).cast("bigint").alias("box_id"), *flags(F.lit(False), F.lit(False)))
    sides = F.inline(F.when(F.expr(PREDICTED), F.array(annotated, detection)).otherwise(F.array(annotated)))
    open_ = F.expr("image_id % 5 = 0 and cat = 'A'") if lvis else F.lit(False)
    return cells.cell_rows(gt_boxes(spark, folder, ranges=True).select("image_id", "cat", "ord", open_.alias("open"), sides), curves)


def a13_coco_cells(spark, folder):
    """Hits, misses and detections out of account by category, threshold and area range."""
    sums = cells.cell_counts(_cell_rows(spark, folder, curves=False)).filter(F.col("most") == max(coco.MOST_DETECTIONS)).filter("n > 0")
    return sums.select("cat", F.round("threshold", 2).alias("threshold"), "area", F.col("hits").alias("tp"), F.expr("seen - hits").alias("fp"), F.expr("n - seen").alias("out"))


_SQL = f"""WITH RECURSIVE {BOXES},
areas(area, low, high) AS (VALUES ('all', 0.0, 1e10), ('small', 0.0, 1024.0), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)),
cells AS (SELECT area, low, high, (50 + 5 * i) / 100.0::DOUBLE AS threshold FROM areas, range(10) r(i)),
sides AS (SELECT *, {SIZE} AS size, (image_id - 1) * 100 + ord - 1 AS gt_id, row_number() OVER (PARTITION BY image_id, cat ORDER BY ord)::INT AS gt_rank FROM gt),
dets AS (SELECT *, {SIZE} AS size, row_number() OVER (PARTITION BY image_id, cat ORDER BY score DESC, ord)::INT AS det_rank FROM pred QUALIFY det_rank <= 100),
pairs AS MATERIALIZED (SELECT g.image_id, g.cat, gt_rank, det_rank, ignore, crowd, g.size, {IOU} AS iou FROM sides g JOIN dets p USING (image_id, cat) WHERE {IOU} >= 0.5),
edges AS MATERIALIZED (SELECT image_id, cat, area, threshold, gt_rank, det_rank, crowd, (ignore OR crowd OR size < low OR size > high)::INT AS out, iou FROM pairs, cells WHERE iou >= threshold),
w(image_id, cat, area, threshold, k, gs, ds, used) AS (
  SELECT image_id, cat, area, threshold, 0, []::INT[], []::INT[], []::INT[] FROM (SELECT DISTINCT image_id, cat, area, threshold FROM edges)
  UNION ALL
  SELECT w.image_id, w.cat, w.area, w.threshold, w.k + 1,
    CASE WHEN count(e.gt_rank) > 0 THEN list_append(first(w.gs), arg_min(e.gt_rank, (e.out, -e.iou, -e.gt_rank))) ELSE first(w.gs) END,
    CASE WHEN count(e.gt_rank) > 0 THEN list_append(first(w.ds), w.k + 1) ELSE first(w.ds) END,
    CASE WHEN count(e.gt_rank) > 0 AND NOT arg_min(e.crowd, (e.out, -e.iou, -e.gt_rank)) THEN list_append(first(w.used), arg_min(e.gt_rank, (e.out, -e.iou, -e.gt_rank))) ELSE first(w.used) END
  FROM w LEFT JOIN edges e ON e.image_id = w.image_id AND e.cat = w.cat AND e.area = w.area AND e.threshold = w.threshold AND e.det_rank = w.k + 1 AND NOT list_contains(w.used, e.gt_rank)
  WHERE w.k < (SELECT max(det_rank) FROM edges) GROUP BY w.image_id, w.cat, w.area, w.threshold, w.k),
matches AS (SELECT image_id, cat, area, threshold, unnest(gs) AS gt_rank, unnest(ds) AS det_rank FROM w WHERE k = (SELECT max(det_rank) FROM edges)),
flags AS (
  SELECT d.image_id, d.cat, d.det_rank, d.score, c.area, c.threshold, coalesce(s.gt_id <> 0, false) AS hit,
    coalesce(s.ignore OR s.crowd OR s.size < c.low OR s.size > c.high, false) OR (NOT coalesce(s.gt_id <> 0, false) AND (d.size < c.low OR d.size > c.high)) AS ignored
  FROM dets d CROSS JOIN cells c LEFT JOIN matches m ON m.image_id = d.image_id AND m.cat = d.cat AND m.det_rank = d.det_rank AND m.area = c.area AND m.threshold = c.threshold
  LEFT JOIN sides s ON s.image_id = m.image_id AND s.cat = m.cat AND s.gt_rank = m.gt_rank)"""
A13 = _SQL + " SELECT cat, round(threshold, 2) AS threshold, area, count(*) FILTER (hit AND NOT ignored) AS tp, count(*) FILTER (NOT hit AND NOT ignored) AS fp, count(*) FILTER (ignored) AS out FROM flags GROUP BY ALL"


LVIS = ", open AS (SELECT * REPLACE (ignored OR (NOT hit AND image_id % 5 = 0 AND cat = 'A') AS ignored) FROM flags)"


def _cell_scores(spark, folder, lvis: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = cut(_cell_rows(spark, folder, lvis))
    return cells.cell_precisions(rows), cells.cell_recalls(rows)


def a14_coco_cell_ap(spark, folder):
    """Average precision by category, threshold and area range."""
    return _cell_scores(spark, folder)[0].select("cat", F.round("threshold", 2).alias("threshold"), "area", F.round("ap", 9).alias("ap"))


def _ap(flags: str) -> str:
    return f""", pos AS (SELECT cat, area, count(*) AS n FROM sides JOIN areas ON size >= low AND size <= high WHERE NOT ignore AND NOT crowd GROUP BY ALL),
ranked AS (SELECT cat, area, threshold, row_number() OVER o AS rank, sum(hit::INT) OVER (o ROWS UNBOUNDED PRECEDING) AS tp, n FROM {flags} JOIN pos USING (cat, area) WHERE NOT ignored
  WINDOW o AS (PARTITION BY cat, area, threshold ORDER BY score DESC, image_id, det_rank)),
curve AS (SELECT cat, area, threshold, rank, tp / n AS recall, max(tp / (rank + 2.2e-16)) OVER (PARTITION BY cat, area, threshold ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision FROM ranked),
steps AS (SELECT *, coalesce(lag(recall) OVER (PARTITION BY cat, area, threshold ORDER BY rank), -1) AS before FROM curve),
reached AS (SELECT cat, area, threshold, i AS level, precision FROM steps, range(101) r(i) WHERE recall > i * 0.01::DOUBLE AND before <= i * 0.01::DOUBLE AND recall > before),
cell_ap AS (SELECT cat, area, threshold, coalesce(sum(precision), 0) / 101 AS ap FROM (SELECT DISTINCT cat, area, threshold FROM pos JOIN cells USING (area)) LEFT JOIN reached USING (cat, area, threshold) GROUP BY ALL),
cell_ar AS (SELECT cat, area, threshold, most, coalesce(tp, 0) / n AS recall FROM pos JOIN cells USING (area) CROSS JOIN (VALUES (1), (10), (100)) v(most)
  LEFT JOIN (SELECT cat, area, threshold, most, count(*) AS tp FROM {flags} JOIN (VALUES (1), (10), (100)) u(most) ON det_rank <= most WHERE hit AND NOT ignored GROUP BY ALL) USING (cat, area, threshold, most))"""


A14 = _SQL + _ap("flags") + " SELECT cat, round(threshold, 2) AS threshold, area, round(ap, 9) AS ap FROM cell_ap"


def a15_coco_table(spark, folder):
    """Per category: AP over ten thresholds, at 0.5, 0.75 and 0.95, by area, and the recall with 1, 10 and 100 detections; -1 where nothing counts."""
    precisions, recalls = _cell_scores(spark, folder)
    whole = F.col("area") == "all"
    mean = lambda when, name: F.round(F.coalesce(F.avg(F.when(when, F.col("ap"))), F.lit(-1.0)), 9).alias(name)
    ap = precisions.groupBy("cat").agg(mean(whole, "ap"), *[mean(whole & (F.col("threshold") == t), f"ap{int(t * 100)}") for t in (0.5, 0.75, 0.95)], *[mean(F.col("area") == a, f"ap_{a}") for a in ("small", "medium", "large")])
    ar = recalls.groupBy("cat").agg(*[F.round(F.avg(F.when(whole & (F.col("most") == m), F.col("recall"))), 9).alias(f"ar_{m}") for m in coco.MOST_DETECTIONS])
    return ap.join(ar, "cat")


_FIGURES = "coalesce(round(avg({v}) FILTER ({w}), 9), -1) AS {n}"
_PER_CAT = [("ap", "area = 'all'"), ("ap50", "area = 'all' AND threshold = 0.5"), ("ap75", "area = 'all' AND threshold = 0.75"), ("ap95", "area = 'all' AND threshold = 0.95")] + [(f"ap_{a}", f"area = '{a}'") for a in ("small", "medium", "large")]
A15 = _SQL + _ap("flags") + f""" SELECT * FROM (SELECT cat, {', '.join(_FIGURES.format(v='ap', w=w, n=n) for n, w in _PER_CAT)} FROM cell_ap GROUP BY cat)
JOIN (SELECT cat, {', '.join(_FIGURES.format(v='recall', w=f"area = 'all' AND most = {m}", n=f'ar_{m}') for m in (1, 10, 100))} FROM cell_ar GROUP BY cat) USING (cat)"""


def a17_standard_table(spark, folder):
    """The twelve lines of the COCO summary; a figure without any defined cell is -1."""
    return coco.standard_table(*_cell_scores(spark, folder))


_AP_LINES = [("AP", "area = 'all'"), ("AP50", "area = 'all' AND threshold = 0.5"), ("AP75", "area = 'all' AND threshold = 0.75"), ("AP_small", "area = 'small'"), ("AP_medium", "area = 'medium'"), ("AP_large", "area = 'large'")]
_AR_LINES = [("AR_1", "area = 'all' AND most = 1"), ("AR_10", "area = 'all' AND most = 10"), ("AR_100", "area = 'all' AND most = 100")] + [(f"AR_{a}", f"area = '{a}' AND most = 100") for a in ("small", "medium", "large")]
_line = lambda i, n, v, w, source: f"SELECT {i} AS line, '{n}' AS name, round(coalesce(avg({v}) FILTER ({w}), -1), 9) AS value FROM {source}"
A17 = _SQL + _ap("flags") + " " + " UNION ALL ".join([_line(i, n, "ap", w, "cell_ap") for i, (n, w) in enumerate(_AP_LINES, 1)] + [_line(i, n, "recall", w, "cell_ar") for i, (n, w) in enumerate(_AR_LINES, 7)])


def a16_lvis_table(spark, folder):
    """The thirteen lines of the LVIS summary: AP, by threshold, area and frequency of the category, and recall.

    LVIS rules: a detection that takes no box is out of account where its category is not annotated exhaustively, which is A in every fifth image.
    """
    groups = spark.createDataFrame([("R", "r"), ("N", "c"), ("A", "f")], "cat string, frequency string")
    return coco.standard_table(*_cell_scores(spark, folder, lvis=True), groups=groups)


_FREQUENCY = "CASE cat WHEN 'R' THEN 'r' WHEN 'N' THEN 'c' ELSE 'f' END"
_LVIS_LINES = _AP_LINES + [(f"AP_{f}", f"area = 'all' AND {_FREQUENCY} = '{f}'") for f in "rcf"]
A16 = _SQL + LVIS + _ap("open") + " " + " UNION ALL ".join([_line(i, n, "ap", w, "cell_ap") for i, (n, w) in enumerate(_LVIS_LINES, 1)] + [_line(i, n, "recall", w, "cell_ar") for i, (n, w) in enumerate(_AR_LINES[2:], 10)])


def j8_cell_grid(spark, folder):
    """How many detections each of the 120 cells of threshold, area and number of detections takes into account."""
    sums = cells.cell_counts(_cell_rows(spark, folder, curves=False))
    return sums.groupBy(F.round("threshold", 2).alias("threshold"), "area", "most").agg(F.sum("seen").alias("n")).filter("n > 0")


J8 = _SQL + " SELECT round(threshold, 2) AS threshold, area, most, count(*) AS n FROM flags JOIN (VALUES (1), (10), (100)) v(most) ON det_rank <= most WHERE NOT ignored GROUP BY ALL"

_NAMES = {"a13_coco_cells": A13, "a14_coco_cell_ap": A14, "a15_coco_table": A15, "a16_lvis_table": A16, "a17_standard_table": A17, "j8_cell_grid": J8}
QUERIES = {name: globals()[name] for name in _NAMES}
SQL = dict(_NAMES)
