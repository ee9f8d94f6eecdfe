"""Matching of annotated and predicted boxes by folds over the ordered edges of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import iou, point_in_box

BOX = ("x1", "y1", "x2", "y2")


def _box(side: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{side}.{c}") for c in BOX)


def iou_edges(gt: DataFrame, pred: DataFrame, keys: list[str], at_least: float, grid: int | None = None) -> DataFrame:
    """(keys, gt_ord, pred_ord, iou) of the pairs of boxes of a key that overlap enough.

    With a grid width, boxes meet only in grid cells that both touch, for images with many boxes; each pair is kept in
    the cell of its shared corner alone.
    """
    a, b = gt.alias("g"), pred.alias("p")
    on = [F.col(f"g.{k}") == F.col(f"p.{k}") for k in keys]
    if grid:
        cells = lambda df: df.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x1") / grid), F.floor(F.col("x2") / grid)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y1") / grid), F.floor(F.col("y2") / grid))))
        a, b = cells(gt).alias("g"), cells(pred).alias("p")
        on += [F.col("g._cx") == F.col("p._cx"), F.col("g._cy") == F.col("p._cy")]
        on += [F.col(f"g._c{c}") == F.floor(F.greatest(F.col(f"g.{c}1"), F.col(f"p.{c}1")) / grid) for c in "xy"]
    value = iou(_box("g"), _box("p"))
    return a.join(b, on).select(*[F.col(f"g.{k}") for k in keys], F.col("g.ord").alias("gt_ord"), F.col("p.ord").alias("pred_ord"), value.alias("iou")).filter(F.col("iou") >= at_least)


def _fold(edges: DataFrame, keys: list[str], priority: list[Column], gt: Column, pred: Column, reusable: Column | None = None) -> DataFrame:
    """Takes edges in the order of their priority whose two ends are free; reusable ends of the first side stay free."""
    fields = [p.alias(f"k{i}") for i, p in enumerate(priority)] + [gt.alias("g"), pred.alias("p"), (F.lit(False) if reusable is None else reusable).alias("free")]
    kind = "struct<g:array<int>,p:array<int>,out:array<struct<g:int,p:int>>>"
    start = F.struct(F.array().cast("array<int>").alias("g"), F.array().cast("array<int>").alias("p"), F.array().cast("array<struct<g:int,p:int>>").alias("out"))

    def step(state: Column, e: Column) -> Column:
        busy = F.array_contains(state["g"], e["g"]) | F.array_contains(state["p"], e["p"])
        taken = F.struct(
            F.when(e["free"], state["g"]).otherwise(F.array_append(state["g"], e["g"])).alias("g"),
            F.array_append(state["p"], e["p"]).alias("p"),
            F.array_append(state["out"], F.struct(e["g"].alias("g"), e["p"].alias("p"))).alias("out"),
        )
        return F.when(busy, state).otherwise(taken).cast(kind)

    lists = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_edges"))
    return lists.select(*keys, F.explode(F.aggregate("_edges", start, step)["out"]).alias("_match")).select(*keys, F.col("_match.g").alias("gt_ord"), F.col("_match.p").alias("pred_ord"))


def match_greedy(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one: each annotated box in order takes the free predicted box of the greatest overlap, the earlier one of equals."""
    return _fold(edges, keys, [F.col("gt_ord"), -F.col("iou"), F.col("pred_ord")], F.col("gt_ord").cast("int"), F.col("pred_ord").cast("int"))


def matched_counts(edges: DataFrame, keys: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    """(keys, threshold, matched): how many pairs match_greedy makes at each threshold; the edges of a key meet once for all of them."""
    kind = "struct<g:array<int>,p:array<int>>"
    start = F.struct(F.array().cast("array<int>").alias("g"), F.array().cast("array<int>").alias("p"))

    def step(state: Column, e: Column) -> Column:
        busy = F.array_contains(state["g"], e["g"]) | F.array_contains(state["p"], e["p"])
        return F.when(busy, state).otherwise(F.struct(F.array_append(state["g"], e["g"]).alias("g"), F.array_append(state["p"], e["p"]).alias("p"))).cast(kind)

    fields = F.struct(F.col("gt_ord").cast("int").alias("g"), (-F.col("iou")).alias("k"), F.col("pred_ord").cast("int").alias("p"))
    lists = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("_edges"))
    counts = F.transform(F.array(*map(F.lit, thresholds)), lambda t: F.struct(t.alias("threshold"), F.size(F.aggregate(F.filter("_edges", lambda e: -e["k"] >= t), start, step)["g"]).cast("long").alias("matched")))
    return lists.select(*keys, F.inline(counts)).filter("matched > 0")


def match_coco(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Detections by rank take annotated boxes: real ones before ignored ones, then by overlap, the later one of equals.

    edges has det_rank, gt_rank, ignore, crowd and iou; a crowd region may be taken again and again.
    """
    order = [F.col("det_rank"), F.col("ignore").cast("int"), -F.col("iou"), -F.col("gt_rank")]
    return _fold(edges, keys, order, F.col("gt_rank").cast("int"), F.col("det_rank").cast("int"), F.col("crowd")).withColumnsRenamed({"gt_ord": "gt_rank", "pred_ord": "det_rank"})


def match_pointing(gt: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Each box in order takes the first free point of its key that lies in it."""
    on = [F.col(f"g.{k}") == F.col(f"p.{k}") for k in keys] + [point_in_box(F.col("p.x"), F.col("p.y"), _box("g"))]
    edges = gt.alias("g").join(points.alias("p"), on).select(*[F.col(f"g.{k}") for k in keys], F.col("g.ord").alias("gt_ord"), F.col("p.ord").alias("pred_ord"))
    return _fold(edges, keys, [F.col("gt_ord"), F.col("pred_ord")], F.col("gt_ord").cast("int"), F.col("pred_ord").cast("int"))


def suppress(boxes: DataFrame, keys: list[str], at_least: float) -> DataFrame:
    """Non-maximum suppression: boxes by falling score, kept unless a kept one overlaps them by more than the threshold."""
    fields = F.struct((-F.col("score")).alias("s"), F.col("ord").cast("int").alias("ord"), *[F.col(c) for c in BOX])
    kind = "array<struct<s:double,ord:int,x1:double,y1:double,x2:double,y2:double>>"

    def step(kept: Column, e: Column) -> Column:
        near = F.exists(kept, lambda k: iou(tuple(k[c] for c in BOX), tuple(e[c] for c in BOX)) > at_least)
        return F.when(near, kept).otherwise(F.array_append(kept, e)).cast(kind)

    lists = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("_boxes"))
    return lists.select(*keys, F.explode(F.aggregate("_boxes", F.array().cast(kind), step)).alias("_kept")).select(*keys, F.col("_kept.ord").alias("ord"))
