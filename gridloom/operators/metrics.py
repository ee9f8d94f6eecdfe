"""Scores of predictions: precision and recall tables, detection curves, accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from gridloom.functions.geometry import f1
from gridloom.operators.matching import iou_edges, matched_counts

THRESHOLDS = tuple(x / 100 for x in range(50, 100, 5))


def _counts(boxes: DataFrame, keys: list[str], name: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.count("*").alias(name))


def precision_recall(matched: Column, n_gt: Column, n_pred: Column) -> tuple[Column, Column]:
    """(precision, recall): 1/1 without boxes on either side, 0/0 if only one side has any."""
    both = n_gt + n_pred
    precision = F.when(both == 0, 1.0).when((n_gt == 0) | (n_pred == 0), 0.0).otherwise(F.try_divide(matched, n_pred))
    recall = F.when(both == 0, 1.0).when((n_gt == 0) | (n_pred == 0), 0.0).otherwise(F.try_divide(matched, n_gt))
    return precision, recall


def detection_scores(gt: DataFrame, pred: DataFrame, keys: list[str], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(keys, threshold, n_gt, n_pred, matched, precision, recall) of each image at each threshold.

    Predictions of categories that an image has no annotation of cannot match but count against precision; categories do
    not matter among the others. Overlaps are computed once, at the lowest threshold.
    """
    pool = pred.join(gt.select(*keys, "cat").distinct(), [*keys, "cat"], "left_semi")
    edges = iou_edges(gt, pool, keys, min(thresholds))
    matched = matched_counts(edges, keys, thresholds)
    images = _counts(gt, keys, "n_gt").join(_counts(pred, keys, "n_pred"), keys, "full").na.fill(0)
    rows = images.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).join(matched, [*keys, "threshold"], "left").na.fill(0, ["matched"])
    precision, recall = precision_recall(F.col("matched"), F.col("n_gt"), F.col("n_pred"))
    return rows.select("*", precision.alias("precision"), recall.alias("recall"))


def macro_table(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Mean precision and recall per group and threshold, and the F1 of these means."""
    means = scores.groupBy(*groups, "threshold").agg(F.count("*").alias("images"), F.avg("recall").alias("r"), F.avg("precision").alias("p"))
    return means.select(*groups, "threshold", "images", F.round("r", 9).alias("recall"), F.round("p", 9).alias("precision"), F.round(f1(F.col("p"), F.col("r")), 9).alias("f1"))


SCORE_BINS, KEYS_A_BIN = 4096, 65_536


def pr_curve(detections: DataFrame, positives: DataFrame, cat: str | list[str] = "cat", levels: int = 101) -> DataFrame:
    """(cat, level, precision): precision made monotone from the right, at the first rank whose recall exceeds each level.

    detections has cat, score, ord (a number, or a struct whose first field is one) and hit; positives has cat and n. Level 1 is never
    exceeded, so its precision is 0. The detections of a category are cut into bins of score and, for ties, of the first field of
    ord; counts before and precisions after a bin come from sums over the bins, those within it from windows over the
    bin alone, so that no task sorts a category.
    """
    keys = [cat] if isinstance(cat, str) else cat
    kind = detections.schema["ord"].dataType
    first = f"ord.{kind.names[0]}" if isinstance(kind, StructType) else "ord"
    binned = detections.join(positives, keys).withColumn("_bin", F.struct(-F.floor(F.col("score") * SCORE_BINS), F.floor(F.col(first) / KEYS_A_BIN)))
    bins = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_rows"), F.sum(F.col("hit").cast("long")).alias("_hits"))
    earlier = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_hits").over(earlier), F.lit(0)).alias("_hits"))
    local = W.partitionBy(*keys, "_bin").orderBy(F.col("score").desc(), "ord")
    ranked = binned.withColumn("_rank", F.row_number().over(local)).withColumn("_tp", F.sum(F.col("hit").cast("int")).over(local.rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.join(bins, [*keys, "_bin"]).withColumn("rank", F.col("_rows") + F.col("_rank")).withColumn("tp", F.col("_hits") + F.col("_tp"))
    curve = ranked.select(*keys, "_bin", "rank", (F.col("tp") / F.col("n")).alias("recall"), ((F.col("tp") - F.col("hit").cast("int")) / F.col("n")).alias("_before"), (F.col("tp") / (F.col("rank") + F.lit(2.2e-16))).alias("raw"))
    later = W.partitionBy(*keys).orderBy(F.col("_bin").desc()).rowsBetween(W.unboundedPreceding, -1)
    peaks = curve.groupBy(*keys, "_bin").agg(F.max("raw").alias("_peak")).select(*keys, "_bin", F.max("_peak").over(later).alias("_after"))
    behind = W.partitionBy(*keys, "_bin").orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    curve = curve.join(peaks, [*keys, "_bin"]).withColumn("precision", F.greatest(F.max("raw").over(behind), F.coalesce("_after", F.lit(0.0))))
    # A rank is the first over the levels between the recall before it and its own.
    before = F.when(F.col("rank") == 1, F.lit(-1.0)).otherwise(F.col("_before"))
    grid = F.filter(F.transform(F.sequence(F.greatest(F.lit(0), F.floor(F.col("before") * (levels - 1)) - 1).cast("int"), F.least(F.lit(levels - 1), F.floor(F.col("recall") * (levels - 1)) + 1).cast("int")), lambda i: F.struct(i.alias("level"), (i * F.lit(1 / (levels - 1))).alias("value"))), lambda x: (x["value"] < F.col("recall")) & (x["value"] >= F.col("before")))
    reached = curve.withColumn("before", before).withColumn("g", F.explode(grid)).select(*keys, F.col("g.level").alias("level"), "precision")
    every = positives.select(*keys).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return every.join(reached, [*keys, "level"], "left").na.fill(0.0, ["precision"])


def positive_mean(value: Column) -> Column:
    """The mean of the values above 0, else 0."""
    return F.coalesce(F.avg(F.when(value > 0, value)), F.lit(0.0))
