"""Epoch orders, weighted draws, balanced classes and shards, as ranks over hashes instead of random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.geometry import stable_fraction
from gridloom.operators.layout import cut, small
from gridloom.operators.ranks import fraction_positions

EPOCH_STEP = 999_983


def _key(column: str) -> Column:
    return F.col(column).cast("string")


def epoch_shuffle(rows: DataFrame, groups: list[str], key: str, seed: int, epoch: int) -> DataFrame:
    """Adds position, from 0, of a row in the order of its group in an epoch."""
    fraction = stable_fraction(_key(key), F.lit(seed + epoch * EPOCH_STEP))
    return fraction_positions(rows, groups, fraction, key)


def downsample(rows: DataFrame, groups: list[str], key: str, ratio: Column, seed: int = 10086) -> DataFrame:
    """Keeps floor(n * ratio) rows of each group with a ratio below 1, all others whole."""
    ranked = fraction_positions(rows, groups, stable_fraction(_key(key), F.lit(seed)), key, "_rank")
    sizes = rows.groupBy(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)]).agg(F.count("*").alias("_n"))
    same = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]
    kept = ranked.join(sizes, same).filter((ratio >= 1) | (F.col("_rank") < F.floor(F.col("_n") * ratio)))
    return kept.drop("_rank", "_n", *[f"_k{i}" for i in range(len(groups))])


def dataset_weights(counts: DataFrame, ratio: Column) -> DataFrame:
    """Sampling weights of datasets with n rows: repeat * n from a repeat of 1 on, else the rows left after downsampling."""
    raw = F.when(ratio >= 1, ratio * F.col("n")).otherwise(F.floor(F.col("n") * ratio))
    return counts.withColumn("_raw", raw.cast("double")).withColumn("weight", F.col("_raw") / F.sum("_raw").over(W.partitionBy())).drop("_raw")


def weighted_draw(weights: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """The dataset of each draw number, by its place among the running weights, and the how-manieth of that dataset it is.

    weights is one row per dataset; it holds name and weight.
    """
    order = W.orderBy("name").rowsBetween(W.unboundedPreceding, 0)
    ends = weights.withColumn("high", F.sum("weight").over(order)).withColumn("low", F.col("high") - F.col("weight"))
    placed = draws.withColumn("u", stable_fraction(_key("draw"), F.lit(seed)))
    hit = placed.join(small(ends), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return hit.select("draw", "name", (F.row_number().over(W.partitionBy("name").orderBy("draw")) - 1).alias("nth"))


def weighted_shuffle(rows: DataFrame, groups: list[str], key: str, weight: Column, seed: int) -> DataFrame:
    """Adds position by rising u ** (1 / weight), so that small weights tend to come first."""
    value = F.pow(stable_fraction(_key(key), F.lit(seed)), 1 / weight)
    return fraction_positions(rows, groups, value, key)


def balance_classes(rows: DataFrame, task: str, positive: Column, key: str, n: int, ratio: float, seed: int) -> DataFrame:
    """n slots per task, 1 part positives to ``ratio`` parts negatives, filled from the task's buckets.

    A bucket with enough rows gives each at most once, in hash order; a smaller one is repeated.
    """
    want = max(1, _half_even(n / (1 + ratio)))
    ranked = fraction_positions(rows.withColumn("_positive", positive), [task, "_positive"], stable_fraction(_key(key), F.lit(seed)), key, "_rank")
    sizes = ranked.groupBy(task, "_positive").agg(F.count("*").alias("_n"))
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.when(F.col("_positive"), F.lit(want)).otherwise(F.lit(n - want)) - 1)))
    filled = slots.withColumn("_rank", F.pmod("slot", "_n").cast("int"))
    return filled.join(ranked, [task, "_positive", "_rank"]).select(task, F.col("_positive").alias("positive"), "slot", key)


def _half_even(value: float) -> int:
    return round(value)


def even_interleave(position: Column, positives: Column, total: Column) -> Column:
    """Whether a position, from 0, holds a positive when these are spread evenly over a total."""
    return F.floor((position + 1) * positives / total) > F.floor(position * positives / total)


def rotating_order(position: Column, index: Column, classes: int) -> Column:
    """The place of a class in the round of a position."""
    return position * classes + F.pmod(index - position, F.lit(classes))


def reservoir_pick(rows: DataFrame, groups: list[str], key: str, seed: int) -> DataFrame:
    """One row of each group, the one of the smallest hash."""
    return rows.groupBy(*groups).agg(F.min_by(key, F.struct(stable_fraction(_key(key), F.lit(seed)), F.col(key))).alias(key))


def retry_next(rows: DataFrame, order: str, ok: Column, groups: list[str], tries: int = 10) -> DataFrame:
    """Adds used: the row itself or the first of the following ones that is fit."""
    frame = W.partitionBy(*groups).orderBy(order).rowsBetween(0, tries)
    return rows.withColumn("used", F.first(F.when(ok, F.col(order)), True).over(frame))


def rank_shard(rows: DataFrame, order: str, world: int) -> DataFrame:
    """(rank, step, row): rows dealt out in turn, the first ones again at the end so that all ranks have as many.

    Row numbers come from a range-partitioned order and per-partition counts, not from one window.
    """
    numbered = global_positions(rows, order)
    total = numbered.groupBy(F.lit(1).alias("_one")).agg(F.count("*").alias("_total"))
    padded = numbered.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # a single row
    missing = F.pmod(-F.col("_total"), F.lit(world))
    again = padded.filter(F.col("position") < missing).withColumn("position", F.col("position") + F.col("_total"))
    return padded.unionByName(again).select(F.pmod("position", F.lit(world)).cast("int").alias("rank"), F.floor(F.col("position") / world).alias("step"), order)


def global_positions(rows: DataFrame, order: str) -> DataFrame:
    """Adds position, from 0, in the order of a unique column."""
    # Written once, as the bounds of the ranges are sampled and a second run might draw others.
    ranged = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    local = ranged.withColumn("_local", F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1)
    return local.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")
