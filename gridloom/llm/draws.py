"""Seeded orders of rows and exact positions in them, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BITS, BUCKET_BITS = 52, 12


def draw(seed: int, key: str) -> Column:
    """A number of 52 bits that depends on the seed and the key alone."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, BITS // 4), 16, 10).cast("long")


def positions(rows: DataFrame, groups: list[str], key: str, weight: Column, seed: int) -> DataFrame:
    """Adds position: the weight of the rows of the group that come before in the order of (draw, key).

    The draws of a group are cut into 2^BUCKET_BITS buckets; weights before a bucket come from the sums of the buckets,
    those within it from a window over the bucket alone.
    """
    drawn = rows.withColumn("_draw", draw(seed, key)).withColumn("_bucket", F.shiftright("_draw", BITS - BUCKET_BITS)).withColumn("_weight", weight.cast("long"))
    sums = drawn.groupBy(*groups, "_bucket").agg(F.sum("_weight").alias("_sum"))
    before = sums.select(*groups, "_bucket", F.coalesce(F.sum("_sum").over(W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.coalesce(F.sum("_weight").over(W.partitionBy(*groups, "_bucket").orderBy("_draw", key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = drawn.withColumn("_local", local).join(before, [*groups, "_bucket"])
    return joined.withColumn("position", F.col("_before") + F.col("_local")).drop("_draw", "_bucket", "_weight", "_before", "_local")
