"""Ranks within groups by a fraction, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKETS = 4096


def fraction_positions(rows: DataFrame, groups: list[str], fraction: Column, key: str, name: str = "position") -> DataFrame:
    """Adds the position, from 0, of a row in the order of (fraction, key) of its group; null groups are groups of their own.

    Fractions are cut into BUCKETS buckets; rows before a bucket come from the sums of the buckets, those within it from a window over the
    bucket alone.
    """
    keyed = rows.withColumn("_fraction", fraction).withColumn("_bucket", F.least(F.floor(F.col("_fraction") * BUCKETS), F.lit(BUCKETS)).cast("int"))
    sizes = keyed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b")).agg(F.count("*").alias("_size"))
    inner = [f"_g{i}" for i in range(len(groups))]
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.partitionBy(*inner).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    local = keyed.withColumn("_local", F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy("_fraction", key)) - 1)
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    return local.join(before, same).withColumn(name, (F.col("_before") + F.col("_local")).cast("int")).drop(*inner, "_b", "_bucket", "_before", "_local", "_fraction")
