"""How a table is laid out over tasks."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable

from pyspark import SparkContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread_small(df: DataFrame) -> DataFrame:
    """The table over at least as many tasks as there are cores.

    Only a table that arrives in fewer partitions than cores is shuffled, which is a small one; a large table keeps the
    partitions of its scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(context: SparkContext) -> str:
    """The folder that all executors see: the cluster's, named by spark.checkpoint.dir; in local mode one is made if it is unset."""
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="gridloom-")


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder, so that a lost executor costs no more than its reading."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(context))
    return df.checkpoint()


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """A bounded object broadcast with the code of its classes; the result, called in a task, gives it back.

    The workers need no copy of the package, as the object is pickled by value.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The table marked for a broadcast if it has at most so many rows, which is looked up; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a small table; more rows than its bound are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows
