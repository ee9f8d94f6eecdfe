"""Batches of bounded length from an unbounded stream, and rolling statistics of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PACKED = "worker string, doc_id long, batch int"


def pack_stream(samples: DataFrame, capacity: int) -> DataFrame:
    """(worker, doc_id, batch) by next fit over the samples of each worker in order of arrival, ties in a trigger by id.

    samples has worker, doc_id and n. The state of a worker is its current batch and the space used in it, kept by the
    checkpoint of the query, so that a restart goes on with the same batch. Samples over the capacity are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, used = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("doc_id")
        out = []
        for doc, n in zip(rows["doc_id"], rows["n"]):
            if used and used + n > capacity:
                batch, used = batch + 1, 0
            used += int(n)
            out.append((key[0], int(doc), batch))
        state.update((batch, used))
        yield pd.DataFrame(out, columns=["worker", "doc_id", "batch"])

    fitting = samples.filter(F.col("n") <= capacity).select("worker", F.col("doc_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"))
    return fitting.groupBy("worker").applyInPandasWithState(step, PACKED, "batch int, used long", "append", GroupStateTimeout.NoTimeout)


def windowed_stats(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """Count, mean and extremes of the values of each type of event in windows of event time; works on streams and tables."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    stats = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return stats.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "least", "most")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users with a pause of less than the gap."""
    rows = events.withWatermark("ts", "7 days") if events.isStreaming else events
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def pending(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The inputs that have no result yet, for a run that goes on after a stop."""
    return inputs.join(results.select(key).distinct(), key, "left_anti")


def resume_state(packed: DataFrame, samples: DataFrame) -> DataFrame:
    """(worker, batch, used): the state of each worker rebuilt from the places already given out."""
    last = packed.groupBy("worker").agg(F.max("batch").alias("batch"))
    return packed.join(last, ["worker", "batch"]).join(samples.select("worker", "doc_id", "n"), ["worker", "doc_id"]).groupBy("worker", "batch").agg(F.sum("n").alias("used"))
