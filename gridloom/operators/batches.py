"""Batches of bounded length from streams of samples."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def next_fit(rows: DataFrame, groups: list[str], order: str, length: str, capacity: int) -> DataFrame:
    """(groups, order, batch): samples in order go into the current batch while they fit, else a new one begins.

    The samples of a worker run through one task in order; only the batch at hand is kept, so a stream may be as long as it likes.
    """
    stream = rows.filter(F.col(length) <= capacity).select(*groups, order, F.col(length).cast("long").alias("_length"))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*groups, order)) + ", batch int"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, batch, used = None, 0, 0
        for part in batches:
            out = []
            for *key, n in zip(*(part[g] for g in groups), part["_length"]):
                key = [None if k != k else k for k in key]
                if key != worker:
                    worker, batch, used = key, 0, 0
                if used and used + n > capacity:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield part[[*groups, order]].assign(batch=out)

    return stream.repartition(*groups).sortWithinPartitions(*groups, order, "_length").mapInPandas(place, schema)


def pack_pad(batches: DataFrame, groups: list[str], order: str, length: str, limit: int) -> DataFrame:
    """(groups, samples, dropped, padding): each batch laid end to end and padded to the limit.

    The last samples of an overfull batch are dropped until it fits; a sample that is left alone is cut to the limit.
    """
    upto = W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = batches.withColumn("_end", F.sum(length).over(upto)).withColumn("_kept", (F.col("_end") <= limit) | (F.row_number().over(W.partitionBy(*groups).orderBy(order)) == 1))
    kept = F.count_if("_kept")
    return rows.groupBy(*groups).agg(kept.alias("samples"), (F.count("*") - kept).alias("dropped"), F.greatest(F.lit(0).cast("long"), limit - F.max(F.when(F.col("_kept"), F.col("_end")))).alias("padding"))


def buffered_best_fit(lengths: list[int], capacity: int, buffer: int) -> list[int]:
    """Batch of each sample when up to ``buffer`` waiting samples are kept and the one that fits best is taken next."""
    out, waiting, used, batch, at = [-1] * len(lengths), [], 0, 0, 0
    while at < len(lengths) or waiting:
        while at < len(lengths) and len(waiting) < buffer:
            waiting.append(at)
            at += 1
        fits = [i for i in waiting if used + lengths[i] <= capacity]
        if not fits:
            batch, used = batch + 1, 0
            fits = [i for i in waiting if lengths[i] <= capacity]
        best = max(fits, key=lambda i: (lengths[i], -i))
        waiting.remove(best)
        out[best], used = batch, used + lengths[best]
    return out


def heap_bins(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each sample, longest first into the emptiest of ceil(total / capacity) + 20 bins, or a new one; -1 if too long."""
    order = sorted((i for i, n in enumerate(lengths) if n <= capacity), key=lambda i: (-lengths[i], i))
    total = sum(lengths[i] for i in order)
    heap = [(0, b) for b in range(-(-total // capacity) + 20)]
    out, bins = [-1] * len(lengths), len(heap)
    for i in order:
        used, b = heap[0]
        if used + lengths[i] <= capacity:
            heapq.heapreplace(heap, (used + lengths[i], b))
        else:
            b, bins = bins, bins + 1
            heapq.heappush(heap, (lengths[i], b))
        out[i] = b
    return out


def length_groups(lengths: list[int], world: int, batch: int) -> list[int]:
    """Worker of each sample of a megabatch: longest first to the shortest worker that has room, in turn if it divides badly."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out = [0] * len(lengths)
    if len(lengths) % world:
        for k, i in enumerate(order):
            out[i] = k % world
        return out
    room, load = [len(lengths) // world] * world, [0] * world
    for i in order:
        w = min((w for w in range(world) if room[w]), key=lambda w: (load[w], w))
        out[i], room[w], load[w] = w, room[w] - 1, load[w] + lengths[i]
    return out


def per_group(rows: DataFrame, groups: list[str], order: str, length: str, assign) -> DataFrame:
    """(groups, order, slot) by a function of the lengths of a bounded group (a worker's buffer or a megabatch) in order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group[[*groups, order]].assign(slot=assign(group[length].astype(int).tolist()))

    kinds = dict(rows.dtypes)
    return rows.select(*groups, order, length).groupBy(*groups).applyInPandas(run, ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), f"`{order}` {kinds[order]}", "slot int"]))
