"""Filling containers of a fixed capacity with items of varying length by exact-complement hashing.

Items of one length are alike, so a plan is made for the counts of the lengths of a group (at most one count for each
length up to the capacity, however many items there are). Single, pair and triple sums of the lengths are indexed in bit sets;
the largest length is combined with the single, pair or triple that fills its gap exactly, as often as the counts allow; where
there is none, the largest length that fits the gap is added (best fit) and the index is asked again. The index is made anew when
lengths have run out and it named a sum that is no longer there, so it misses none and its error never lasts. The plan is a
list of patterns, each with the number of containers that follow it. Items get their place by rank within their length; ranks are
made in SALTS parts and looked up in blocks of RANKS_A_BLOCK, so that no task sorts a hot length or group.

An item longer than the capacity is cut: full containers of its own, and the rest as one item of that length.

Defined results for odd input
-----------------------------
* null ids: ignored. A record delivered more than once: the last delivery by ingested_at counts, ties by content.
* null or unknown group, or a capacity that is null or below 1: the record is reported with a null container.
* null turns, null or empty values and records without turns have no characters; unknown images, and those of null or
  non-positive size, have no cells. Items of length 0 share the first container of their group.
* empty tables: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.layout import cut, small

CHARACTERS_A_TOKEN, CELL = 4, 28
SALTS = 256
#: ranks of a length that one window holds
RANKS_A_BLOCK = 65_536
HOT_PARTS = 1000
#: capacities of at most so many groups are broadcast
MOST_GROUPS = 100_000


def cells(width: Column, height: Column) -> Column:
    """Started cells of an image, 0 without a positive size."""
    known = (width > 0) & (height > 0)
    return F.when(known, F.ceil(width / CELL) * F.ceil(height / CELL)).otherwise(0).cast("long")


def record_lengths(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """(record_id, dataset, tokens): the length of each record in its last delivery."""
    letters = F.aggregate(F.coalesce("conversations", F.array()), F.lit(0).cast("long"), lambda n, turn: n + F.coalesce(F.length(turn["value"]), F.lit(0)))
    paths = F.when(F.col("image").isNotNull(), F.array("image")).otherwise(F.coalesce("image_list", F.array().cast("array<string>")))
    rows = annotations.filter("record_id is not null").select(F.col("record_id").cast("long").alias("record_id"), F.col("dataset").cast("string").alias("dataset"), F.ceil(letters / CHARACTERS_A_TOKEN).cast("long").alias("text_tokens"), paths.alias("paths"), "ingested_at")
    # the deliveries are read once; what is asked of the records below reads the written table
    last = cut(rows.groupBy("record_id").agg(F.max(F.struct(F.col("ingested_at"), F.col("text_tokens"), F.col("dataset"), F.col("paths"))).alias("r")).select("record_id", "r.dataset", "r.text_tokens", "r.paths"))
    sizes = images.filter("image is not null").groupBy("image").agg(F.max(cells(F.col("width"), F.col("height"))).alias("cells"))
    # An image may hold a large share of the rows. Fewer than HOT_PARTS images can hold more than that part of all uses;
    # their sizes are broadcast, the others are joined by a shuffle.
    uses = last.select("record_id", F.explode("paths").alias("image")).filter("image is not null and image <> ''")
    counts = uses.groupBy("image").agg(F.count("*").alias("n"))
    hot = counts.filter(F.col("n") * HOT_PARTS > uses.count()).join(sizes, "image").select("image", F.col("cells").alias("hot_cells"))
    known = uses.join(F.broadcast(hot), "image", "left")
    cold = known.filter("hot_cells is null").join(sizes, "image").select("record_id", "cells")
    per_record = known.filter("hot_cells is not null").select("record_id", F.col("hot_cells").alias("cells")).unionByName(cold).groupBy("record_id").agg(F.sum("cells").alias("cells"))
    return last.join(per_record, "record_id", "left").select("record_id", "dataset", (F.col("text_tokens") + F.coalesce("cells", F.lit(0))).alias("tokens"))


class _Sums:
    """The lengths and their sums as bit sets: bit n of single, pair and triple says that n is a length or a sum of two or three.

    single is always right; pair and triple are never too narrow, and are made anew when they named a sum that is not there.
    The mirrored sets have bit capacity - n instead of n, so that a shift lines up lengths with what they lack of a total.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity, self.mask = counts, capacity, (1 << capacity + 1) - 1
        self.single = self.mirrored = 0
        for length in counts:
            self.single |= 1 << length
            self.mirrored |= 1 << capacity - length
        self.index()

    def index(self) -> None:
        self.pair = self.mirrored_pair = self.triple = 0
        for length in self.counts:
            self.pair |= self.single << length & self.mask
            self.mirrored_pair |= self.mirrored >> length
        for length in self.counts:
            self.triple |= self.pair << length & self.mask
        self.stale = False

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.single &= ~(1 << length)
            self.mirrored &= ~(1 << self.capacity - length)
            self.stale = True

    def largest(self, most: int) -> int:
        """The largest length there up to a bound, 0 if none."""
        return (self.single & (1 << most + 1) - 1).bit_length() - 1 if most > 0 and self.single & (1 << most + 1) - 1 else 0

    def there(self, lengths: tuple[int, ...]) -> bool:
        return all(self.counts.get(x, 0) >= lengths.count(x) for x in set(lengths))

    def pair_for(self, total: int, used: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Two lengths with a sum, the larger as large as possible; used lengths are not there once more."""
        both = self.single & self.mirrored >> self.capacity - total
        while both:
            a = both.bit_length() - 1
            b = total - a
            if a < b:
                return None
            if self.there((a, b, *used)):
                return a, b
            both &= ~(1 << a)
        return None

    def triple_for(self, total: int, used: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Three lengths with a sum: each length whose rest is in the index of pairs is tried, the largest first."""
        first = self.single & self.mirrored_pair >> self.capacity - total
        while first:
            a = first.bit_length() - 1
            first &= ~(1 << a)
            if 3 * a < total:
                return None
            if self.there((a, *used)) and (found := self.pair_for(total - a, (a, *used))):
                return (a, *found)
        return None

    def complement(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that fill a gap exactly, None only if there are none."""
        if self.single >> gap & 1 and self.there((gap, *used)):
            return (gap,)
        for sums, search in ((self.pair, self.pair_for), (self.triple, self.triple_for)):
            if sums >> gap & 1:
                if found := search(gap, used):
                    return found
                if self.stale:
                    self.index()
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a container, number of such containers) that place all counted items of 1 to capacity."""
    sums = _Sums({k: n for k, n in counts.items() if n > 0}, capacity)
    patterns = []
    while sums.counts:
        content: tuple[int, ...] = (sums.largest(capacity),)
        gap = capacity - content[0]
        while gap:
            if found := sums.complement(gap, content):
                content, gap = content + found, 0
                break
            most = gap
            while (length := sums.largest(most)) and not sums.there((length, *content)):
                most = length - 1
            if not length:
                break
            content, gap = (*content, length), gap - length
        times = min(sums.counts[x] // content.count(x) for x in set(content))
        for x in set(content):
            sums.take(x, times * content.count(x))
        patterns.append((content, times))
    return patterns


_SLOTS = "dataset string, length long, first long, per_container long, container long, containers long"


def _plan_group(group: pd.DataFrame) -> pd.DataFrame:
    """Slots of a group: from rank first on, each per_container items of a length go to one more container; and how many containers there are."""
    capacity = int(group["capacity"].iloc[0])
    counts = dict(zip(group["length"].astype(int), group["n"].astype(int)))
    zero, rows, next_rank, container = counts.pop(0, 0), [], {}, 0
    for content, times in plan(counts, capacity):
        for length in dict.fromkeys(content):
            n = content.count(length)
            first = next_rank.get(length, 0)
            rows.append((length, first, n, container))
            next_rank[length] = first + n * times
        container += times
    if zero:
        rows.append((0, 0, zero, 0))
    out = pd.DataFrame(rows, columns=["length", "first", "per_container", "container"])
    out.insert(0, "dataset", group["dataset"].iloc[0])
    out["containers"] = max(container, 1 if zero else 0)
    return out


def placed(ranks: DataFrame, slots: DataFrame, block: int = RANKS_A_BLOCK) -> DataFrame:
    """ranks with the slot of each: the last one of its group and length that begins at or before its rank.

    Slots are laid among the ranks in blocks, each slot into every block that it reaches, and carried on by a window over the
    block; no rank meets more than one slot.
    """
    ends = slots.withColumn("last", F.lead("first").over(W.partitionBy("dataset", "length").orderBy("first")))
    counts = ranks.groupBy("dataset", "length").agg(F.max("rank").alias("most"))
    reach = ends.join(counts, ["dataset", "length"]).withColumn("_end", F.least(F.coalesce(F.col("last") - 1, F.col("most")), F.col("most"))).filter("first <= _end")
    begins = reach.withColumn("_block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"_end div {block}"))))
    begins = begins.select("dataset", "length", "_block", F.greatest(F.col("first"), F.col("_block") * block).alias("_at"), F.struct("first", "per_container", "container").alias("_slot"))
    rows = ranks.select("dataset", "length", F.expr(f"rank div {block}").alias("_block"), F.col("rank").alias("_at"), F.struct("*").alias("_row"))
    both = begins.unionByName(rows, allowMissingColumns=True)
    order = W.partitionBy("dataset", "length", "_block").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_slot", F.last("_slot", ignorenulls=True).over(order)).filter("_row is not null").select("_row.*", "_slot.*")


def ranked(items: DataFrame, keys: list[str], order: str, salts: int = SALTS) -> DataFrame:
    """Adds rank, from 0, within the keys: ranks within salted parts plus the sizes of the parts before."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))).select(*keys, "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    local = salted.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(order)) - 1)
    return local.join(before, [*keys, "_salt"]).withColumn("rank", F.col("_before") + F.col("_local")).drop("_salt", "_before", "_local")


def packed(lengths: DataFrame, capacities: DataFrame) -> DataFrame:
    """(record_id, dataset, piece, tokens, container): every record, cut only where it exceeds its container.

    lengths has record_id, dataset and tokens; capacities has dataset and max_tokens. Containers count from 0 within a dataset.
    """
    limits = capacities.filter("dataset is not null and max_tokens >= 1").groupBy("dataset").agg(F.max("max_tokens").cast("long").alias("capacity"))
    known = cut(lengths.join(small(limits, MOST_GROUPS), "dataset", "left"))
    inside = known.filter("capacity is not null")
    items = inside.withColumn("length", F.when(F.col("tokens") > F.col("capacity"), F.expr("tokens % capacity")).otherwise(F.col("tokens")))
    placed_items = items.filter("tokens <= capacity or length > 0")
    counts = placed_items.groupBy("dataset", "capacity", "length").agg(F.count("*").alias("n"))
    slots = cut(counts.groupBy("dataset").applyInPandas(_plan_group, _SLOTS))
    place = placed(ranked(placed_items, ["dataset", "length"], "record_id"), slots)
    rest = place.select("record_id", "dataset", F.when(F.col("tokens") > F.col("capacity"), F.expr("tokens div capacity")).otherwise(0).cast("int").alias("piece"), F.col("length").alias("tokens"), (F.col("container") + F.expr("(rank - first) div per_container")).alias("container"))
    # Full pieces of long records fill containers of their own after the planned ones.
    used = small(slots.groupBy("dataset").agg(F.max("containers").alias("used")), MOST_GROUPS)
    long = ranked(inside.filter("tokens > capacity").select("record_id", "dataset", "tokens", "capacity", F.expr("tokens div capacity").alias("pieces")), ["dataset", "pieces"], "record_id")
    groups = long.groupBy("dataset", "pieces").agg(F.count("*").alias("_n"))
    offsets = groups.withColumn("offset", F.coalesce(F.sum(F.col("_n") * F.col("pieces")).over(W.partitionBy("dataset").orderBy("pieces").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    full = (
        long.join(offsets, ["dataset", "pieces"])
        .join(used, "dataset", "left")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int"))))
        .select("record_id", "dataset", "piece", F.col("capacity").alias("tokens"), (F.coalesce("used", F.lit(0)) + F.col("offset") + F.col("rank") * F.col("pieces") + F.col("piece")).alias("container"))
    )
    outside = known.filter("capacity is null").select("record_id", "dataset", F.lit(0).alias("piece"), "tokens", F.lit(None).cast("long").alias("container"))
    return rest.unionByName(full).unionByName(outside)


def fill_report(pieces: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per dataset: records, tokens, containers, the fewest containers possible, and the share of space used."""
    limits = capacities.filter("dataset is not null and max_tokens >= 1").groupBy("dataset").agg(F.max("max_tokens").cast("long").alias("capacity"))
    per_container = pieces.filter("container is not null").groupBy("dataset", "container").agg(F.sum("tokens").alias("tokens"), F.sum((F.col("piece") == 0).cast("long")).alias("records"))
    return (
        per_container.join(small(limits, MOST_GROUPS), "dataset")
        .groupBy("dataset", "capacity")
        .agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"))
        .withColumn("fewest", F.expr("(tokens + capacity - 1) div capacity"))
        .withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
    )
