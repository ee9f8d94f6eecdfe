"""A sample whose categories have given proportions.

Categories are counted, integer quotas are allotted by largest remainder within minimum floors and availability, and in
every category the rows with the smallest seeded keys are taken, found through bucket sums rather than a sort of the
category.

Defined results for odd input
-----------------------------
* A row with a null id is ignored; an id that comes more than once counts once, with its last delivery.
* A category is spelled in any case and with any blanks, hyphens or underscores between its words; null or blank
  categories are in no target. Targets of one category are added, their largest minimum counts; null or negative
  shares count as 0. Shares are taken relative to their sum.
* If the minimums together exceed the sample, they are reduced in proportion, but none to 0 while another keeps more than one row; if the categories hold fewer rows than the sample, all their rows are taken. Either is reported, as is
  each target that cannot be met.
* Empty tables: empty sample; the report still has every target.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.draws import positions
from gridloom.operators.layout import bounded, cut, small

SAMPLE_PART = 10
SEED = 20
MOST_TARGETS = 100_000


def spelled(column: str) -> Column:
    """A category without differences of case and of what stands between its words; null if nothing is left."""
    text = F.trim(F.regexp_replace(F.lower(F.col(column).cast("string")), r"[\s\p{Z}_-]+", " "))
    return F.when(text != "", text)


def largest_remainder(total: int, weights: list[float]) -> list[int]:
    """Integers with a sum, in proportion to weights; ties go to the earlier one."""
    whole = sum(weights)
    if whole <= 0 or total <= 0:
        return [0] * len(weights)
    ideal = [total * w / whole for w in weights]
    out = [math.floor(x) for x in ideal]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - ideal[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def reduced(total: int, floors: list[int]) -> list[int]:
    """Minimums that exceed a total, in proportion, none of them 0 while another keeps more than one."""
    out = largest_remainder(total, floors)
    for i in sorted((i for i, f in enumerate(floors) if f and not out[i]), key=lambda i: (floors[i], i)):
        most = max(range(len(out)), key=lambda j: (out[j], -j))
        if out[most] > 1:
            out[most] -= 1
            out[i] = 1
    return out


def quotas(total: int, shares: list[float], floors: list[int], available: list[int]) -> list[int]:
    """Integer quotas between the floors and what is available, as close to the shares as these bounds allow."""
    low = [min(f, a) for f, a in zip(floors, available)]
    total = min(total, sum(available))
    if sum(low) >= total:
        return reduced(total, low) if sum(low) > total else low
    fixed: dict[int, int] = {}
    while True:
        open_ = [i for i in range(len(shares)) if i not in fixed]
        rest = total - sum(fixed.values())
        weights = [shares[i] if shares[i] > 0 else 0 for i in open_]
        if not open_:
            break
        if sum(weights) <= 0:  # only categories without a share are left: fill them evenly with what remains
            weights = [available[i] for i in open_]
        ideal = dict(zip(open_, largest_remainder(rest, weights)))
        over = {i: available[i] for i in open_ if ideal[i] > available[i]}
        under = {i: low[i] for i in open_ if ideal[i] < low[i]}
        if not over and not under:
            return [fixed.get(i, ideal.get(i, 0)) for i in range(len(shares))]
        surplus, deficit = sum(ideal[i] - a for i, a in over.items()), sum(f - ideal[i] for i, f in under.items())
        fixed |= over if surplus >= deficit else under
    return [fixed[i] for i in range(len(shares))]


_PLAN = "task string, expected_label string, target_task string, target_label string, target_share double, min_rows long, available long, wanted double, quota long, sample_rows long, reason string"


def _allot(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["task", "expected_label"]).reset_index(drop=True)
    samples, shares = int(group["samples"].iloc[0]), group["target_share"].tolist()
    size = (samples * 2 + SAMPLE_PART) // (2 * SAMPLE_PART)
    floors, available = group["min_rows"].astype(int).tolist(), group["available"].astype(int).tolist()
    whole = sum(shares) or 1.0
    group["wanted"] = [size * s / whole for s in shares]
    group["quota"] = quotas(size, shares, floors, available)
    group["sample_rows"] = sum(group["quota"])
    crowded = sum(min(f, a) for f, a in zip(floors, available)) > size
    reasons = []
    for wanted, quota, floor, have in zip(group["wanted"], group["quota"], floors, available):
        why = ["absent"] if not have else []
        if quota < floor:
            why.append("minimum not available" if have < floor else "minimums exceed the sample" if crowded else "minimum not met")
        if quota < math.floor(wanted):
            why.append("share not available" if quota == have else "share gives way to minimums")
        elif quota > math.ceil(wanted):
            why.append("share raised by its minimum" if crowded or quota == min(floor, have) else "share raised by shortfalls elsewhere")
        reasons.append(", ".join(why) or None)
    group["reason"] = reasons
    return group[[c.split()[0] for c in _PLAN.split(", ")]]


def latest_samples(manifest: DataFrame) -> DataFrame:
    """(sample_id, task, expected_label): each sample once, with its categories in one spelling."""
    rows = manifest.filter("sample_id is not null").select(F.col("sample_id").cast("long").alias("sample_id"), spelled("task").alias("task"), spelled("expected_label").alias("expected_label"), "ingested_at")
    last = rows.groupBy("sample_id").agg(F.max(F.struct("ingested_at", "task", "expected_label")).alias("r"))
    return last.select("sample_id", "r.task", "r.expected_label")


def category_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("task", "expected_label").agg(F.count("*").alias("available"))


def allotment(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: what is there, what the shares want, the quota and why it differs."""
    wanted = targets.select(spelled("task").alias("task"), spelled("expected_label").alias("expected_label"), F.struct("task", "expected_label").alias("written"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("min_rows").cast("long"), F.lit(0)), F.lit(0)).alias("min_rows"))
    wanted = wanted.filter("task is not null and expected_label is not null").groupBy("task", "expected_label").agg(F.sum("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"), F.min("written").alias("written"))
    wanted = wanted.select("*", F.col("written.task").cast("string").alias("target_task"), F.col("written.expected_label").cast("string").alias("target_label")).drop("written")
    counts = category_counts(samples)
    rows = wanted.join(counts, ["task", "expected_label"], "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("samples", F.lit(samples.count()))
    # the targets are a fixed table of at most MOST_TARGETS rows, allotted as one group
    return rows.groupBy("samples").applyInPandas(_allot, _PLAN)


def proportional_sample(manifest: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sample, report): the sample's ids with their categories, and a row for each target."""
    bounded(targets.select("task"), MOST_TARGETS, "targets")
    samples = cut(latest_samples(manifest))
    plan = cut(allotment(samples, targets))
    chosen = samples.join(small(plan.filter("quota > 0").select("task", "expected_label", "target_task", "target_label", "quota")), ["task", "expected_label"])
    sample = positions(chosen, ["task", "expected_label"], "sample_id", F.lit(1), seed).filter("position < quota").select("sample_id", F.col("target_task").alias("task"), F.col("target_label").alias("expected_label"))
    report = plan.drop("task", "expected_label").withColumnsRenamed({"target_task": "task", "target_label": "expected_label"}).select("*", F.round(F.when(F.col("sample_rows") > 0, F.col("quota") / F.col("sample_rows")), 9).alias("reached_share"))
    return sample, report
