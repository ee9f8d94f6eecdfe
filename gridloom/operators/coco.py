"""Area ranges, numbers of detections and the tables of figures of COCO and LVIS; operators/cells.py makes the scores they sum up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AREAS = (("all", 0.0, 1e10), ("small", 0.0, 32.0**2), ("medium", 32.0**2, 96.0**2), ("large", 96.0**2, 1e10))
MOST_DETECTIONS = (1, 10, 100)


def standard_table(precisions: DataFrame, recalls: DataFrame, groups: DataFrame | None = None, cat: str = "cat", most: int = 100) -> DataFrame:
    """(line, name, value): the twelve standard figures, means over the defined cells; with groups (cat, frequency) also AP by frequency."""
    p = precisions if groups is None else precisions.join(groups, cat)
    mean = lambda when: F.avg(F.when(when, F.col("ap")))
    whole = F.col("area") == "all"
    named = [("AP", whole), ("AP50", whole & (F.col("threshold") == 0.5)), ("AP75", whole & (F.col("threshold") == 0.75))] + [(f"AP_{a}", F.col("area") == a) for a in ("small", "medium", "large")]
    if groups is not None:
        named += [(f"AP_{f}", whole & (F.col("frequency") == f)) for f in "rcf"]
    ap = p.agg(*[mean(when).alias(name) for name, when in named])
    r = lambda when: F.avg(F.when(when, F.col("recall")))
    counts = [(f"AR_{m}", whole & (F.col("most") == m)) for m in MOST_DETECTIONS if groups is None] or [(f"AR_{most}", whole & (F.col("most") == most))]
    counts += [(f"AR_{a}", (F.col("area") == a) & (F.col("most") == most)) for a in ("small", "medium", "large")]
    ar = recalls.agg(*[r(when).alias(name) for name, when in counts])
    lines = lambda df, names, at: df.select(F.inline(F.array(*[F.struct(F.lit(at + i).alias("line"), F.lit(n).alias("name"), F.round(F.coalesce(F.col(n), F.lit(-1.0)), 9).alias("value")) for i, n in enumerate(names)])))
    return lines(ap, [n for n, _ in named], 1).unionByName(lines(ar, [n for n, _ in counts], 1 + len(named)))
