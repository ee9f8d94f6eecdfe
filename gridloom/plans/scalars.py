"""Queries of box geometry, log statistics and other row-wise operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import geometry as G
from gridloom.operators.layout import small
from gridloom.plans.boxes import BOXES, gt_boxes
from gridloom.sources.tables import table


_ROW = f"WITH {BOXES}, b AS (SELECT *, 1000 + image_id % 900 AS w, 700 + image_id % 500 AS h FROM gt) "


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return gt_boxes(spark, folder).withColumn("w", F.expr("1000 + image_id % 900")).withColumn("h", F.expr("700 + image_id % 500"))


def _box() -> tuple:
    return tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))


def g1_norm_to_abs(spark, folder):
    out = G.norm_to_abs_box(_box(), F.col("w"), F.col("h"))
    return _rows(spark, folder).select("image_id", "ord", *[F.round(c, 6).alias(n) for c, n in zip(out, ("ax1", "ay1", "ax2", "ay2"))])


def _abs(v: str, d: str) -> str:
    return f"least(greatest({v} * {d} / 1000, 0.0), {d} - 1)"


G1 = _ROW + "SELECT image_id, ord, " + ", ".join(f"round({f}({_abs(a, d)}, {_abs(b, d)}), 6) AS a{n}" for f, a, b, d, n in (("least", "x1", "x2", "w", "x1"), ("least", "y1", "y2", "h", "y1"), ("greatest", "x1", "x2", "w", "x2"), ("greatest", "y1", "y2", "h", "y2"))) + " FROM b"


def g2_unscale(spark, folder):
    coords = F.expr("case ord % 3 when 0 then array(x1, y1) when 1 then array(x1, y1, x2, y2) else array(x1) end")
    return _rows(spark, folder).select("image_id", "ord", G.unscale(coords, F.lit(0.5)).alias("coords"))


G2 = _ROW + "SELECT image_id, ord, CASE ord % 3 WHEN 0 THEN [x1 / 0.5, y1 / 0.5] WHEN 1 THEN [x1 / 0.5, y1 / 0.5, x2 / 0.5, y2 / 0.5] END AS coords FROM b"


def g3_norm_to_pixel(spark, folder):
    span = G.norm_to_pixel_span(F.col("x1") * 2, F.col("x1") * 2 + F.expr("ord % 3"), F.col("w").cast("int"))
    return _rows(spark, folder).select("image_id", "ord", span["low"].alias("low"), span["high"].alias("high"))


G3 = _ROW + """, s AS (SELECT image_id, ord, w, least(greatest(round_even(x1 * 2 * w / 1000, 0), 0), w)::INT AS a, least(greatest(round_even((x1 * 2 + ord % 3) * w / 1000, 0), 0), w)::INT AS b FROM b)
SELECT image_id, ord, CASE WHEN b > a THEN a WHEN b = a AND b < w THEN a WHEN b = a AND a > 0 THEN a - 1 END AS low, CASE WHEN b > a THEN b WHEN b = a AND b < w THEN b + 1 WHEN b = a AND a > 0 THEN b END AS high FROM s"""


def g4_to_norm1000(spark, folder):
    kind = F.expr("element_at(array('pixel', 'norm1000', 'norm01', ''), cast(ord % 4 as int) + 1)")
    divide = F.when(kind == "norm01", 1000.0).otherwise(1.0)
    return _rows(spark, folder).select("image_id", "ord", G.to_norm1000(tuple(c / divide for c in _box()), F.col("w"), F.col("h"), kind).alias("box"))


G4 = _ROW + """, k AS (SELECT *, CASE WHEN ord % 4 = 0 THEN 1000.0::DOUBLE / w WHEN ord % 4 = 2 THEN 1000.0::DOUBLE WHEN ord % 4 = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END AS fx,
  CASE WHEN ord % 4 = 0 THEN 1000.0::DOUBLE / h WHEN ord % 4 = 2 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS fy, CASE WHEN ord % 4 = 2 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS d FROM b),
v AS (SELECT image_id, ord, [least(greatest(round_even(x1 / d * fx, 0), 0), 1000)::INT, least(greatest(round_even(y1 / d * fy, 0), 0), 1000)::INT, least(greatest(round_even(x2 / d * fx, 0), 0), 1000)::INT, least(greatest(round_even(y2 / d * fy, 0), 0), 1000)::INT] AS box FROM k)
SELECT image_id, ord, CASE WHEN box[3] > box[1] AND box[4] > box[2] THEN box END AS box FROM v"""


def g7_iou_crowd(spark, folder):
    a = (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    b = (F.col("x1") + 10, F.col("y1") + F.col("ord"), F.lit(80.0), F.lit(70.0))
    return _rows(spark, folder).select("image_id", "ord", F.round(G.iou_crowd(a, b, F.col("crowd")), 9).alias("iou"))


G7 = _ROW + """, o AS (SELECT image_id, ord, crowd, (x2 - x1) * (y2 - y1) AS own, least(x2, x1 + 90) - (x1 + 10) AS iw, least(y2, y1 + ord + 70) - (y1 + ord) AS ih FROM b)
SELECT image_id, ord, round(CASE WHEN iw <= 0 OR ih <= 0 THEN 0 ELSE iw * ih / CASE WHEN crowd THEN own ELSE own + 5600 - iw * ih END END, 9) AS iou FROM o"""


def g11_size_bucket(spark, folder):
    return _rows(spark, folder).groupBy(G.size_bucket(G.area(_box()) / F.expr("1 + ord * ord")).alias("size")).agg(F.count("*").alias("n"))


G11 = _ROW + "SELECT CASE WHEN a < 1024 THEN 'small' WHEN a < 9216 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM (SELECT (x2 - x1) * (y2 - y1) / (1 + ord * ord) AS a FROM b) GROUP BY ALL"


def g12_gt_count_bucket(spark, folder):
    return _rows(spark, folder).groupBy("image_id").agg(F.count("*").alias("n")).groupBy(G.count_bucket(F.col("n") * 2).alias("bucket")).agg(F.count("*").alias("images"))


G12 = _ROW + "SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 15 THEN '11-15' WHEN n <= 20 THEN '16-20' ELSE '20+' END AS bucket, count(*) AS images FROM (SELECT count(*) * 2 AS n FROM b GROUP BY image_id) GROUP BY ALL"


def g13_point_in_box(spark, folder):
    turned = (F.col("x2"), F.col("y2"), F.col("x1"), F.col("y1"))
    return _rows(spark, folder).select("image_id", "ord", G.point_in_box(F.expr("150.0D"), F.expr("200.0D"), turned).alias("inside"))


G13 = _ROW + "SELECT image_id, ord, 150 BETWEEN x1 AND x2 AND 200 BETWEEN y1 AND y2 AS inside FROM b"


def g15_box_center(spark, folder):
    x, y = G.center(_box())
    return _rows(spark, folder).select("image_id", "ord", x.alias("x"), y.alias("y"))


G15 = _ROW + "SELECT image_id, ord, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM b"


def g16_crop_box(spark, folder):
    span = G.crop_span(F.col("x1") * 3 + 0.5, F.col("x1") * 3 + F.expr("ord % 4"), F.col("w").cast("int"))
    return _rows(spark, folder).select("image_id", "ord", span["low"].alias("low"), span["high"].alias("high"))


G16 = _ROW + ", s AS (SELECT image_id, ord, least(greatest(round_even(x1 * 3 + 0.5, 0), 0), w - 1)::INT AS a, least(greatest(round_even(x1 * 3 + ord % 4, 0), 0), w)::INT AS b FROM b) SELECT image_id, ord, a AS low, greatest(b, a + 1) AS high FROM s"


def g17_resize(spark, folder):
    r, q = G.resize_short_side(F.col("w"), F.col("h"), 448, 1000), G.resize_long_edge(F.col("w"), F.col("h"), 640)
    return _rows(spark, folder).filter("ord = 1").select("image_id", F.round(r["scale"], 9).alias("scale"), r["width"].alias("width"), r["height"].alias("height"), q["width"].alias("long_width"), q["height"].alias("long_height"))


G17 = _ROW + """, s AS (SELECT image_id, w, h, least(448.0::DOUBLE / least(w, h), 1000.0::DOUBLE / greatest(w, h)) AS scale, least(1.0::DOUBLE, 640.0::DOUBLE / greatest(w, h)) AS q FROM b WHERE ord = 1)
SELECT image_id, round(scale, 9) AS scale, floor(w * scale)::INT AS width, floor(h * scale)::INT AS height, floor(w * q)::INT AS long_width, floor(h * q)::INT AS long_height FROM s"""


def g18_patch_grid(spark, folder):
    p = G.patch_grid(F.col("w") * F.col("ord"), F.col("h") * F.col("ord"))
    return _rows(spark, folder).select("image_id", "ord", p["columns"].alias("columns"), p["rows"].alias("rows"), p["tokens"].alias("tokens"))


G18 = _ROW + """, t AS (SELECT image_id, ord, w * ord AS w, h * ord AS h, (w * ord / 14) * (h * ord / 14) AS n FROM b), s AS (SELECT *, CASE WHEN n > 25600 THEN sqrt(25600.0::DOUBLE / n) ELSE 1.0 END AS z FROM t),
g AS (SELECT image_id, ord, (ceil(floor(w * z) / 28) * 2)::INT AS columns, (ceil(floor(h * z) / 28) * 2)::INT AS rows FROM s) SELECT image_id, ord, columns, rows, floor(columns * rows / 4)::INT AS tokens FROM g"""


def g19_frame_indices(spark, folder):
    return _rows(spark, folder).filter("ord = 1").select("image_id", G.frame_indices(F.col("w").cast("int"), F.lit(25.0), 2.0, 16).alias("frames"))


G19 = _ROW + """, n AS (SELECT image_id, w, least(greatest(round_even(w / 25.0 * 2.0, 0), 1), 16, w)::INT AS n FROM b WHERE ord = 1)
SELECT image_id, CASE WHEN n = 1 THEN [0] ELSE list_transform(range(n), lambda i: round_even(i * (w - 1) / (n - 1), 0)::INT) END AS frames FROM n"""


def g20_pixel_cap(spark, folder):
    return _rows(spark, folder).filter("ord = 1").select("image_id", F.round(G.pixel_cap(F.expr("image_id % 30"), F.col("h"), F.col("w"), 9_000_000), 9).alias("scale"))


G20 = _ROW + "SELECT image_id, round(CASE WHEN (image_id % 30) * h * w > 9000000 THEN sqrt(9000000.0::DOUBLE / ((image_id % 30) * h * w)) ELSE 1.0 END, 9) AS scale FROM b WHERE ord = 1"


def g21_oks(spark, folder):
    """Keypoint similarity of two points, the second one missing where the box order is odd; averaged per image (A5)."""
    gt = F.create_map(F.lit("a"), F.array("x1", "y1"), F.lit("b"), F.array("x2", "y2"))
    near = F.create_map(F.lit("a"), F.array(F.col("x1") + F.expr("ord % 3"), F.col("y1")), F.lit("b"), F.array(F.col("x2"), F.col("y2") + 2))
    pred = F.when(F.expr("ord % 2 = 1"), F.map_filter(near, lambda k, _: k == "a")).otherwise(near)
    return _rows(spark, folder).select("image_id", "ord", F.round(G.oks(gt, pred, G.area(_box())), 9).alias("oks"))


_OKS = """, o AS (SELECT image_id, ord, CASE WHEN ord % 2 = 1 THEN exp(-((ord % 3) ** 2) / (0.00125 * a)) ELSE (exp(-((ord % 3) ** 2) / (0.00125 * a)) + exp(-4 / (0.00125 * a))) / 2 END AS oks FROM (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM b))"""
G21 = _ROW + _OKS + " SELECT image_id, ord, round(oks, 9) AS oks FROM o"


def _best_oks(spark, folder) -> DataFrame:
    """(image_id, ord, best): of every annotated instance the best similarity to any predicted instance of its image."""
    rows = _rows(spark, folder)
    gt = rows.select("image_id", "ord", F.create_map(F.lit("a"), F.array("x1", "y1"), F.lit("b"), F.array("x2", "y2")).alias("gt"), G.area(_box()).alias("size"))
    near = F.create_map(F.lit("a"), F.array(F.col("x1") + F.expr("ord % 3"), F.col("y1")), F.lit("b"), F.array(F.col("x2"), F.col("y2") + 2))
    pred = rows.select("image_id", F.when(F.expr("ord % 2 = 1"), F.map_filter(near, lambda k, _: k == "a")).otherwise(near).alias("pred"))
    return gt.join(pred, "image_id").groupBy("image_id", "ord").agg(F.max(G.oks(F.col("gt"), F.col("pred"), F.col("size"))).alias("best"))


def a5_keypoint_ap(spark, folder):
    """Per image the share of instances whose best similarity reaches each threshold, and the mean of the best similarities."""
    best = _best_oks(spark, folder)
    reached = [F.round(F.avg((F.round("best", 9) >= t).cast("int")), 9).alias(f"ap{int(t * 100)}") for t in (0.5, 0.75, 0.9, 0.95)]
    return best.groupBy("image_id").agg(*reached, F.round(F.avg("best"), 9).alias("mean_oks"))


_BEST = """, pairs AS (SELECT g.image_id, g.ord, p.ord AS q, ((p.x1 + p.ord % 3 - g.x1) ** 2 + (p.y1 - g.y1) ** 2) AS da, ((p.x2 - g.x2) ** 2 + (p.y2 + 2 - g.y2) ** 2) AS db, 0.00125 * (g.x2 - g.x1) * (g.y2 - g.y1) AS s FROM b g JOIN b p USING (image_id)),
best AS (SELECT image_id, ord, max(CASE WHEN q % 2 = 1 THEN exp(-da / s) ELSE (exp(-da / s) + exp(-db / s)) / 2 END) AS best FROM pairs GROUP BY ALL)"""
A5 = _ROW + _BEST + " SELECT image_id, " + ", ".join(f"round(avg((round(best, 9) >= {t})::INT), 9) AS ap{int(t * 100)}" for t in (0.5, 0.75, 0.9, 0.95)) + ", round(avg(best), 9) AS mean_oks FROM best GROUP BY image_id"


def m4_best_oks(spark, folder):
    return _best_oks(spark, folder).select("image_id", "ord", F.round("best", 9).alias("best"))


M4 = _ROW + _BEST + " SELECT image_id, ord, round(best, 9) AS best FROM best"


def g22_coarse_box(spark, folder):
    """Mean plus and minus two deviations of weighted positions, in 0..1000."""
    w, out = F.col("ord").cast("double"), []
    for c in ("x1", "y1"):
        mean = F.sum(w * F.col(c)) / F.sum(w)
        spread = F.sqrt(F.greatest(F.sum(w * F.col(c) * F.col(c)) / F.sum(w) - mean * mean, F.lit(0.0)))
        out += [F.round(F.least(F.greatest(mean + s * spread, F.lit(0.0)), F.lit(1000.0)), 5).alias(f"{c[0]}_{n}") for s, n in ((-2, "low"), (2, "high"))]
    return _rows(spark, folder).groupBy("image_id").agg(*out)


G22 = _ROW + ", s AS (SELECT image_id, " + ", ".join(f"sum(ord * {c}) / sum(ord) AS m{c[0]}, sqrt(greatest(sum(ord * {c} * {c}) / sum(ord) - (sum(ord * {c}) / sum(ord)) ** 2, 0)) AS s{c[0]}" for c in ("x1", "y1")) + " FROM b GROUP BY image_id) SELECT image_id, " + ", ".join(f"round(least(greatest(m{c} {s} 2 * s{c}, 0), 1000), 5) AS {c}_{n}" for c in "xy" for s, n in (("-", "low"), ("+", "high"))) + " FROM s"


def g23_ring_target(spark, folder):
    """Patches of a 10 x 10 grid in the ring of three times the box around it, each with an equal share; per image's first box."""
    b = _rows(spark, folder).filter("ord = 1").select("image_id", *[F.floor(F.col(c) / 64).alias(c) for c in ("x1", "y1", "x2", "y2")])
    cells = b.withColumn("cx", F.explode(F.sequence(F.greatest(2 * F.col("x1") - F.col("x2"), F.lit(0)), F.least(2 * F.col("x2") - F.col("x1"), F.lit(9))))).withColumn("cy", F.explode(F.sequence(F.greatest(2 * F.col("y1") - F.col("y2"), F.lit(0)), F.least(2 * F.col("y2") - F.col("y1"), F.lit(9)))))
    ring = cells.filter("not (cx between x1 and x2 and cy between y1 and y2)")
    return ring.groupBy("image_id").agg(F.count("*").alias("patches"), F.round(1 / F.count("*"), 9).alias("share"))


G23 = _ROW + """, f AS (SELECT image_id, floor(x1 / 64)::BIGINT AS x1, floor(y1 / 64)::BIGINT AS y1, floor(x2 / 64)::BIGINT AS x2, floor(y2 / 64)::BIGINT AS y2 FROM b WHERE ord = 1)
SELECT image_id, count(*) AS patches, round(1 / count(*), 9) AS share FROM f, range(10) a(cx), range(10) c(cy)
WHERE cx BETWEEN 2 * x1 - x2 AND 2 * x2 - x1 AND cy BETWEEN 2 * y1 - y2 AND 2 * y2 - y1 AND NOT (cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2) GROUP BY image_id"""


def g24_safe_f1(spark, folder):
    p, r = F.expr("cast(ord % 3 as double) / 3"), F.expr("cast(image_id % 4 as double) / 4")
    return _rows(spark, folder).select("image_id", "ord", F.round(G.f1(p, r), 9).alias("f1"))


G24 = _ROW + "SELECT image_id, ord, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (SELECT image_id, ord, (ord % 3) / 3 AS p, (image_id % 4) / 4 AS r FROM b)"

FRACTION = "('0x' || substr(sha256({seed} || ':' || {text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def g25_digest_fraction(spark, folder):
    """The share of each image path by its short digest, and the split that a tenth for validation makes of it."""
    fraction = G.digest_fraction(F.col("image"), 10086)
    return table(spark, folder, "images").select("image_id", "image", fraction.alias("fraction")).withColumn("split", F.when(F.col("fraction") < 0.1, "val").when(F.col("fraction").isNotNull(), "train"))


def g25_stable_fraction(spark, folder):
    return table(spark, folder, "images").select("image_id", G.stable_fraction(F.col("image"), F.lit(42)).alias("fraction"))


G25 = f"SELECT image_id, {FRACTION.format(seed=chr(39) + '42' + chr(39), text='image')} AS fraction FROM images"


def f6_train_val_split(spark, folder):
    """The side of each image; all records of an image are on one side."""
    side = F.when(G.stable_fraction(F.col("image"), F.lit(7)) < 0.1, "val").otherwise("train")
    return table(spark, folder, "annotations").filter("image is not null").select("record_id", "image", side.alias("side")).distinct()


F6 = f"SELECT DISTINCT record_id, image, CASE WHEN {FRACTION.format(seed=chr(39) + '7' + chr(39), text='image')} < 0.1 THEN 'val' ELSE 'train' END AS side FROM annotations WHERE image IS NOT NULL"


def f5_negative_downsample(spark, folder):
    """Positives and the negatives whose fraction lies below the ratio."""
    text = F.concat(F.coalesce("task", F.lit("")), F.lit("|"), F.coalesce("image", F.lit("")))
    return table(spark, folder, "manifest").filter((F.col("kind") == "positive") | (G.stable_fraction(text, F.lit(8)) < 0.25)).select("sample_id", "kind").distinct()


F5 = f"SELECT DISTINCT sample_id, kind FROM manifest WHERE kind = 'positive' OR {FRACTION.format(seed=chr(39) + '8' + chr(39), text='''coalesce(task, '') || '|' || coalesce(image, '')''')} < 0.25"


def f7_skip_names(spark, folder):
    return table(spark, folder, "manifest").filter(~F.coalesce(F.col("sha256").contains(":"), F.lit(False))).groupBy("kind").agg(F.count("*").alias("n"))


F7 = "SELECT kind, count(*) AS n FROM manifest WHERE NOT coalesce(contains(sha256, ':'), false) GROUP BY kind"


def f1_score_threshold(spark, folder):
    """How many detections each format keeps: at least, above, or any score."""
    rows = gt_boxes(spark, folder).selectExpr("((ord * 37) % 100) / 100.0D as score")
    return rows.agg(F.count_if(F.expr("score >= 0.37")).alias("at_least"), F.count_if(F.expr("score > 0.37")).alias("above"), F.count("*").alias("kept_all"))


F1 = f"WITH {BOXES} SELECT count(*) FILTER (s >= 0.37) AS at_least, count(*) FILTER (s > 0.37) AS above, count(*) AS kept_all FROM (SELECT ((ord * 37) % 100) / 100.0::DOUBLE AS s FROM gt)"


def f10_wrong_rejection(spark, folder):
    """Prediction lists with a null or a written none among other entries."""
    lists = gt_boxes(spark, folder).groupBy("image_id").agg(F.array_sort(F.collect_list(F.expr("case when ord = 7 then 'None' else cast(ord as string) end"))).alias("p"))
    return lists.select("image_id", F.exists("p", lambda v: v.isNull() | (F.lower(v) == "none")).alias("wrong"))


F10 = f"WITH {BOXES} SELECT image_id, bool_or(ord = 7) AS wrong FROM gt GROUP BY image_id"


def f4_max_tokens(spark, folder):
    return table(spark, folder, "documents").filter("n_chars is not null and n_chars <= 400").groupBy("source").agg(F.count("*").alias("n"))


F4 = "SELECT source, count(*) AS n FROM documents WHERE n_chars <= 400 GROUP BY source"


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = F.expr("concat('x 12 Statistic Info, num_tokens=', cast(event_id % 900 as string), '; tps=', cast(event_id % 37 as string), '.5; done=', if(event_id % 2 = 0, 'true', 'False'), '; note=n/a')")
    return table(spark, folder, "events").select("event_id", F.when(F.expr("event_id % 7 = 0"), F.lit("noise a=1")).otherwise(line).alias("line"))


def kv_log_parse(lines: DataFrame, line: str = "line", marker: str = "Statistic Info,") -> DataFrame:
    """(event_id, key, value) of the pairs of marked lines; true and false count as 1 and 0, other values are dropped."""
    text = F.col(line)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"([\w()]+)=([^;]+)"), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(r"([\w()]+)=([^;]+)"), F.lit(2)).alias("v"))
    rows = lines.filter(text.contains(marker)).select("event_id", F.explode(pairs).alias("p")).select("event_id", F.col("p.k").alias("key"), F.trim(F.col("p.v")).alias("raw"))
    value = F.when(F.lower("raw") == "true", 1.0).when(F.lower("raw") == "false", 0.0).otherwise(F.col("raw").try_cast("double"))
    return rows.select("event_id", "key", value.alias("value")).filter("value is not null")


def p24_kv_log_parse(spark, folder):
    return kv_log_parse(log_lines(spark, folder))


P24 = """SELECT event_id, 'num_tokens' AS key, (event_id % 900)::DOUBLE AS value FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, 'tps', event_id % 37 + 0.5 FROM events WHERE event_id % 7 <> 0
UNION ALL SELECT event_id, 'done', CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END FROM events WHERE event_id % 7 <> 0"""


def a21_log_stats(spark, folder):
    return kv_log_parse(log_lines(spark, folder)).groupBy("key").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.sum("value"), 3).alias("total"), F.count("*").alias("n"))


A21 = f"SELECT key, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(sum(value), 3) AS total, count(*) AS n FROM ({P24}) GROUP BY key"


def a25_throughput(spark, folder):
    """Tokens a second and switches per event type."""
    e = table(spark, folder, "events").select("event_type", F.expr("event_id % 900").alias("tokens"), F.expr("(event_id % 37 + 1) / 4.0D").alias("seconds"))
    return e.groupBy("event_type").agg(F.round(F.sum("tokens") / F.sum("seconds"), 6).alias("tps"), F.count_if(F.expr("tokens % 5 = 0")).alias("switches"))


A25 = "SELECT event_type, round(sum(event_id % 900) / sum((event_id % 37 + 1) / 4.0::DOUBLE), 6) AS tps, count(*) FILTER (event_id % 900 % 5 = 0) AS switches FROM events GROUP BY event_type"


def a22_prep_stats(spark, folder):
    """Counters per task and in total, with the first positive sample."""
    m = table(spark, folder, "manifest")
    return m.rollup("task").agg(F.grouping("task").cast("int").alias("total"), F.count("*").alias("rows"), F.count_if(F.expr("kind = 'positive'")).alias("positives"), F.count_if(F.expr("image is null or trim(image) = ''")).alias("no_image"), F.min(F.when(F.col("kind") == "positive", F.col("sample_id"))).alias("first_positive"))


A22 = "SELECT task, grouping(task)::INT AS total, count(*) AS rows, count(*) FILTER (kind = 'positive') AS positives, count(*) FILTER (image IS NULL OR trim(image) = '') AS no_image, min(sample_id) FILTER (kind = 'positive') AS first_positive FROM manifest GROUP BY ROLLUP (task)"


def a23_run_summary(spark, folder):
    return table(spark, folder, "annotations").rollup("defect_type", "dataset").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


A23 = "SELECT defect_type, dataset, (grouping(defect_type) * 2 + grouping(dataset))::INT AS level, count(*) AS n FROM annotations GROUP BY ROLLUP (defect_type, dataset)"


def a18_positive_mean(spark, folder):
    from gridloom.operators.metrics import positive_mean

    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.round(positive_mean(F.col("c_acctbal")), 6).alias("mean"))


A18 = "SELECT c_mktsegment, round(coalesce(avg(c_acctbal) FILTER (c_acctbal > 0), 0), 6) AS mean FROM customer GROUP BY c_mktsegment"


def j1_equi_lookup(spark, folder):
    """Sizes of annotated images, joined by path; records whose image is unknown are counted."""
    a = table(spark, folder, "annotations").filter("image is not null")
    i = table(spark, folder, "images").select("image", "image_id")
    return a.join(i, "image", "left").groupBy("dataset").agg(F.count("*").alias("records"), F.count_if(F.col("image_id").isNull()).alias("unknown"))


J1 = "SELECT dataset, count(*) AS records, count(*) FILTER (image_id IS NULL) AS unknown FROM annotations LEFT JOIN images USING (image) WHERE image IS NOT NULL GROUP BY dataset"


def j2_left_join_fallback(spark, folder):
    """A document's own language unless it is unknown, else the most frequent one of its app."""
    d = table(spark, folder, "documents").select("doc_id", "app_key", F.lower("lang").alias("lang"))
    known = d.filter("lang in ('en', 'de', 'fr', 'es', 'zh')").groupBy("app_key", "lang").count()
    best = known.groupBy("app_key").agg(F.min_by("lang", F.struct(-F.col("count"), "lang")).alias("usual"))
    own = F.when(F.col("lang").isin("en", "de", "fr", "es", "zh"), F.col("lang"))
    return d.join(best, "app_key", "left").select("doc_id", F.coalesce(own, "usual").alias("lang"))


J2 = """WITH d AS (SELECT doc_id, app_key, lower(lang) AS lang FROM documents), c AS (SELECT app_key, lang, count(*) AS n FROM d WHERE lang IN ('en', 'de', 'fr', 'es', 'zh') GROUP BY ALL), b AS (SELECT app_key, arg_min(lang, (-n, lang)) AS usual FROM c GROUP BY app_key)
SELECT doc_id, coalesce(CASE WHEN lang IN ('en', 'de', 'fr', 'es', 'zh') THEN lang END, usual) AS lang FROM d LEFT JOIN b USING (app_key)"""


def j5_resume_anti_join(spark, folder):
    """Images without a record: what an interrupted run still has to do."""
    done = table(spark, folder, "annotations").select("image").filter("image is not null").distinct()
    return table(spark, folder, "images").join(done, "image", "left_anti").select("image_id")


J5 = "SELECT image_id FROM images WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.image = images.image)"


def j7_category_intersection(spark, folder):
    from gridloom.plans.boxes import boxes

    gt, pred = boxes(spark, folder)
    sets = gt.groupBy("image_id").agg(F.collect_set("cat").alias("a")).join(pred.filter("score > 0.5").groupBy("image_id").agg(F.collect_set("cat").alias("b")), "image_id", "left")
    return sets.select("image_id", F.size(F.array_intersect("a", F.coalesce("b", F.array()))).alias("shared"))


J7 = f"WITH {BOXES} SELECT g.image_id, count(DISTINCT p.cat)::INT AS shared FROM (SELECT DISTINCT image_id FROM gt) g LEFT JOIN pred p ON p.image_id = g.image_id AND score > 0.5 GROUP BY g.image_id"


def j8_threshold_grid(spark, folder):
    """Every event type with each of the ten thresholds (a fixed grid)."""
    types = table(spark, folder, "events").select("event_type").distinct()
    return types.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("event_type", F.round(F.lit(0.5) + F.col("i") * 0.05, 2).alias("threshold"))


J8 = "SELECT event_type, round(0.5::DOUBLE + i * 0.05::DOUBLE, 2) AS threshold FROM (SELECT DISTINCT event_type FROM events), range(10) r(i)"


def j9_asof_lookup(spark, folder):
    """The last purchase of a user strictly before each click, by one window over the union."""
    e = table(spark, folder, "events").filter("event_type in ('click', 'purchase')")
    bought = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True)
    order = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    seen = e.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("k", F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id")))
    return seen.select("event_id", "event_type", F.max("k").over(order)["event_id"].alias("purchase")).filter("event_type = 'click'").select("event_id", "purchase")


J9 = """SELECT c.event_id, max_by(p.event_id, (p.ts, p.event_id)) AS purchase FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts < c.ts WHERE c.event_type = 'click' GROUP BY c.event_id"""


def _range_lookup(spark, folder, wanted):
    """The dataset and local row of global row numbers, by ranges of the running sizes."""
    sizes = table(spark, folder, "annotations").filter("dataset is not null").groupBy("dataset").agg(F.count("*").alias("n"))
    ends = sizes.withColumn("end", F.sum("n").over(W.orderBy("dataset").rowsBetween(W.unboundedPreceding, 0)))  # one row per dataset
    hit = wanted.join(small(ends), (F.col("row") >= F.col("end") - F.col("n")) & (F.col("row") < F.col("end")))
    return hit.select("row", "dataset", (F.col("row") - (F.col("end") - F.col("n"))).alias("local_row"))


def j10_range_lookup(spark, folder):
    """The data set and row in it of every global row number."""
    return _range_lookup(spark, folder, table(spark, folder, "images").selectExpr("image_id as row"))


J10 = """WITH s AS (SELECT dataset, count(*) AS n FROM annotations WHERE dataset IS NOT NULL GROUP BY dataset), e AS (SELECT *, sum(n) OVER (ORDER BY dataset) AS hi FROM s)
SELECT image_id AS row, dataset, (image_id - (hi - n))::BIGINT AS local_row FROM images JOIN e ON image_id >= hi - n AND image_id < hi"""


def j11_grouped_fetch(spark, folder):
    """Requests of (order, line) answered once per distinct request, then given back to every request in its order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    requests = lines.selectExpr("l_orderkey as o", "least(l_linenumber, 3) as frame")
    answers = lines.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    once = requests.distinct().join(answers, (F.col("o") == F.col("l_orderkey")) & (F.col("frame") == F.col("l_linenumber"))).select("o", "frame", "q")
    return requests.join(once, ["o", "frame"]).groupBy("o").agg(F.count("*").alias("answered"), F.round(F.sum("q"), 2).alias("q"))


J11 = """WITH a AS (SELECT l_orderkey AS o, l_linenumber AS frame, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL)
SELECT o, count(*) AS answered, round(sum(q), 2) AS q FROM (SELECT l_orderkey AS o, least(l_linenumber, 3) AS frame FROM lineitem) JOIN a USING (o, frame) GROUP BY o"""


def u1_first_writer_wins(spark, folder):
    """Rows of two sources in one, the earlier source's row counting where both have a key."""
    m = table(spark, folder, "manifest")
    both = m.filter("split = 'train'").withColumn("source_no", F.lit(0)).unionByName(m.withColumn("source_no", F.lit(1)))
    return both.groupBy("sample_id").agg(F.min_by("split", F.struct("source_no", F.coalesce("split", F.lit("~")))).alias("split"))


U1 = "SELECT sample_id, arg_min(coalesce(split, '\x01'), (n, coalesce(split, '~'))) AS s FROM (SELECT sample_id, split, 0 AS n FROM manifest WHERE split = 'train' UNION ALL SELECT sample_id, split, 1 FROM manifest) GROUP BY sample_id"
U1 = f"SELECT sample_id, nullif(s, '\x01') AS split FROM ({U1})"


def u2_ordered_distinct(spark, folder):
    return table(spark, folder, "annotations").filter("image_list is not null").select("record_id", F.array_distinct(F.concat("image_list", F.reverse("image_list"))).alias("images")).distinct()


U2 = "SELECT DISTINCT record_id, list_filter(image_list, lambda x, i: list_position(image_list, x) = i) AS images FROM annotations WHERE image_list IS NOT NULL"


def u3_last_wins(spark, folder):
    """The last delivery of each record."""
    return table(spark, folder, "annotations").groupBy("record_id").agg(F.max("ingested_at").alias("ingested_at"), F.count("*").alias("deliveries"))


U3 = "SELECT record_id, max(ingested_at) AS ingested_at, count(*) AS deliveries FROM annotations GROUP BY record_id"

_SQL = {
    "g1_norm_to_abs": G1, "g2_unscale": G2, "g3_norm_to_pixel": G3, "g4_to_norm1000": G4, "g7_iou_crowd": G7, "g11_size_bucket": G11, "g12_gt_count_bucket": G12, "g13_point_in_box": G13, "g15_box_center": G15, "g16_crop_box": G16, "g17_resize": G17,
    "g18_patch_grid": G18, "g19_frame_indices": G19, "g20_pixel_cap": G20, "g21_oks": G21, "a5_keypoint_ap": A5, "m4_best_oks": M4, "g22_coarse_box": G22, "g23_ring_target": G23, "g24_safe_f1": G24, "g25_stable_fraction": G25, "f6_train_val_split": F6,
    "f5_negative_downsample": F5, "f7_skip_names": F7, "f1_score_threshold": F1, "f10_wrong_rejection": F10, "f4_max_tokens": F4, "log_p24_kv_parse": P24, "a21_log_stats": A21, "a25_throughput": A25, "a22_prep_stats": A22, "a23_run_summary": A23, "a18_positive_mean": A18,
    "j1_equi_lookup": J1, "j2_left_join_fallback": J2, "j5_resume_anti_join": J5, "j7_category_intersection": J7, "j8_threshold_grid": J8, "j9_asof_lookup": J9, "j10_range_lookup": J10, "j11_grouped_fetch": J11, "u1_first_writer_wins": U1, "u2_ordered_distinct": U2, "u3_last_wins": U3,
}
QUERIES = {name: globals()[{"log_p24_kv_parse": "p24_kv_log_parse"}.get(name, name)] for name in _SQL} | {"g25_digest_fraction": g25_digest_fraction}
SQL = dict(_SQL)
