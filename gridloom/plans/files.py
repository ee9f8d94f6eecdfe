"""Queries of file formats, masks and streams, over lines and documents made from the tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import masks as R
from gridloom.operators.layout import shared_folder
from gridloom.plans.boxes import BOXES, boxes, gt_boxes
from gridloom.plans.samples import C12, DOCS, _workers
from gridloom.sources import files as S
from gridloom.sources.tables import table
from gridloom.streaming import packer


def s2_jsonl_lines(spark, folder):
    """JSON objects of the exported lines, each either a record or rejected."""
    raw = table(spark, folder, "raw_annotations").filter("layout = 'jsonl'").select("line_id", "raw")
    rows = S.parsed_lines(raw, "record_key string, image string", "raw")
    return rows.select("line_id", F.col("_corrupt").isNull().alias("parsed"))


def _dets(spark, folder) -> DataFrame:
    return boxes(spark, folder)[1].select("image_id", F.col("ord").cast("int").alias("ord"), F.col("cat").alias("class"), F.col("score").alias("conf"), F.expr("array(x1, y1, x2 - x1, y2 - y1)").alias("rect"))


def s8_scan_det_tsv(spark, folder):
    """Detections written as lines and read again, class A being unknown."""
    categories = spark.createDataFrame([(1, "R"), (2, "N")], "id int, name string")
    rows = S.parse_det_tsv(S.det_tsv_lines(_dets(spark, folder)), categories, at_least=0.3)
    return rows.select("image_id", "category_id", F.col("bbox")[2].alias("width"), "score")


S8 = f"WITH {BOXES} SELECT image_id, CASE cat WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 0 END::INT AS category_id, x2 - x1 AS width, score FROM pred WHERE score >= 0.3"


def k2_det_tsv(spark, folder):
    """Lines per image and the detections on them."""
    return S.det_tsv_lines(_dets(spark, folder)).select("image_id", (F.size(F.split("value", '"class"')) - 1).alias("detections"))


K2 = f"WITH {BOXES} SELECT image_id, count(*)::INT AS detections FROM pred GROUP BY image_id"


def s5_coco_gt(spark, folder):
    """COCO documents of one image each, taken apart into annotations."""
    item = F.struct(F.col("ord").cast("bigint").alias("id"), "image_id", F.expr("case cat when 'R' then 1 when 'N' then 2 else 3 end").alias("category_id"), F.expr("array(x1, y1, x2 - x1, y2 - y1)").alias("bbox"), F.expr("(x2 - x1) * (y2 - y1)").alias("area"), F.expr("if(crowd, 1, null)").alias("iscrowd"))
    image = F.struct(F.col("image_id").alias("id"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(None).cast("array<int>").alias("neg_category_ids"), F.lit(None).cast("array<int>").alias("not_exhaustive_category_ids"))
    documents = gt_boxes(spark, folder).groupBy("image_id").agg(F.collect_list(item).alias("annotations")).select(F.array(image).alias("images"), "annotations", F.array(F.struct(F.lit(1).alias("id"), F.lit("R").alias("name"), F.lit("r").alias("frequency"))).alias("categories"))
    read = documents.select(F.from_json(F.to_json(F.struct("images", "annotations", "categories")), S.COCO).alias("d")).select("d.*")
    annotations = S.coco_tables(read)[1]
    return annotations.groupBy("category_id").agg(F.count("*").alias("n"), F.count_if("ignore").alias("ignored"), F.round(F.sum("area"), 2).alias("area"))


S5 = f"WITH {BOXES} SELECT CASE cat WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::INT AS category_id, count(*) AS n, count(*) FILTER (crowd) AS ignored, round(sum((x2 - x1) * (y2 - y1)), 2) AS area FROM gt GROUP BY ALL"


def s6_lvis_sets(spark, folder):
    """Positive and negative categories of each image."""
    gt = gt_boxes(spark, folder)
    annotations = gt.select("image_id", F.expr("case cat when 'R' then 1 when 'N' then 2 else 3 end").alias("category_id"))
    images = gt.select(F.col("image_id").alias("id")).distinct().withColumn("neg_category_ids", F.expr("if(id % 3 = 0, array(9), null)")).withColumn("not_exhaustive_category_ids", F.expr("cast(null as array<int>)"))
    return S.lvis_sets(images, annotations).select("image_id", "positive", F.size("negative").alias("negatives"))


S6 = f"WITH {BOXES} SELECT image_id, list_sort(list(DISTINCT CASE cat WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)) AS positive, CASE WHEN image_id % 3 = 0 THEN 1 ELSE 0 END::INT AS negatives FROM gt GROUP BY image_id"


def s12_shard_order(spark, folder):
    """Order of file names by their first pair of numbers."""
    names = table(spark, folder, "raw_annotations").select("file_name").distinct()
    pair = S.shard_key(F.concat(F.regexp_extract("file_name", r"^([^.]*)", 1), F.lit("_"), F.length("file_name").cast("string")))
    return names.select("file_name", pair["last"].alias("last"), pair["a"].alias("a"), pair["b"].alias("b"))


S12 = r"""WITH n AS (SELECT DISTINCT file_name, regexp_extract(file_name, '^([^.]*)', 1) || '_' || length(file_name) AS x FROM raw_annotations)
SELECT file_name, NOT regexp_matches(x, '(\d+)_(\d+)') AS last, try_cast(nullif(regexp_extract(x, '(\d+)_(\d+)', 1), '') AS BIGINT) AS a, try_cast(nullif(regexp_extract(x, '(\d+)_(\d+)', 2), '') AS BIGINT) AS b FROM n"""

SIDE = 512


def _masks(spark, folder) -> DataFrame:
    gt, pred = boxes(spark, folder)
    pairs = gt.alias("g").join(pred.alias("p"), (F.col("g.image_id") == F.col("p.image_id")) & (F.col("g.ord") == F.col("p.ord")))
    half = lambda s: [F.floor(F.col(f"{s}.{c}") / 2) for c in ("x1", "y1", "x2", "y2")]
    return pairs.select("g.image_id", "g.ord", R.box_to_rle(*half("g"), SIDE, SIDE).alias("a"), R.box_to_rle(*half("p"), SIDE, SIDE).alias("b"), F.col("g.crowd").alias("crowd"), *[h.alias(f"g{c}") for h, c in zip(half("g"), ("x1", "y1", "x2", "y2"))], *[h.alias(f"p{c}") for h, c in zip(half("p"), ("x1", "y1", "x2", "y2"))])


_HALF = f"WITH {BOXES}, h AS (SELECT image_id, ord, g.crowd, " + ", ".join(f"floor({s}.{c} / 2) AS {s}{c}" for s in "gp" for c in ("x1", "y1", "x2", "y2")) + " FROM gt g JOIN pred p USING (image_id, ord)), i AS (SELECT *, greatest(least(gx2, px2) - greatest(gx1, px1), 0) * greatest(least(gy2, py2) - greatest(gy1, py1), 0) AS s, (gx2 - gx1) * (gy2 - gy1) AS ga, (px2 - px1) * (py2 - py1) AS pa FROM h) "


def g9_iou_rle(spark, folder):
    """Overlap of the boxes as masks; over the first area where the other is a crowd."""
    return _masks(spark, folder).select("image_id", "ord", F.round(R.iou_rle(F.col("b"), F.col("a"), F.col("crowd")), 9).alias("iou"))


G9 = _HALF + "SELECT image_id, ord, round(s / CASE WHEN crowd THEN pa ELSE ga + pa - s END, 9) AS iou FROM i"


def g10_rle_area(spark, folder):
    return _masks(spark, folder).select("image_id", "ord", R.rle_area(F.col("a")).alias("pixels"))


G10 = _HALF + "SELECT image_id, ord, ga::BIGINT AS pixels FROM i"


def g14_point_in_mask(spark, folder):
    return _masks(spark, folder).select("image_id", "ord", R.mask_holds_point(F.col("a"), F.lit(100.5), F.lit(90.2), SIDE, SIDE).alias("inside"))


G14 = _HALF + "SELECT image_id, ord, 100 >= gx1 AND 100 < gx2 AND 90 >= gy1 AND 90 < gy2 AS inside FROM i"


def g8_iou_polygon(spark, folder):
    """Overlap of the boxes as polygons."""
    corners = lambda s: F.expr(f"array({s}x1, {s}y1, {s}x2, {s}y1, {s}x2, {s}y2, {s}x1, {s}y2)").cast("array<double>")
    return _masks(spark, folder).select("image_id", "ord", F.round(R.iou_polygon(corners("g"), corners("p")), 6).alias("iou"))


G8 = _HALF + "SELECT image_id, ord, round(s / (ga + pa - s), 6) AS iou FROM i"


def a3_poly_pr(spark, folder):
    """Share of polygons that overlap their prediction by at least 0.5, per image."""
    return g8_iou_polygon(spark, folder).groupBy("image_id").agg(F.round(F.avg((F.col("iou") >= 0.5).cast("int")), 9).alias("recall"))


A3 = f"SELECT image_id, round(avg((iou >= 0.5)::INT), 9) AS recall FROM ({G8}) GROUP BY image_id"


def st4_windowed_stats(spark, folder):
    """Daily statistics of the events by type."""
    return packer.windowed_stats(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))


ST4 = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY ALL"
ST4 = ST4.replace("date_trunc('day', ts) AS start", "date_trunc('day', ts)::TIMESTAMP AS start")


def st_sessions(spark, folder):
    return packer.sessions(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


SESSIONS = "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS n FROM events) SELECT user_id, count(*) FILTER (n) AS sessions, count(*) AS events FROM g GROUP BY user_id"


def run_stream(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now, into files of the shared folder, and gives its result."""
    context = spark.sparkContext
    out = f"{shared_folder(context)}/{name}-{context._jvm.java.util.UUID.randomUUID()}"
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def st1_packed_stream(spark, folder):
    """Documents packed as a stream: the same batches as in a single run."""
    schema = table(spark, folder, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder.rstrip('/')}/documents*.parquet")
    rows = stream.select(F.expr("concat(coalesce(source, 'none'), '-', doc_id % 64)").alias("worker"), "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return run_stream(spark, packer.pack_stream(rows, 2048), "packed")


def st2_resume_state(spark, folder):
    """The state of each worker after all documents are packed."""
    from gridloom.plans.samples import c12_pack_stream

    return packer.resume_state(c12_pack_stream(spark, folder), _workers(spark, folder))


ST2 = f"SELECT worker, batch, sum(n)::BIGINT AS used FROM ({C12}) JOIN (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents) USING (doc_id) GROUP BY worker, batch QUALIFY batch = max(batch) OVER (PARTITION BY worker)"


def st3_pending(spark, folder):
    """Documents that were not packed: those over the limit."""
    from gridloom.plans.samples import c12_pack_stream

    return packer.pending(_workers(spark, folder), c12_pack_stream(spark, folder), "doc_id").select("doc_id", "n")


ST3 = f"WITH {DOCS} SELECT doc_id, n FROM d WHERE n > 2048"

_SQL = {
    "s8_scan_det_tsv": S8, "k2_det_tsv": K2, "s5_coco_gt": S5, "s6_lvis_sets": S6, "s12_shard_order": S12, "g9_iou_rle": G9, "g10_rle_area": G10, "g14_point_in_mask": G14, "g8_iou_polygon": G8, "a3_poly_pr": A3,
    "st4_windowed_stats": ST4, "st_sessions": SESSIONS, "st1_packed_stream": C12, "st2_resume_state": ST2, "st3_pending": ST3,
}
QUERIES = {name: globals()[name] for name in _SQL} | {"s2_jsonl_lines": s2_jsonl_lines}
SQL = dict(_SQL)
