"""Readers and writers together: tables written to files of the shared folder and read again, against SQL over the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.operators.layout import shared_folder
from gridloom.plans.boxes import BOXES, gt_boxes, pred_boxes
from gridloom.sources import files as S
from gridloom.sources.tables import table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark.sparkContext).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _records(spark, folder):
    turns = F.transform("conversations", lambda t: F.struct(t["speaker"].alias("from"), t["value"].alias("value")))
    return table(spark, folder, "annotations").select(turns.alias("conversations"), "image", "image_list", "defect_type")


def k1_sink_jsonl(spark, folder):
    """Records by label and number of turns, after they were written as JSON lines."""
    path = _place(spark, "records")
    S.write_jsonl(_records(spark, folder), path)
    rows = S.scan_jsonl(spark, [path])
    return rows.groupBy("defect_type", F.size("conversations").alias("turns")).agg(F.count("*").alias("n"), F.count("image").alias("images"), F.sum(F.size("image_list")).alias("listed"))


K1 = "SELECT defect_type, len(conversations)::INT AS turns, count(*) AS n, count(image) AS images, sum(len(image_list))::BIGINT AS listed FROM annotations GROUP BY ALL"


def s1_scan_jsonl(spark, folder):
    """Records of files of which some do not exist: those are warned about and skipped."""
    path = _place(spark, "records")
    S.write_jsonl(_records(spark, folder).filter("defect_type is not null"), path)
    return S.scan_jsonl(spark, [path, f"{path}-gone"]).groupBy("defect_type").agg(F.count("*").alias("n"))


S1 = "SELECT defect_type, count(*) AS n FROM annotations WHERE defect_type IS NOT NULL GROUP BY ALL"


def s3_scan_jsonl_strict(spark, folder):
    """Manifest rows as JSON lines with their own fields, read strictly: a malformed line would raise."""
    path = _place(spark, "manifest")
    S.write_jsonl(table(spark, folder, "manifest").select("sample_id", "task", "kind"), path)
    return S.scan_jsonl(spark, [path], "sample_id long, task string, kind string").groupBy("task", "kind").agg(F.count("*").alias("n"), F.max("sample_id").alias("last"))


S3 = "SELECT task, kind, count(*) AS n, max(sample_id) AS last FROM manifest GROUP BY ALL"


def s4_scan_recipe(spark, folder):
    """The recipe written as a document and read again."""
    path = _place(spark, "recipe") + ".json"
    S.write_recipe(table(spark, folder, "recipe").select("dataset", "annotation", "root", "repeat_time", "data_augment", "visual_prompt"), path)
    return S.scan_recipe(spark, path).select("dataset", F.size("annotation").alias("files"), "root", "repeat_time", "data_augment", "visual_prompt")


S4 = """SELECT dataset, len(annotation)::INT AS files, coalesce(root, '') AS root, coalesce(repeat_time, 1) AS repeat_time, coalesce(data_augment, false) AS data_augment, coalesce(visual_prompt, false) AS visual_prompt
FROM recipe WHERE len(annotation) > 0"""


def s7_scan_det_json(spark, folder):
    """Detections written as JSON lists and read with a threshold, counted by category."""
    pred = pred_boxes(gt_boxes(spark, folder, part=S.detection_list(spark, F.col("l_orderkey"))), "part")
    path = _place(spark, "detections")
    rows = pred.select("part", "image_id", F.expr("case cat when 'R' then 1 when 'N' then 2 else 3 end").alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), "score")
    S.write_det_json(rows, path, compression="gzip", by="part")
    return S.scan_det_json(spark, path, 0.3).groupBy("category_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("bbox")[2]), 3).alias("width"))


S7 = f"WITH {BOXES} SELECT CASE cat WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::INT AS category_id, count(*) AS n, round(sum(x2 - x1), 3) AS width FROM pred WHERE score > 0.3 GROUP BY ALL"


def s9_scan_log(spark, folder):
    """Log lines of events, written as text and read again, by their first word."""
    path = _place(spark, "log")
    table(spark, folder, "events").select(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value")).write.text(path)
    return S.scan_log(spark, path).groupBy(F.split("value", " ")[0].alias("word")).agg(F.count("*").alias("n"))


S9 = "SELECT event_type AS word, count(*) AS n FROM events GROUP BY ALL"

_PNG = "89504E470D0A1A0A0000000D49484452"


def s10_scan_image(spark, folder):
    """Sizes and digests of image headers made from the table of images."""
    rows = table(spark, folder, "images").filter("image_id is not null and width > 0 and height > 0")
    hexed = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 8, "0")
    return S.image_columns(rows.select(F.col("image_id").alias("path"), F.unhex(F.concat(F.lit(_PNG), hexed("width"), hexed("height"))).alias("content")))


S10 = f"SELECT image_id AS path, width, height, sha256(from_hex('{_PNG}' || printf('%08X%08X', width, height))) AS sha256 FROM images WHERE image_id IS NOT NULL AND width > 0 AND height > 0"


def s14_scan_keyframes(spark, folder):
    """Sync samples of made video files: one in ten frames, as many as the image's number says."""
    rows = table(spark, folder, "images").filter("image_id is not null")
    count = F.pmod(F.col("image_id"), F.lit(5)).cast("int")
    samples = F.array_join(F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.lpad(F.hex((i * 10 + 1).cast("long")), 8, "0"))).otherwise(F.array().cast("array<string>")), "")
    content = F.unhex(F.concat(F.lit("00000000"), F.lit("7374737300000000"), F.lpad(F.hex(count.cast("long")), 8, "0"), samples))
    found = S.keyframe_columns(rows.select(F.col("image_id").alias("path"), content.alias("content")))
    return found.select("path", F.array_join(F.col("keyframes").cast("array<string>"), " ").alias("keyframes"))


S14 = "SELECT image_id AS path, array_to_string(list_transform(range(1, image_id % 5 + 1), lambda i: i * 10), ' ') AS keyframes FROM images WHERE image_id IS NOT NULL"


def k3_sink_atomic_json(spark, folder):
    """A summary written as one document and read again."""
    path = _place(spark, "summary") + ".json"
    row = table(spark, folder, "documents").agg(F.count("*").alias("documents"), F.count("text").alias("texts"), F.count_distinct("lang").alias("languages")).first()
    S.write_document(row.asDict(), path, spark)
    return spark.read.schema("documents long, texts long, languages long").json(path, multiLine=True)


K3 = "SELECT count(*) AS documents, count(text) AS texts, count(DISTINCT lang) AS languages FROM documents"


def k4_sink_partitioned(spark, folder):
    """The manifest in folders by task and kind, read again with these as columns."""
    path = _place(spark, "results")
    S.write_partitioned(table(spark, folder, "manifest").select("sample_id", "source", "task", "kind"), path, ("task", "kind"))
    return spark.read.option("inferSchema", "false").schema("sample_id long, source string, task string, kind string").json(path).groupBy("task", "kind").agg(F.count("*").alias("n"), F.count("source").alias("sources"))


K4 = "SELECT nullif(task, '') AS task, nullif(kind, '') AS kind, count(*) AS n, count(source) AS sources FROM manifest GROUP BY ALL"

_NAMES = {"k1_sink_jsonl": K1, "s1_scan_jsonl": S1, "s3_scan_jsonl_strict": S3, "s4_scan_recipe": S4, "k5_sink_recipe": S4, "s7_scan_det_json": S7, "s9_scan_log": S9, "s10_scan_image": S10, "g26_sha256_file": S10, "s14_scan_keyframes": S14, "k3_sink_atomic_json": K3, "k4_sink_partitioned": K4}
k5_sink_recipe, g26_sha256_file = s4_scan_recipe, s10_scan_image
QUERIES = {name: globals()[name] for name in _NAMES}
SQL = dict(_NAMES)
