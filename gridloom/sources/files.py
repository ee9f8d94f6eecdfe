"""Readers and writers of annotation, recipe, detection, log and image files."""

from __future__ import annotations

import json
import struct
import uuid
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.layout import bounded, small

TURNS = "array<struct<`from`:string,value:string>>"
SAMPLE = f"conversations {TURNS}, image string, image_list array<string>, defect_type string"


def _there(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist; the others are warned about."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs.Path, []
    for path in paths:
        p = hadoop(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            found.append(path)
        else:
            warnings.warn(f"{path} is missing and skipped", stacklevel=3)
    return found


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, value): the non-blank lines of the files that exist."""
    found = _there(spark, paths)
    if not found:
        return spark.createDataFrame([], "file string, value string")
    return spark.read.text(found).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")


def parsed_lines(rows: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Adds the fields of a JSON object and _corrupt, the line itself where it is none."""
    field = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.withColumn("_json", field).select(*rows.columns, "_json.*")


def scan_jsonl_tolerant(spark: SparkSession, paths: list[str], schema: str = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines)"""
    rows = parsed_lines(lines(spark, paths), schema)
    return rows.filter("_corrupt is null").drop("_corrupt", "value"), rows.filter("_corrupt is not null").select("file", "value")


def scan_jsonl(spark: SparkSession, paths: list[str], schema: str = SAMPLE) -> DataFrame:
    """Records of the files that exist; a malformed line raises when it is read, naming its file."""
    rows = parsed_lines(lines(spark, paths), schema)
    stop = F.raise_error(F.concat(F.lit("malformed line in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80))).cast("boolean")
    return rows.filter(F.when(F.col("_corrupt").isNotNull(), stop).otherwise(True)).drop("_corrupt", "value")


def scan_recipe(spark: SparkSession, path: str) -> DataFrame:
    """One row per data set of a recipe with a list of its files; data sets without files are dropped, none left is an error."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for name, entry in json.loads(text).items():
        files = entry.get("annotation") or []
        files = [files] if isinstance(files, str) else list(files)
        if files:
            rows.append((name, files, entry.get("root") or "", float(entry.get("repeat_time", 1)), bool(entry.get("data_augment", False)), bool(entry.get("visual_prompt", False))))
    if not rows:
        raise ValueError(f"{path} names no data set with files")
    return spark.createDataFrame(rows, "dataset string, annotation array<string>, root string, repeat_time double, data_augment boolean, visual_prompt boolean")


COCO = (
    "images array<struct<id:bigint,width:int,height:int,neg_category_ids:array<int>,not_exhaustive_category_ids:array<int>>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:int,name:string,frequency:string>>"
)


def coco_tables(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of rows with a COCO or LVIS document in columns; iscrowd is 0 where it is missing and also means ignored."""
    one = lambda c: document.select(F.explode(c).alias("r")).select("r.*")
    annotations = one("annotations").withColumn("iscrowd", F.coalesce("iscrowd", F.lit(0))).withColumn("ignore", F.col("iscrowd") == 1)
    return one("images"), annotations, one("categories")


def scan_coco_gt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return coco_tables(spark.read.schema(COCO).json(path, multiLine=True))


def lvis_sets(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per image its positive, negative and not exhaustively annotated categories."""
    positive = annotations.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_set("category_id")).alias("positive"))
    empty = F.array().cast("array<int>")
    return images.join(positive, "id", "left").select(F.col("id").alias("image_id"), F.coalesce("positive", empty).alias("positive"), F.coalesce("neg_category_ids", empty).alias("negative"), F.coalesce("not_exhaustive_category_ids", empty).alias("not_exhaustive"))


DETECTION = "image_id bigint, category_id int, bbox array<double>, score double"


def scan_det_json(spark: SparkSession, path: str, above: float | None = None) -> DataFrame:
    rows = spark.read.schema(DETECTION).json(path, multiLine=True)
    return rows if above is None else rows.filter(F.col("score") > above)


def parse_det_tsv(rows: DataFrame, categories: DataFrame, column: str = "value", at_least: float = 0.0, strict: bool = False) -> DataFrame:
    """(image_id, ord, category_id, bbox, score) of lines of an image id, a tab and a JSON list; an unknown class is category 0.

    strict keeps scores above the threshold only, as for long-tailed categories.
    """
    parts = F.split(F.col(column), "\t", 2)
    items = F.from_json(parts[1], "array<struct<class:string,conf:double,rect:array<double>>>")
    boxes = rows.select(parts[0].cast("bigint").alias("image_id"), F.posexplode(items).alias("ord", "d"))
    kept = boxes.filter(F.col("d.conf") > at_least if strict else F.col("d.conf") >= at_least)
    names = categories.select(F.col("name").alias("_name"), F.col("id").cast("int").alias("_id"))
    return kept.join(small(names), F.col("d.class") == F.col("_name"), "left").select("image_id", "ord", F.coalesce("_id", F.lit(0)).alias("category_id"), F.col("d.rect").alias("bbox"), F.col("d.conf").alias("score"))


def det_tsv_lines(boxes: DataFrame) -> DataFrame:
    """(image_id, value): a line per image from rows of image_id, ord, class, conf and rect."""
    item = F.struct("ord", F.struct("class", "conf", "rect").alias("d"))
    lists = boxes.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["d"]).alias("ds"))
    return lists.select("image_id", F.concat(F.col("image_id").cast("string"), F.lit("\t"), F.to_json("ds")).alias("value"))


def shard_key(name: Column) -> Column:
    """The order of a shard file: by the first pair of numbers in its name, files without one last."""
    number = lambda g: F.nullif(F.regexp_extract(name, r"(\d+)_(\d+)", g), F.lit("")).try_cast("bigint")
    return F.struct(number(1).isNull().alias("last"), number(1).alias("a"), number(2).alias("b"), name.alias("name"))


def merge_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, value): the lines of a folder's JSONL files with the sort key of their file."""
    rows = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    return rows.select(shard_key(F.col("_metadata.file_name")).alias("shard"), "value").filter(F.trim("value") != "")


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, JPEG or WebP file."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", content[6:10])
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        if content[12:16] == b"VP8X":
            return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
        if content[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", content[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if content[12:16] == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                return None
            kind = content[at + 1]
            if kind == 0xFF:
                at += 1
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            else:
                at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def keyframes(content: bytes) -> list[int]:
    """Frame numbers, from 0, of the sync samples of an MP4 file; none if it has no such table."""
    at = content.find(b"stss")
    if at < 0 or at + 12 > len(content):
        return []
    count = int.from_bytes(content[at + 8 : at + 12], "big")
    return sorted(int.from_bytes(content[p : p + 4], "big") - 1 for p in range(at + 12, min(at + 12 + 4 * count, len(content) - 3), 4))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    return image_columns(spark.read.format("binaryFile").load(path))


def scan_keyframes(spark: SparkSession, path: str) -> DataFrame:
    return keyframe_columns(spark.read.format("binaryFile").load(path))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_det_tsv(boxes: DataFrame, path: str) -> None:
    det_tsv_lines(boxes).select("value").write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("task", "status")) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_document(document: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small JSON document put in place whole: written beside its place on any file system that Spark knows, then renamed."""
    spark = spark or SparkSession.getActiveSession()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    part, whole = hadoop(f"{path}.{uuid.uuid4().hex}"), hadoop(path)
    files = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(part)
    out.write(bytearray(json.dumps(document, ensure_ascii=False, indent=2).encode()))
    out.hsync()
    out.close()
    if not files.rename(part, whole):  # some file systems do not rename onto a file
        files.delete(whole, False)
        files.rename(part, whole)


def write_recipe(recipe: DataFrame, path: str) -> None:
    """A recipe file from its table, which is a small dimension."""
    rows = bounded(recipe.orderBy("dataset"), 100_000, "data sets")
    write_document({r.dataset: {k: v for k, v in r.asDict().items() if k != "dataset" and v is not None} for r in rows}, path, recipe.sparkSession)


def detection_list(spark: SparkSession, image: Column, shards: int = 16) -> Column:
    """The number of the list that an image's detections are written to; lists are four to a partition of a shuffle, as a reader holds a whole one."""
    parts = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    return F.pmod(F.xxhash64(image), F.lit(shards * parts))


def write_det_json(boxes: DataFrame, path: str, shards: int = 16, compression: str = "none", by: str | None = None) -> None:
    """Detections as JSON lists, from rows of image_id, category_id, bbox and score: a folder a shard, with a file for each list.

    by names a column that has detection_list already, by which boxes may be laid out, so that they are not shuffled.
    """
    number = F.col(by) if by else detection_list(boxes.sparkSession, F.col("image_id"), shards)
    lists = boxes.groupBy(number.alias("list")).agg(F.to_json(F.collect_list(F.struct("image_id", "category_id", "bbox", "score"))).alias("value"))
    rows = lists.select((F.col("list") % shards).alias("shard"), "value")
    rows.write.mode("overwrite").partitionBy("shard").option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def image_columns(files: DataFrame) -> DataFrame:
    """(path, width, height, sha256) of rows with the path and content of image files; sizes are null where the header is unknown."""

    @F.pandas_udf("struct<width:int,height:int>")
    def sizes(content: pd.Series) -> pd.DataFrame:
        found = [(image_size(c) if c is not None else None) or (None, None) for c in content]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    return files.select("path", sizes("content").alias("s"), F.sha2("content", 256).alias("sha256")).select("path", "s.width", "s.height", "sha256")


def keyframe_columns(files: DataFrame) -> DataFrame:
    """(path, keyframes) of rows with the path and content of video files."""

    @F.pandas_udf("array<int>")
    def of(content: pd.Series) -> pd.Series:
        return pd.Series([keyframes(c) if c is not None else None for c in content])

    return files.select("path", of("content").alias("keyframes"))
