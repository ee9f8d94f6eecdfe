import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.sources import files as S


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    good = json.dumps({"conversations": [{"from": "human", "value": "é"}], "image": "a.png"}, ensure_ascii=False)
    one, two = put(tmp_path / "a.jsonl", f"{good}\n\n  \n{good}\n"), put(tmp_path / "b.jsonl", f"{good}\n{{bad\n[1]\n")
    with pytest.warns(UserWarning, match="missing"):
        rows = S.scan_jsonl(spark, [one, str(tmp_path / "gone.jsonl")])
    assert [r.conversations[0].value for r in rows.collect()] == ["é", "é"]
    rows, rejected = S.scan_jsonl_tolerant(spark, [one, two])
    assert rows.count() == 3 and rejected.count() == 2
    with pytest.raises(Exception, match="malformed line"):
        S.scan_jsonl(spark, [two]).collect()
    with pytest.warns(UserWarning):
        assert S.scan_jsonl(spark, [str(tmp_path / "gone.jsonl")]).count() == 0


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "标出", None)], "image string, human string, gpt string")
    S.write_jsonl(rows, str(tmp_path / "out"))
    back = spark.read.schema(rows.schema).json(str(tmp_path / "out"))
    assert back.collect() == rows.collect()
    assert "标出" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))


def test_recipe(spark, tmp_path):
    recipe = S.scan_recipe(spark, put(tmp_path / "r.json", json.dumps({"a": {"annotation": "x.jsonl", "repeat_time": 2}, "b": {"annotation": []}, "c": {"annotation": ["y", "z"], "root": "r"}})))
    assert {r.dataset: (r.annotation, r.repeat_time, r.root) for r in recipe.collect()} == {"a": (["x.jsonl"], 2.0, ""), "c": (["y", "z"], 1.0, "r")}
    S.write_recipe(recipe, str(tmp_path / "w.json"))
    assert sorted(map(str, S.scan_recipe(spark, str(tmp_path / "w.json")).collect())) == sorted(map(str, recipe.collect()))
    with pytest.raises(ValueError):
        S.scan_recipe(spark, put(tmp_path / "e.json", "{}"))


def test_coco_and_lvis(spark, tmp_path):
    document = {"images": [{"id": 1, "width": 5, "height": 6, "neg_category_ids": [7]}, {"id": 2}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [0, 0, 2, 2], "area": 4, "iscrowd": 1}, {"id": 2, "image_id": 1, "category_id": 4, "bbox": [0, 0, 1, 1], "area": 1}], "categories": [{"id": 3, "name": "x", "frequency": "r"}]}
    images, annotations, categories = S.scan_coco_gt(spark, put(tmp_path / "gt.json", json.dumps(document)))
    assert {r.id: (r.iscrowd, r.ignore) for r in annotations.collect()} == {1: (1, True), 2: (0, False)} and categories.first().frequency == "r"
    sets = {r.image_id: (r.positive, r.negative) for r in S.lvis_sets(images, annotations).collect()}
    assert sets == {1: ([3, 4], [7]), 2: ([], [])}


def test_detections(spark, tmp_path):
    path = put(tmp_path / "d.json", json.dumps([{"image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1], "score": 0.5}, {"image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1], "score": 0.6}]))
    assert S.scan_det_json(spark, path).count() == 2 and S.scan_det_json(spark, path, above=0.5).count() == 1
    boxes = spark.createDataFrame([(1, 0, "cat", 0.5, [0.0, 0.0, 1.0, 2.0]), (1, 1, "dog", 0.9, [0.0, 0.0, 3.0, 2.0])], "image_id long, ord int, class string, conf double, rect array<double>")
    S.write_det_tsv(boxes, str(tmp_path / "tsv"))
    names = spark.createDataFrame([(7, "cat")], "id int, name string")
    back = S.parse_det_tsv(spark.read.text(str(tmp_path / "tsv")), names, at_least=0.5).orderBy("ord").collect()
    assert [(r.category_id, r.score) for r in back] == [(7, 0.5), (0, 0.9)]
    assert S.parse_det_tsv(spark.read.text(str(tmp_path / "tsv")), names, at_least=0.5, strict=True).count() == 1


def test_detection_lists_stay_short(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id % 4000 as image_id", "1 as category_id", "array(0D, 0D, 1D, 1D) as bbox", "id / 20000D as score")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        S.write_det_json(rows, str(tmp_path / "plain"))
        S.write_det_json(rows, str(tmp_path / "gz"), compression="gzip")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lists = [json.loads(p.read_text()) for p in (tmp_path / "plain").rglob("*.txt")]
    assert sum(map(len, lists)) == 20_000 and max(map(len, lists)) < 500  # it was a sixteenth of all, whatever the input
    assert len({(d["image_id"], i) for i, ds in enumerate(lists) for d in ds}) == 4000
    want = sorted(r.score for r in rows.collect())
    for name in ("plain", "gz"):
        assert sorted(r.score for r in S.scan_det_json(spark, str(tmp_path / name)).collect()) == want


def test_shards(spark, tmp_path):
    for name in ("p_10_2.jsonl", "p_2_10.jsonl", "p_2_9.jsonl", "other.jsonl", "x.txt"):
        put(tmp_path / name, name + "\n")
    rows = S.merge_shards(spark, str(tmp_path)).orderBy("shard").collect()
    assert [r.value for r in rows] == ["p_2_9.jsonl", "p_2_10.jsonl", "p_10_2.jsonl", "other.jsonl"]


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(30, 40))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 50, 60) + b"\x03" * 10)
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 8))
    (tmp_path / "d.webp").write_bytes(b"RIFF\x00\x00\x00\x00WEBPVP8X" + b"\x00" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))
    (tmp_path / "e.bin").write_bytes(b"nothing")
    got = {r.path[-5:]: (r.width, r.height) for r in S.scan_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (30, 40), "b.jpg": (60, 50), "c.gif": (7, 8), ".webp": (100, 50), "e.bin": (None, None)}


def test_keyframes(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"xx" + struct.pack(">I", 28) + b"stss" + b"\0" * 4 + struct.pack(">IIII", 3, 1, 31, 61))
    assert S.scan_keyframes(spark, str(tmp_path)).first().keyframes == [0, 30, 60] and S.keyframes(b"") == []


def test_partitioned_and_document(spark, tmp_path):
    df = spark.createDataFrame([("t", "ok", 1), ("t", "bad", 2)], "task string, status string, n int")
    S.write_partitioned(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).filter(F.col("status") == "bad").first().n == 2
    S.write_document({"é": 1}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text(encoding="utf-8")) == {"é": 1} and len(list(tmp_path.glob("m.json*"))) == 1


def test_log(spark, tmp_path):
    assert S.scan_log(spark, put(tmp_path / "l.txt", "a\nb\n")).count() == 2
