import hashlib

import pytest

from gridloom.llm.overlap import EMPTY_DIGEST, capture_text, coverage_of, covered, cross_split_pairs, digest_text, fold, found_pairs, merged, overlap_report, passages

HEX = hashlib.sha256(b"x").hexdigest()
APPS = {fold(k): fold(k) for k in ("harrémo-planner", "vevali-studio")}


@pytest.mark.parametrize(
    "spelling",
    [HEX, HEX.upper(), f"sha256:{HEX}", f"0x{HEX}", f" {HEX}\n", "-".join(HEX[i : i + 8] for i in range(0, 64, 8)).upper(), "sha256-" + __import__("base64").b64encode(bytes.fromhex(HEX)).decode()],
)
def test_digest_notations(spelling):
    assert digest_text(spelling) == HEX


def test_digests_of_no_file():
    for value in (None, "", " ", "n/a", "0" * 64, EMPTY_DIGEST, EMPTY_DIGEST[:20], HEX[:15], HEX + "0", "xyz" * 9):
        assert digest_text(value) is None
    assert digest_text(HEX[:16]) == HEX[:16]


@pytest.mark.parametrize(
    "path",
    [
        "shots/harrémo-planner/feed_0000012_f03.png",
        "SHOTS\\HARREMO_PLANNER\\Feed-no12-F03 - Copy.JPG",
        "file:///pool/x/harr%C3%A9mo%20planner/f__c0000012__frame-03@2x.webp?v=3",
        "img/Harrémo-Planner__feed_00012_f3 (1).jpeg",
    ],
)
def test_capture_notations(path):
    assert capture_text(path, APPS, 20) == "harremoplanner|12|3"


def test_captures_of_no_app():
    for path in (None, "", "  ", "shots/other-app/feed_0000012.png", "shots/vevali-studio/feed.png", "/"):
        assert capture_text(path, APPS, 20) is None


def test_merged_intervals_and_passages():
    assert merged([(0, 4), (2, 6), (8, 9)]) == [(0, 6), (8, 9)] and merged([(0, 4), (4, 6)]) == [(0, 6)]
    text = "d" + HEX[:20]
    assert merged([(o, o + len(p)) for o, p in passages(text)]) == [(0, len(text))]


def test_covered():
    whole, short = "d" + HEX, "d" + HEX[:40]
    hits = lambda a, b: [(o, o + len(p)) for o, p in passages(a) if b[o : o + len(p)] == p]
    for a, b in ((whole, short), (short, whole), (whole, whole)):
        assert covered(a, b, hits(b, a))
    other = "d" + HEX[:39] + ("0" if HEX[39] != "0" else "1")
    assert not covered(other, whole, hits(whole, other)) and not covered(whole, other, hits(other, whole))
    assert not covered("d" + "f" * 17 + HEX[17:], whole, [(33, 49), (49, 65)])


def test_coverage_is_merged_over_all_train_texts(spark):
    links = spark.createDataFrame([("x" * 10, "a", [(0, 4)]), ("x" * 10, "b", [(2, 6), (8, 9)]), ("y" * 4, "a", [(0, 4)])], "eval_text string, train_text string, intervals array<struct<start:int,end:int>>")
    assert {r.eval_text: r.coverage for r in coverage_of(links).collect()} == {"x" * 10: 0.7, "y" * 4: 1.0}


SCHEMA = "sample_id long, split string, source string, image string, sha256 string, captured_at timestamp, ingested_at timestamp, coverage int"


def manifest(spark, rows):
    return spark.createDataFrame([(i, s, "src", im, sha, None, None, 1) for i, s, im, sha in rows], SCHEMA)


def apps(spark):
    return spark.createDataFrame([("harrémo-planner",), ("vevali-studio",), (None,)], "app_key string")


def brute(rows):
    out = set()
    side = lambda s: (s or "").strip().lower()
    for a in rows:
        for b in rows:
            if a[0] == b[0] or side(a[1]) != "train" or side(b[1]) not in ("val", "test"):
                continue
            d, e = digest_text(a[3]), digest_text(b[3])
            c, f = capture_text(a[2], APPS, 20), capture_text(b[2], APPS, 20)
            if d and e and (d.startswith(e) or e.startswith(d)) or c and c == f:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_pairs_against_brute_force(spark):
    rows = [
        (1, "train", "shots/vevali-studio/a_1.png", HEX),
        (2, " VAL ", "shots/vevali-studio/b_0001.jpg", None),
        (3, "test", None, HEX[:16].upper()),
        (4, "Train", "shots/vevali-studio/a_1_f01.png", HEX[:40]),
        (5, "val", "shots/VevaliStudio/x-1-f1.png", HEX[:16] + "0" * 48),
        (6, None, "shots/vevali-studio/a_1.png", HEX),
        (1, "train", "shots/vevali-studio/a_1.png", HEX),
        (7, "holdout", "shots/vevali-studio/a_1.png", HEX),
        (8, "test", "", "0" * 64),
        (9, "train", "", "0" * 64),
    ]
    rows += [(100 + i, "train", "shots/harrémo-planner/hot_5.png", None) for i in range(40)]
    rows += [(200 + i, "val", "shots/harrémo-planner/hot_5.webp", None) for i in range(30)]
    pairs = cross_split_pairs(manifest(spark, rows), apps(spark), shards=8)
    got = [tuple(r) for r in found_pairs(pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    rows += [(300, "train", "shots/harrémo-planner/hot_5.png", HEX), (300, "val", "shots/harrémo-planner/hot_5.png", HEX[:20]), (300, "val", None, HEX)]
    each = cross_split_pairs(manifest(spark, rows), apps(spark), shards=8).distinct().toPandas()
    want = {(s, k): (len(set(g.eval_id)), len(g)) for (s, k), g in each.groupby(["eval_split", "kind"])}
    report = overlap_report(manifest(spark, rows), apps(spark), shards=8).collect()
    assert {(r.eval_split, r.kind): (r.eval_samples, r.pairs) for r in report} == want and all(0 < r.mean_coverage <= 1 for r in report)


def test_empty(spark):
    pairs = cross_split_pairs(manifest(spark, []), apps(spark))
    assert found_pairs(pairs).count() == 0
    assert found_pairs(cross_split_pairs(manifest(spark, [(1, "train", "a/b_1.png", None)]), apps(spark).filter("false"))).count() == 0
