from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.draws import positions
from gridloom.llm.proportions import largest_remainder, proportional_sample, quotas

CATEGORY = st.tuples(st.integers(0, 10), st.integers(0, 8), st.integers(0, 30))


@settings(max_examples=300, deadline=None)
@given(st.lists(CATEGORY, min_size=1, max_size=8), st.integers(0, 120))
def test_quotas_keep_the_bounds(rows, total):
    shares, floors, available = (list(x) for x in zip(*rows))
    got = quotas(total, shares, floors, available)
    low = [min(f, a) for f, a in zip(floors, available)]
    assert sum(got) == min(total, sum(available)) and all(0 <= q <= a for q, a in zip(got, available))
    if sum(low) <= sum(got):
        assert all(q >= f for q, f in zip(got, low))


def test_quotas():
    assert largest_remainder(10, [1, 1, 1]) == [4, 3, 3] and largest_remainder(5, [0, 0]) == [0, 0]
    assert quotas(100, [0.5, 0.3, 0.2], [0, 0, 40], [1000, 1000, 1000]) == [38, 22, 40]
    assert quotas(100, [0.5, 0.5], [0, 0], [10, 1000]) == [10, 90]
    assert quotas(10, [1, 1], [30, 10], [50, 50]) == [8, 2]


def test_a_small_minimum_is_not_lost_to_larger_ones():
    got = quotas(50, [0.1, 0.1, 0.8, 0.1], [1, 1, 400, 300], [700, 60, 500, 500])
    assert sum(got) == 50 and got[0] == got[1] == 1
    assert quotas(2, [1, 1, 1], [5, 5, 1], [9, 9, 9]) in ([1, 1, 0], [1, 0, 1], [0, 1, 1])


def test_positions_against_sorting(spark):
    rows = [(i, i % 2, i % 7) for i in range(500)]
    got = positions(spark.createDataFrame(rows, "id long, g long, w long"), ["g"], "id", __import__("pyspark.sql.functions", fromlist=["col"]).col("w"), 3).collect()
    import hashlib

    for g in (0, 1):
        total = 0
        order = sorted((r for r in got if r.g == g), key=lambda r: (int(hashlib.sha256(f"3:{r.id}".encode()).hexdigest()[:13], 16), r.id))
        for r in order:
            assert r.position == total
            total += r.w


SCHEMA = "sample_id long, task string, expected_label string, ingested_at timestamp, quota string"


def test_sample(spark):
    rows = [(i, " UI-crop", "Big_Icon", None, "x") for i in range(400)] + [(1000 + i, "ui_crop", "rare  label", None, "x") for i in range(6)] + [(2000 + i, None, "big icon", None, "x") for i in range(50)]
    rows += [(3000, "ui_crop", "rare label", datetime(2031, 1, 1), "x"), (3000, "ui crop", "BIG ICON", datetime(2031, 1, 2), "x"), (None, "ui_crop", "big icon", None, "x")]
    targets = [("ui_crop", "big icon", 0.5, 1), ("ui_crop", "Rare-Label", 0.4, 10), ("ui_crop", "not there", 0.1, 3), (None, "big icon", 0.5, 1), ("ui_crop", "null share", None, None)]
    manifest = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(targets, "task string, expected_label string, target_share double, min_rows int")
    sample, report = proportional_sample(manifest, table)
    got = sample.collect()
    assert len(got) == len({r.sample_id for r in got}) == 46
    assert sum(r.expected_label == "Rare-Label" for r in got) == 6 and sum(r.expected_label == "big icon" for r in got) == 40
    why = {r.expected_label: r for r in report.collect()}
    assert why["Rare-Label"].reason.startswith("minimum not available") and "absent" in why["not there"].reason and why["null share"].quota == 0
    assert why["big icon"].available == 401
    again = proportional_sample(manifest.repartition(7), table)[0].collect()
    assert {r.sample_id for r in again} == {r.sample_id for r in got}
    sample, report = proportional_sample(manifest.filter("false"), table)
    assert sample.count() == 0 and report.count() == 4
    assert proportional_sample(manifest, table.filter("false"))[0].count() == 0
