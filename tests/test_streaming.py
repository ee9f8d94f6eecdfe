from datetime import datetime, timedelta

from gridloom.operators.batches import buffered_best_fit, heap_bins, length_groups, next_fit
from gridloom.plans.files import run_stream
from gridloom.streaming.packer import pack_stream, pending, resume_state, windowed_stats

SAMPLE = "worker string, doc_id long, n long"


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = [("w", i, (i * 37) % 90 + 1) for i in range(60)] + [("v", i, 50) for i in range(100, 110)] + [("w", 500, 1000)]
    for k in range(3):
        part = [r for r in rows if r[1] // 20 == k or k == 2 and r[1] >= 60]
        spark.createDataFrame(part, SAMPLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SAMPLE).parquet(str(tmp_path / "in"))
    got = {(r.worker, r.doc_id): r.batch for r in run_stream(spark, pack_stream(stream, 100), "t").collect()}
    df = spark.createDataFrame(rows, SAMPLE)
    want = {(r.worker, r.doc_id): r.batch for r in next_fit(df, ["worker"], "doc_id", "n", 100).collect()}
    assert got == want and ("w", 500) not in got
    packed = next_fit(df, ["worker"], "doc_id", "n", 100)
    state = {r.worker: (r.batch, r.used) for r in resume_state(packed, df).collect()}
    assert state["v"] == (4, 100)
    assert [r.doc_id for r in pending(df, packed, "doc_id").collect()] == [500]


def test_windows_of_a_stream(spark, tmp_path):
    start = datetime(2031, 1, 1)
    rows = [(i, start + timedelta(hours=7 * i), "a", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_stats(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="1 hour")
    query = stream.writeStream.format("memory").outputMode("complete").queryName("stats").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("stats").collect()) == sorted(windowed_stats(df).collect())


def test_bins():
    lengths = [60, 50, 40, 30, 20, 10, 120]
    bins = heap_bins(lengths, 100)
    assert bins[6] == -1 and all(sum(n for n, b in zip(lengths, bins) if b == x) <= 100 for x in set(bins) - {-1})
    batches = buffered_best_fit(lengths[:6], 100, 3)
    assert all(sum(n for n, b in zip(lengths, batches) if b == x) <= 100 for x in batches) and -1 not in batches
    assert buffered_best_fit([60, 70, 40], 100, 1) == [0, 1, 2]
    groups = length_groups([9, 8, 7, 6, 5, 4, 3, 2], 2, 4)
    assert groups.count(0) == groups.count(1) == 4
    assert sorted(set(length_groups([1, 2, 3], 2, 4))) == [0, 1]
