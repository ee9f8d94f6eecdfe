from gridloom.operators.batches import pack_pad
from gridloom.plans import samples

FOLDER = "/root/testdata/sf0.001"


def by_hand(lengths, limit):
    """Samples are dropped from the end while the batch is overfull; one alone is cut."""
    kept = list(lengths)
    while sum(kept) > limit and len(kept) > 1:
        kept.pop()
    return len(kept), len(lengths) - len(kept), max(0, limit - sum(kept))


def test_pack_pad(spark):
    batches = {0: [3, 4], 1: [10], 2: [11], 3: [4, 4, 4, 1], 4: [0, 12], 5: [12, 0], 6: [0], 7: [5, 5, 0]}
    rows = [("w", b, i, n) for b, lengths in batches.items() for i, n in enumerate(lengths)] + [("v", 0, 9, 2)]
    got = pack_pad(spark.createDataFrame(rows, "worker string, batch int, id long, n long"), ["worker", "batch"], "id", "n", 10).collect()
    assert {(r.worker, r.batch): (r.samples, r.dropped, r.padding) for r in got} == {("w", b): by_hand(x, 10) for b, x in batches.items()} | {("v", 0): (1, 0, 8)}


def test_every_document_is_in_a_padded_batch(spark):
    got = samples.QUERIES["c17_pack_pad"](spark, FOLDER).collect()
    streams, expected = {}, {}
    for r in samples._workers(spark, FOLDER).orderBy("doc_id").collect():
        batches = streams.setdefault(r.worker, [[]])
        if sum(min(n, 2048) for n in batches[-1]) and sum(min(n, 2048) for n in [*batches[-1], r.n]) > 2048:
            batches.append([])
        batches[-1].append(r.n)
    for worker, batches in streams.items():
        expected |= {(worker, b): by_hand(x, 4096) for b, x in enumerate(batches)}
    assert {(r.worker, r.batch): (r.samples, r.dropped, r.padding) for r in got} == expected
    assert sum(r.samples + r.dropped for r in got) == samples.docs(spark, FOLDER).count()
