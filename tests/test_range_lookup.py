from bisect import bisect_right
from itertools import accumulate

from gridloom.plans import scalars
from gridloom.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_every_row_number_is_looked_up(spark):
    sizes = sorted((r.dataset, r["count"]) for r in table(spark, FOLDER, "annotations").filter("dataset is not null").groupBy("dataset").count().collect())
    ends = list(accumulate(n for _, n in sizes))
    expected = set()
    for (row,) in table(spark, FOLDER, "images").select("image_id").collect():
        k = bisect_right(ends, row)
        if k < len(ends):
            expected.add((row, sizes[k][0], row - (ends[k] - sizes[k][1])))
    got = [tuple(r) for r in scalars.QUERIES["j10_range_lookup"](spark, FOLDER).collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert {row % 3 for row, _, _ in got} == {0, 1, 2}
