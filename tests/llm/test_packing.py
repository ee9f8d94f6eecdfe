from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.packing import _Sums, fill_report, packed, placed, plan, ranked, record_lengths


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 9), max_size=12), st.integers(50, 70))
def test_plan_places_every_item(counts, capacity):
    placed = Counter()
    for content, times in plan(counts, capacity):
        assert times > 0 and sum(content) <= capacity
        for length in content:
            placed[length] += times
    assert placed == Counter(counts)


def test_exact_complements_come_first():
    assert plan({60: 1, 40: 1, 30: 1}, 100)[0] == ((60, 40), 1)
    assert plan({60: 2, 25: 2, 15: 2, 39: 1}, 100)[0] == ((60, 25, 15), 2)
    assert plan({50: 1, 20: 1, 17: 1, 13: 1, 49: 1}, 100)[0] == ((50, 20, 17, 13), 1)
    assert plan({50: 5}, 100) == [((50, 50), 2), ((50,), 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 60))
def test_complement_against_brute_force(lengths, gap):
    from itertools import combinations

    found = _Sums(dict(Counter(lengths)), 60).complement(gap, ())
    sums = {sum(c) for n in (1, 2, 3) for c in combinations(lengths, n)}
    assert (found is not None) == (gap in sums)
    if found:
        assert sum(found) == gap and not Counter(found) - Counter(lengths)


def test_triples_are_found_after_many_stale_pairs():
    """Pairs that are used up fill the index; a triple far behind them is still found."""
    high, low = range(301, 401), range(1, 250)
    sums = _Sums({length: 1 for length in [*high, *low]}, 1000)
    for length in low:
        if length not in (104, 195):
            sums.take(length, 1)
    assert sorted(sums.complement(600, ())) == [104, 195, 301]


def test_complements_of_many_lengths_against_brute_force():
    """Up to 60 lengths, also after some have run out: a complement is found if and only if there is one."""
    import random
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(60):
        lengths = rng.sample(range(1, 900), rng.randrange(20, 60))
        sums = _Sums({x: 1 for x in lengths}, 1000)
        for _ in range(4):
            there = list(sums.counts)
            all_sums = {sum(c) for n in (1, 2, 3) for c in combinations(there, n)}
            for gap in rng.sample(range(1, 1000), 25):
                found = sums.complement(gap, ())
                assert (found is not None) == (gap in all_sums) and (not found or sum(found) == gap)
            for x in rng.sample(there, 4):
                sums.take(x, 1)


def test_a_triple_behind_many_first_lengths():
    """Each of many larger lengths leaves a rest that no pair fills; the triple behind them is found by the index."""
    lengths = [19998, 19999, 20003, *range(30001, 30145, 2)]
    sums = _Sums({x: 1 for x in lengths}, 65536)
    assert sorted(sums.complement(60000, ())) == [19998, 19999, 20003]


def test_places_in_blocks(spark):
    slots = [("a", 5, 0, 2, 0, 9), ("a", 5, 10, 1, 5, 9), ("a", 5, 11, 3, 6, 9), ("b", 5, 0, 1, 0, 4), ("a", 0, 0, 50, 0, 9)]
    ranks = [("a", 5, r, f"a5-{r}") for r in range(20)] + [("b", 5, r, f"b5-{r}") for r in range(4)] + [("a", 0, r, f"a0-{r}") for r in range(50)]
    table = spark.createDataFrame(slots, "dataset string, length long, first long, per_container long, container long, containers long")
    df = spark.createDataFrame(ranks, "dataset string, length long, rank long, record_id string")
    want = {}
    for dataset, length, rank, name in ranks:
        want[name] = max((s[2:5] for s in slots if s[:2] == (dataset, length) and s[2] <= rank))
    for block in (1, 3, 7, 1000):
        got = {r.record_id: (r["first"], r.per_container, r.container) for r in placed(df, table, block).collect()}
        assert got == want


ANNOTATIONS = "record_id long, dataset string, conversations array<struct<speaker:string,value:string>>, image string, image_list array<string>, ingested_at timestamp, tokens string"


def test_lengths(spark):
    from datetime import datetime

    early, late = datetime(2031, 1, 1), datetime(2031, 1, 2)
    talk = lambda *v: [("human", x) for x in v]
    rows = [
        (1, "a", talk("12345", None, ""), "i", None, None, "x"),
        (2, "a", None, None, ["i", "i", "gone", None], None, "x"),
        (3, "a", [None, ("gpt", "1234")], "", None, None, "x"),
        (4, None, [], "bad", None, None, "x"),
        (5, "a", talk("x" * 9), None, None, early, "x"),
        (5, "b", talk("x" * 900), None, None, late, "x"),
        (None, "a", talk("x"), None, None, None, "x"),
    ]
    images = spark.createDataFrame([("i", 29, 56, 1), ("bad", -5, 10, 1), ("null", None, 10, 1), (None, 1, 1, 1)], "image string, width int, height int, record_id int")
    got = {r.record_id: (r.dataset, r.tokens) for r in record_lengths(spark.createDataFrame(rows, ANNOTATIONS), images).collect()}
    assert got == {1: ("a", 2 + 4), 2: ("a", 8), 3: ("a", 1), 4: (None, 0), 5: ("b", 225)}
    assert record_lengths(spark.createDataFrame([], ANNOTATIONS), images).count() == 0


def test_packed(spark):
    lengths = [(i, "a", n) for i, n in enumerate([0, 100, 60, 40, 30, 30, 250, 200, 0, 99, 1] + [7] * 40)] + [(900, None, 5), (901, "zz", 5), (902, "b", 0), (903, "c", 3)]
    df = spark.createDataFrame(lengths, "record_id long, dataset string, tokens long")
    limits = spark.createDataFrame([("a", 100, 1), ("b", 10, 1), ("c", 0, 1), (None, 5, 1)], "dataset string, max_tokens int, tokens int")
    rows = packed(df, limits).collect()
    sums, fills = Counter(), Counter()
    for r in rows:
        sums[r.record_id] += r.tokens
        if r.container is not None:
            fills[r.dataset, r.container] += r.tokens
    assert sums == Counter({i: n for i, _, n in lengths}) and set(sums) == {i for i, *_ in lengths}
    assert max(n for (d, _), n in fills.items() if d == "a") <= 100
    pieces = Counter(r.record_id for r in rows)
    assert {i for i, n in pieces.items() if n > 1} == {6, 7} and pieces[6] == 3 and pieces[7] == 2
    assert {r.record_id for r in rows if r.container is None} == {900, 901, 903}
    containers = sorted(c for d, c in fills if d == "a")
    assert containers == list(range(len(containers)))
    report = {r.dataset: r for r in fill_report(packed(df, limits), limits).collect()}
    assert report["a"].tokens == sum(n for _, d, n in lengths if d == "a") and report["a"].containers <= report["a"].fewest + 1
    assert packed(df.filter("false"), limits).count() == 0


def test_ranks_are_complete(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as k")
    rows = ranked(df, ["k"], "id", salts=8).collect()
    for k in range(3):
        assert sorted(r["rank"] for r in rows if r.k == k) == list(range(sum(r.k == k for r in rows)))
