from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.mixing import TOKENIZER, Flow, bisected_total, largest_total, mixture, route, shares_of, total_and_limits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), min_size=3, max_size=3))
def test_flow_against_brute_force(costs):
    """An assignment of three to three is the cheapest of all permutations."""
    from itertools import permutations

    flow = Flow(8)
    for i, row in enumerate(costs):
        flow.add(0, 2 + i, 1)
        flow.add(5 + i, 1, 1)
        for j, cost in enumerate(row):
            flow.add(2 + i, 5 + j, 1, cost)
    assert flow.send(0, 1) == (3, min(sum(costs[i][j] for i, j in enumerate(p)) for p in permutations(range(3))))


def test_route_and_total():
    patterns = [(("a",), 100), (("a", "b"), 50), (("b",), 10)]
    assert largest_total(patterns, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}) in (120, 121)
    sent, routes = route(patterns, {"a": 100, "b": 60}, {"a": 1, "b": 1})
    assert sent == 160 and sum(n for p, _, s, n in routes if s == "b") == 60
    assert largest_total(patterns, {"b": 1.0}, {"b": 3}) == 180
    _, routes = route([(("a",), 10)], {"a": 15}, {"a": 4})
    assert sorted((r, n) for _, r, _, n in routes) == [(1, 10), (2, 5)]
    assert shares_of(10, {"a": 1.0, "b": 3.0}) == {"a": 2, "b": 7}


PATTERN = st.tuples(st.sets(st.sampled_from("abcd"), min_size=1).map(lambda s: tuple(sorted(s))), st.integers(1, 500))


@settings(max_examples=60, deadline=None)
@given(st.lists(PATTERN, min_size=1, max_size=8, unique_by=lambda p: p[0]), st.lists(st.integers(1, 9), min_size=4, max_size=4), st.lists(st.integers(1, 4), min_size=4, max_size=4))
def test_total_of_all_sets_is_that_of_bisection(patterns, shares, repeats):
    present = {s for sources, _ in patterns for s in sources}
    wanted = {s: x / 10 for s, x in zip("abcd", shares) if s in present}
    caps = dict(zip("abcd", repeats))
    total, limiting = total_and_limits(patterns, wanted, caps)
    assert abs(total - bisected_total(patterns, wanted, caps)) <= 4 + len(wanted) / min(x / sum(wanted.values()) for x in wanted.values())
    quotas = shares_of(total, wanted)
    assert route(patterns, quotas, caps)[0] == sum(quotas.values()) and limiting <= set(wanted) and limiting


SCHEMA = "doc_id long, source string, text string, tokens int"


def test_mixture(spark):
    rows = [(i, "a", f"text number {i} of the first source", 1) for i in range(300)] + [(500 + i, " B", f"note {i} from the second", 1) for i in range(40)]
    rows += [(600, "a", "shared words", 1), (601, "b", "shared words", 1), (700, None, "x", 1), (701, "a", None, 1), (702, "a", "  ", 1), (None, "a", "x", 1), (703, "other", "x y z", 1), (0, "a", "text number 0 of the first source", 1)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 2)], "source string, target_share double, max_repeats int")
    documents = spark.createDataFrame(rows, SCHEMA)
    mixed, report = mixture(documents, targets)
    got = mixed.collect()
    assert len({r.doc_id for r in got}) == len(got)
    caps = {"a": 1, "b": 3}
    assert all(1 <= r.uses <= caps[r.source] for r in got)
    source_of = {r[0]: (r[1] or "").strip().lower() for r in rows if r[0] is not None}
    assert all(source_of[r.doc_id] == r.source for r in got)
    total = sum(r.tokens * r.uses for r in got)
    for source, share in (("a", 5 / 9), ("b", 4 / 9)):
        assert abs(sum(r.tokens * r.uses for r in got if r.source == source) / total - share) < 0.02
    why = {r.source: r for r in report.collect()}
    assert why["b"].reason == "limits the total" and why["a"].reason is None and why["a"].share_of_present == 0.555556 and why["gone"].share_of_present is None
    assert why["gone"].reason == "absent" and why["zero"].mixed_tokens == 0 and why["b"].most_uses == 3
    again = mixture(documents.repartition(5), targets)[0].collect()
    assert {(r.doc_id, r.source, r.uses) for r in again} == {(r.doc_id, r.source, r.uses) for r in got}
    mixed, report = mixture(documents.filter("false"), targets)
    assert mixed.count() == 0 and report.count() == 4
    assert mixture(documents, targets.filter("false"))[0].count() == 0


def test_copies_within_a_source_are_all_used(spark):
    rows = [(i, "a", "the same words in every document", 1) for i in range(30)] + [(100 + i, "b", f"words of number {i}", 1) for i in range(400)]
    rows += [(5, "a", "the same words in every document", 1), (600, "b", "the same words in every document", 1)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture(spark.createDataFrame(rows, SCHEMA), targets)
    got = {r.doc_id: r for r in mixed.collect() if r.source == "a"}
    assert set(got) == set(range(30)) and all(r.uses <= 2 for r in got.values()) and sum(r.uses for r in got.values()) >= 59
    why = {r.source: r for r in report.collect()}
    assert why["a"].available_tokens == 30 * got[0].tokens and why["a"].documents == 30


def test_given_total(spark):
    rows = [(i, s, f"some words {i}", 1) for i, s in enumerate(s for _, s in product(range(100), "ab"))]
    targets = spark.createDataFrame([("a", 0.75, 2), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    mixed, _ = mixture(spark.createDataFrame(rows, SCHEMA), targets, total_tokens=400, tokenizer=TOKENIZER)
    got = mixed.collect()
    assert abs(sum(r.tokens * r.uses for r in got if r.source == "a") - 300) <= 6 and abs(sum(r.tokens * r.uses for r in got if r.source == "b") - 100) <= 6
