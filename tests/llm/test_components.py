from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litquarry.llm.components import connected_groups, peel_giant


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def run(spark, pairs, **options):
    df = spark.createDataFrame([(a, b, "extra", 1) for a, b in pairs], "l long, r long, id string, group_id int")
    rows = connected_groups(df, "l", "r", **options).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.group_id for r in rows}


@pytest.mark.parametrize("peel", [0.0, 0.02, 2.0])  # to the end, through the bulk, one step
def test_shapes(spark, peel):
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(100, i) for i in range(1, 40)]
    tail = [(39, 300)] + [(i, i + 1) for i in range(300, 330)]  # the giant's long tail
    mess = [(5, 5), (None, 7), (8, None), (None, None), (260, 200), (2, 100), (2, 100)]
    pairs = chain + star + tail + mess
    assert run(spark, pairs, peel_share=peel) == groups(pairs)


def test_no_links(spark):
    assert run(spark, []) == {} and run(spark, [(1, 1), (None, 2)]) == {}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=20))
def test_random(spark, pairs):
    assert run(spark, pairs) == groups(pairs)


def test_one_component_with_most_rows(spark):
    pairs = [(0, i) for i in range(1, 2_000)] + [(5_000, 5_001)]
    found = defaultdict(int)
    for g in run(spark, pairs).values():
        found[g] += 1
    assert found == {0: 2_000, 5_000: 2}


def test_a_deep_giant_is_peeled_to_its_end(spark):
    """Forty levels of fifty vertices: every one of them holds more than the share."""
    pairs = [(0, 1 + i) for i in range(50)] + [(1 + 50 * k + i, 1 + 50 * (k + 1) + (i * 7 + k) % 50) for k in range(39) for i in range(50)]
    pairs += [(10_000 + i, 10_001 + i) for i in range(0, 300, 3)]
    edges = spark.createDataFrame([(max(p), min(p)) for p in pairs], "u long, v long")
    giant, rest = peel_giant(edges, 0.001)
    assert giant.count() == 2_001 and giant.filter("label <> 0").count() == 0 and rest.count() == 100
