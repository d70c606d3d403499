import pytest

from litquarry.llm import fusion, queries
from litquarry.llm.fusion import estimate, fuse

CLAIMS = "group_id long, field_name string, record_id long, src string, value_key long, size int, extra string"


def claims(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CLAIMS)


def test_the_order_outweighs_any_vote(spark):
    df = claims(spark, [(1, "a", 10, "s", 5, 3), (1, "a", 11, "t", 6, 9), (1, "a", 12, "u", 5, 3), (2, "a", 20, "s", 7, 1), (2, "a", 20, "s", 7, 1)])
    rows = {r.group_id: r for r in fuse(df, ["size", "record_id"]).collect()}
    assert (rows[1].record_id, rows[2].record_id) == (11, 20) and 0 < rows[1].posterior < 1


def test_votes_decide_with_a_flat_prior(spark):
    rows = [(g, "a", g * 10 + k, s, v, 0) for g in range(30) for k, (s, v) in enumerate((("s", 1), ("t", 1), ("u", 2)))]
    assert all(r.record_id % 10 in (0, 1) for r in fuse(claims(spark, rows), ["size", "record_id"], strength=0.0).collect())


def test_a_weak_prior_gives_way_to_votes(spark):
    rows = [(g, "a", g * 10 + k, s, v, v) for g in range(30) for k, (s, v) in enumerate((("s", 1), ("t", 1), ("u", 2)))]
    took = lambda strength: {r.group_id: (r.record_id % 10, r.posterior) for r in fuse(claims(spark, rows), ["size", "record_id"], strength=strength).collect()}
    flat, weak, strong = took(0.0), took(0.5), took(None)
    assert {k for k, _ in flat.values()} == {k for k, _ in weak.values()} == {1} and {k for k, _ in strong.values()} == {2}
    assert all(0 < p <= 1 for took in (flat, weak, strong) for _, p in took.values())


def test_a_group_with_all_rows(spark):
    rows = [(1, "a", i, "stu"[i % 3], i, i * 37 % 1_009) for i in range(1_009)]
    got = fuse(claims(spark, rows), ["size", "record_id"]).collect()
    assert [(r.group_id, r.record_id * 37 % 1_009) for r in got] == [(1, 1_008)]


def test_copied_votes_count_less(spark):
    """Two sources that share their errors are found out: against two independent ones they no longer win."""
    rows = []
    for g in range(60):
        truth, wrong = 1_000 + g, 2_000 + g
        bad = g % 2  # copier and original are wrong together in half the groups
        for k, (s, v) in enumerate((("good1", truth), ("good2", truth if g % 10 else 3_000 + g), ("good3", truth if g % 7 else 4_000 + g), ("orig", wrong if bad else truth), ("copy", wrong if bad else truth))):
            rows.append((g, "a", g * 10 + k, s, v, 0))
    _, accuracy, dependent = estimate(claims(spark, rows))
    assert dependent["copy", "orig"] > 0.9 > 0.5 > dependent["good1", "good2"]
    assert accuracy["good1"] > accuracy["orig"]


def test_empty_and_unknown(spark):
    assert fuse(claims(spark, []), ["size", "record_id"]).count() == 0
    with pytest.raises(ValueError):
        fuse(claims(spark, []), ["size"], strength=-1.0)


def test_no_votes_are_estimated_where_the_order_decides(spark, monkeypatch):
    """The survivors by the stated order are those of the fusion with an outweighing prior, and no stage runs in vain."""
    rows = [(g, "ab"[k % 2], g * 100 + k, "stu"[k * g % 3], k * 7 % 5, k * g % 4) for g in range(1, 40) for k in range(12)]
    df = claims(spark, rows)
    whole = {tuple(r) for r in fuse(df, ["size", "record_id"]).drop("posterior").collect()}
    monkeypatch.setattr(fusion, "estimate", lambda _: pytest.fail("votes estimated"))
    monkeypatch.setattr(queries, "_paper_claims", lambda spark, d: df.selectExpr("*", "0 AS trust", "0 AS fetched_at", "record_id AS smallest"))
    assert {tuple(r) for r in queries.p4_found(spark, "").collect()} == whole
