import random

import pytest

from litquarry.llm import minhash as m


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "id long, text string, bands string, n int").select("id", "text")


def brute(rows, n, threshold, least):
    sets = [(i, m.grams(t, n)) for i, t in rows if t]
    sets = [(i, s) for i, s in sets if len(s) >= least]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if i != j and 10 * len(a & b) >= 10 * threshold * len(a | b) - 1e-6}


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, number = [], 0
    for _ in range(60):
        base = r.choices(words, k=60)
        for _ in range(r.choice([1, 1, 2, 4])):
            copy = [w if r.random() > 0.03 else r.choice(words) for w in base]
            rows.append((number, " ".join(copy)))
            number += 1
    return rows


@pytest.mark.parametrize(("n", "hot"), [(1, 5_000), (5, 5_000), (1, 1), (5, 1)])
def test_against_brute_force(spark, n, hot):
    """With hot=1 nearly every bucket takes the exact way for crowded buckets."""
    rows = corpus() + [(9_000, "same words here " * 20), (9_001, "same words here " * 20), (9_002, None), (9_003, ""), (9_004, "short")]
    members, pairs = m.near_duplicate_classes(texts(spark, rows), n=n, min_size=2, hot=hot)
    got = [(r.a, r.b) for r in m.expand(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, n, 0.8, 2)


def test_long_lists_of_the_exact_way_are_split(spark, monkeypatch):
    monkeypatch.setattr(m, "LIST", 2)
    r = random.Random(7)
    rows = [(i, "shared " + " ".join(r.choices([f"w{k}" for k in range(14)], k=r.randint(3, 12)))) for i in range(60)]
    pairs = m.prefix_pairs(m._gram_sets(texts(spark, rows), 1), 0.8)
    got = [(x.a, x.b) for x in pairs.collect()]
    assert len(got) == len(set(got)) and brute(rows, 1, 0.8, 1) <= set(got)


def test_exact_copies_are_one_class(spark):
    rows = [(i, "a b c d e f g h i j k l") for i in range(500)] + [(1_000, "a b c d e f g h i j k l m")]
    members, pairs = m.near_duplicate_classes(texts(spark, rows), n=1, min_size=1)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1_000)]
    assert members.select("class_id").distinct().count() == 2 and members.count() == 501


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "x y z"), (1, "x y z"), (2, "x y z")]
    members, pairs = m.near_duplicate_classes(texts(spark, rows), n=1)
    assert {(r.a, r.b) for r in m.expand(members, pairs).collect()} == {(1, 2)}
    members, pairs = m.near_duplicate_classes(texts(spark, []), n=1)
    assert members.count() == pairs.count() == 0


def test_long_text_is_used_whole(spark):
    long = " ".join(f"w{k}" for k in range(50_000))
    members, pairs = m.near_duplicate_classes(texts(spark, [(1, long), (2, long + " end"), (3, long + " " + long.replace("w", "v"))]), n=1)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]


def test_banding_reaches_its_recall():
    b = m.choose_banding(0.8, 0.999)
    assert b.recall(0.8) >= 0.999 and b.bands <= 20 and m.choose_banding(0.8, 0.9).rows > b.rows
    big = m.choose_banding(0.8, 0.999, 64)
    assert big.recall(0.8) >= 0.999 and big.rows > b.rows


def test_class_representative_does_not_depend_on_the_order_of_rows(spark):
    """Copies spread over many files: both sides of the self-join must take the same record for a class."""
    base = [" ".join(f"w{(k * 7 + j) % 97}" for j in range(40)) for k in range(12)]
    rows = [(c * 1_000 + k, t if c % 2 else t + " more") for k, t in enumerate(base) for c in range(40)]
    random.Random(5).shuffle(rows)
    df = texts(spark, rows).repartition(16)
    members, pairs = m.near_duplicate_classes(df, n=1)
    classes = {r.class_id for r in members.collect()}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and {x for p in got for x in p} <= classes
    assert {(k, 1_000 + k) for k in range(12)} <= set(got)


def test_the_exact_way_keeps_few_rows_and_pairs_on_disk(spark, monkeypatch):
    """A table of common n-grams alone: its long lists are joined in several turns, and pairs too far apart never leave a join."""
    monkeypatch.setattr(m, "LIST", 20)
    monkeypatch.setattr(m, "LEAST_TURN", 10_000, raising=False)
    turns = []

    def counting(df, label, *by, write=m.materialise):
        table = write(df, label, *by)
        if label == "turn":
            turns.append(table.count())
        return table

    monkeypatch.setattr(m, "materialise", counting)
    r = random.Random(11)
    rows = [(i, " ".join(r.sample([f"w{k}" for k in range(60)], 25))) for i in range(300)]
    rows += [(1_000 + i, rows[i][1] + " own") for i in range(50)]
    got = [(x.a, x.b) for x in m.prefix_pairs(m._gram_sets(texts(spark, rows), 1), 0.8).collect()]
    true = brute(rows, 1, 0.8, 1)
    assert len(got) == len(set(got)) and true <= set(got) and len(got) < 2 * len(true)
    assert len(turns) > 1 and sum(turns) < 20 * len(true)
