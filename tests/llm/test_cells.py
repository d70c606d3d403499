import random

from pyspark.sql import functions as F

from litquarry.llm.cells import CellIndex, doi_key, pmid_key
from litquarry.llm.words import distinct_words

SCHEMA = "id long, seq int, text string, doi string"


def rows(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(120)] + ["the", "of", "in"] * 3
    out, number = [], 0
    for seq in (0, 0, 0, 1, 1, 2, 3):
        for _ in range(40):
            if out and r.random() < 0.6 and (old := r.choice(out)[2]):
                t = old.split()
                if r.random() < 0.7:
                    t[r.randrange(len(t))] = r.choice(words)
                if r.random() < 0.3:
                    t.append(r.choice(words))
            else:
                t = r.choices(words, k=r.randint(5, 18))
            out.append((number, seq, " ".join(t), f"10.1/{r.randint(0, 200)}" if r.random() < 0.3 else None))
            number += 1
    return out + [(9_000, 0, None, None), (9_001, 1, "", None), (9_002, 2, "one two", None), (9_003, None, "lost " * 9, None)]


def brute(data):
    got = set()
    for i, s, t, d in data:
        for j, u, v, e in data:
            if s is None or u is None or not s < u:
                continue
            a, b = distinct_words(t), distinct_words(v)
            if d and d == e or min(len(a), len(b)) >= 6 and 10 * len(a & b) >= 8 * len(a | b):
                got.add((i, j))
    return got


def test_exact_against_brute_force_batch_by_batch_and_in_one_pass(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    expected = brute(data)
    index, got = CellIndex.create(df.filter("seq = 0")), set()
    for k in (1, 2, 3):
        got |= {tuple(r) for r in index.probe_and_append(df.filter(F.col("seq") == k), f"b{k}").collect()}
    assert got == expected
    # the index now holds everything: one probe in which each record sees only lower batch numbers
    assert {tuple(r) for r in index.probe(df.filter("seq > 0 OR seq IS NULL")).collect()} == expected


def test_a_reopened_index_and_retried_batches(spark, tmp_path):
    data = rows(5)
    df, path = spark.createDataFrame(data, SCHEMA), f"file://{tmp_path}/index"
    CellIndex.create(df.filter("seq = 0"), path)
    first = CellIndex(spark, path)
    first.append(df.filter("seq = 1"), "b1")
    count = first._table("members").count(), first._table("vectors").count()
    CellIndex(spark, path).append(df.filter("seq = 1"), "b1")  # the batch comes again
    again = CellIndex(spark, path)
    assert (again._table("members").count(), again._table("vectors").count()) == count
    # an append that stopped before its last step: its files are there, but it does not count, and the retry replaces them
    df.filter("seq = 2").selectExpr("id k1", "id k2", "id", "seq", "3 bucket").write.partitionBy("bucket").parquet(f"{path}/members/batch=b2")
    assert CellIndex(spark, path)._table("members").count() == count[0]
    again.append(df.filter("seq = 2"), "b2")
    got = {tuple(r) for r in CellIndex(spark, path).probe(df.filter("seq > 0")).collect()}
    assert got == {p for p in brute(data) if next(s for i, s, *_ in data if i == p[0]) < 3}


def test_a_probe_reads_the_buckets_of_its_keys(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    index = CellIndex.create(df.filter("seq = 0"))
    few = index._table("vectors", [3, 5])
    assert {r[0] for r in few.select("bucket").distinct().collect()} <= {3, 5}
    batch = index.prepare(df.filter(F.size(F.split("text", " ")) > 16).orderBy("id").limit(1).withColumn("seq", F.lit(9)))
    assert len(index._hit(batch.vectors.selectExpr(f"CAST(pmod(k1, {index.buckets}) AS INT) AS bucket"), batch)) == 1
    assert "PartitionFilters: [" in (plan := few._jdf.queryExecution().toString()) and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_batch_and_empty_history(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    index = CellIndex.create(df.filter("seq = 0"))
    assert index.probe_and_append(df.limit(0), "empty").count() == 0
    index = CellIndex.create(df.limit(0))
    assert index.probe_and_append(df.filter("seq = 1"), "b1").count() == 0
    assert index.probe(df.filter("seq = 2")).count() > 0


def test_copies(spark):
    title = "one two three four five six seven"
    df = spark.createDataFrame([(i, 0, title, None) for i in range(300)] + [(1_000, 1, title, None), (1_000, 1, title, None)], SCHEMA)
    index = CellIndex.create(df.filter("seq = 0"))
    assert index.probe_and_append(df.filter("seq = 1"), "b1").count() == 300
    assert index._table("vectors").count() == 1  # however many copies, in however many batches


def test_keys(spark):
    df = spark.createDataFrame([(" DOI 10.1/Ab. ", "PMID: 0012"), ("https://x.example/10.2/c;", "n/a"), ("10.0000/unknown", "0"), ("n/a", "１２"), (None, None)], "d string, p string")
    assert [tuple(r) for r in df.select(doi_key(F.col("d")), pmid_key(F.col("p"))).collect()] == [
        ("10.1/ab", "12"), ("10.2/c", None), (None, None), (None, "12"), (None, None)]


def test_batches_leave_nothing_with_the_driver(spark):
    """After each batch the driver's heap holds little that a collection of garbage would free."""
    df = spark.createDataFrame(rows(), SCHEMA)
    index = CellIndex.create(df.filter("seq = 0"))
    runtime, system = spark._jvm.Runtime.getRuntime(), spark._jvm.System
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    for k in (1, 2, 3):
        index.probe_and_append(df.filter(F.col("seq") == k), f"b{k}")
        after = used()
        system.gc()
        assert after - used() < 32_000_000
