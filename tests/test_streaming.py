import json

from litquarry.config import GENERAL, Profile, Topics
from litquarry.streaming.pipeline import record_stream, score_stream

TOPICS = Topics((Profile(GENERAL, ("pathology",), 5),))


def test_batches_and_restart(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        score_stream(record_stream(spark, str(source)), TOPICS, str(target), str(tmp_path / "checkpoint"), once=True).awaitTermination()

    rows = [{"ord": 0, "title": "pathology", "abstract": "x", "doi": "1"}, {"ord": 1, "title": "again", "doi": "1"}, {"ord": 2, "title": None}]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    run()
    (source / "b.json").write_text(json.dumps({"ord": 3, "title": "late"}))
    run()
    run()  # nothing new
    got = {r.ord: (r.batch, r.decision) for r in spark.read.parquet(str(target)).collect()}
    assert got == {0: (0, "watchlist"), 2: (0, "skip"), 3: (1, "skip")}
