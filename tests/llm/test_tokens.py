from pathlib import Path

import pytest
from pyspark.sql import functions as F

from litquarry.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary file")


def test_counts(spark):
    texts = [None, "", "one two  three", "<|endoftext|>", "Präparate aus 12 Fällen", "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in df.select("i", tokens.token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    own = tokens.encoder(tokens.VOCABULARY)
    assert got[:2] == [0, 0] and got[2:] == [len(own.encode_ordinary(t)) for t in texts[2:]] and got[3] > 1
    assert all(own.decode(own.encode_ordinary(t)) == t for t in texts[2:])
