"""The pipeline as a stream: records arrive as JSON-lines files and each micro-batch is scored into a partition of a table.

An extension. Deduplication is by micro-batch, in order of arrival; duplicates across batches are for the persisted
index to find. A batch that is run again after a failure replaces its own partition, so the sink is exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litquarry.config import Topics
from litquarry.operators.annotate import annotate
from litquarry.operators.dedupe import mark_duplicates
from litquarry.operators.score import score
from litquarry.schema import PAPER, as_papers


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of records from the JSON-lines files of a folder."""
    return spark.readStream.schema(PAPER).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def score_stream(records: DataFrame, topics: Topics, target: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Score a stream of records into ``target``, partitioned by batch."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = mark_duplicates(as_papers(batch)).filter("NOT is_duplicate").drop("is_duplicate")
        scored = annotate(score(fresh, topics)).withColumn("batch", F.lit(number))
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
