"""Incremental scoring of arriving completions: an extension, since the batch operators have no stream.

Files that arrive are scored once; a row is written only if its (key, input
digest) has no output yet, so a restarted stream repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoreloom.sources.files import exists


def score_stream(spark: SparkSession, source: str, schema: str, key: str, text: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Start a stream over parquet files; it ends when all files that are there have been read."""

    def upsert(batch: DataFrame, _: int) -> None:
        batch = batch.withColumn("input_sha", F.sha2(text, 256)).dropDuplicates([key, "input_sha"])
        if exists(spark, f"{out}/_SUCCESS"):
            batch = batch.join(spark.read.parquet(out).select(key, "input_sha"), [key, "input_sha"], "left_anti")
        score(batch).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
