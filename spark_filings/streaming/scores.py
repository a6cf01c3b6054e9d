"""Scoring answers as they land: a file stream with an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_scores(spark: SparkSession, source: str, schema: T.StructType, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Score all files that `source` holds and has not yet scored, and stop.

    Each micro-batch is written under its own number and replaced if it is
    repeated, so that a restart changes nothing; `latest_scores` reads one
    score of each answer, so that a repeated file does not either.  Scoring is
    a function of a row and of static tables, so no state is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_scores(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """What `stream_scores` has written, for each key from its last batch only."""
    rows = spark.read.parquet(sink)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).dropDuplicates(keys).drop("batch")
