"""Feedback as a stream: events and searches append counters, which the next build folds in. Nothing is updated in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources import store

COUNTERS = ("hits", "helpful", "unhelpful")


def counters(events: DataFrame) -> DataFrame:
    """(claim_id, hits, helpful, unhelpful) of events (claim_id, kind)."""
    kind = F.col("kind")
    return events.groupBy("claim_id").agg(F.count("*").alias("hits"), F.count_if(kind == "helpful").alias("helpful"), F.count_if(kind == "unhelpful").alias("unhelpful"))


def append_counters(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch of an event stream to counters and append them under its batch number, so that a batch that is run again
    after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        counters(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_shown(found: DataFrame, path: str, request: str) -> None:
    """Append a hit for each claim that a search has returned, under the request's name, so that a request that is recorded again
    replaces itself. What was returned is written once: the counters never depend on a search that runs again later."""
    shown = found.groupBy("claim_id").agg(F.count("*").alias("hits")).select("claim_id", "hits", *(F.lit(0).cast("long").alias(c) for c in COUNTERS[1:]))
    shown.write.mode("overwrite").parquet(f"{path}/batch=shown-{request}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Counters of all batches, as the index build takes them; none where nothing was appended."""
    schema = ", ".join(["claim_id long", *(f"{c} long" for c in COUNTERS)])
    if not store.exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy("claim_id").agg(*(F.sum(c).alias(c) for c in COUNTERS))


def process_new_files(files: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a transformation over files that were not seen before (a file source's stream) and append its rows."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
