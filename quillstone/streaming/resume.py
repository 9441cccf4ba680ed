"""Incremental runs: file batches that stop when done, idempotent sinks, and an
extension of our own, windowed event counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import append_new


def process_new_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str, files_per_batch: int = 100) -> None:
    """Run transform over files not seen before, in batches, until none is left.

    Each batch leaves out keys that the sink already holds, which a log of keys tells
    (see sources.commits), and is committed by its number: one that is run again after a
    failure adds nothing twice."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        append_new(transform(batch), sink, key, number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, ts: str = "ts", group: str = "event_type", value: str = "value", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling window; works on streams and tables alike."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    out = timed.withWatermark(ts, late) if events.isStreaming else timed
    amount = F.col(value).cast("decimal(20,4)")
    return out.groupBy(F.window(ts, window).alias("w"), group).agg(F.count("*").alias("n"), F.sum(amount).cast("double").alias("total")).select(F.col("w.start").alias("window_start"), group, "n", "total")
