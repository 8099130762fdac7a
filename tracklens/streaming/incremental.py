"""Upserts driven by micro-batches.

The catalogue has no streams of its own. These drive its idempotent merges from a stream of evidence: a
micro-batch touches only the partitions it has rows for, and a batch that runs twice gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracklens.operators.merges import upsert
from tracklens.sources.shared import shared_path
from tracklens.sources.sinks import replace_partitions


def upsert_batch(path: str, partition: str, keys: list[str], sequence: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the newest row of each key, in a Parquet table partitioned by one column.

    Old rows of the touched partitions and new ones are merged into a staging table first, so no plan reads
    what it overwrites.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        touched = batch.select(partition).distinct()
        try:
            old = spark.read.schema(batch.schema).option("basePath", path).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        old = old.select(*batch.columns).join(touched, partition, "left_semi")
        staging = shared_path(spark, "upsert")
        upsert(old, batch, keys, sequence).write.parquet(staging)
        replace_partitions(spark.read.schema(batch.schema).parquet(staging), path, partition)

    return merge


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, partition: str, keys: list[str], sequence: str) -> StreamingQuery:
    """Runs all that is there in micro-batches, then ends."""
    return stream.writeStream.foreachBatch(upsert_batch(path, partition, keys, sequence)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Counts of events per key and window of event time; rows later than ``late`` are too late."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).count().select(F.col("window.start").alias("start"), *keys, "count")
