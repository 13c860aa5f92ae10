"""Streaming forms of the incremental batch steps.

The feeds re-send the last weeks with revised values, so watermarks are as long as the
revision window and revisions reach the target as upserts, not as duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.tables import dedupe_last, read_if_there, upsert_partitions

# How far back each feed re-sends its rows, in days.
REVISION_DAYS = {"load": 45, "snow": 30, "indices": 90}


def daily_curve(obs: DataFrame, keys: Sequence[str], delay: str, ts: str = "delivery_start", value: str = "value",
                min_points: int = 1) -> DataFrame:
    """CET-day mean and point count of a stream of points, emitted once a day is past revision.

    The watermark and the one-day window run on the local wall clock, so a window is exactly a
    CET day, the 23- and 25-hour days of the clock changes included. Days with fewer than
    ``min_points`` points are held back.
    """
    x = obs.withColumn("_local", F.from_utc_timestamp(F.col(ts).cast("timestamp"), "CET")).withWatermark("_local", delay)
    g = x.groupBy(*keys, F.window("_local", "1 day").alias("_w")).agg(F.avg(value).alias("value"), F.count("*").alias("n_points"))
    return g.filter(F.col("n_points") >= min_points).select(*keys, F.to_date("_w.start").alias("day"), "value", "n_points")


def upsert_batches(path: str, keys: Sequence[str], partition: str, *order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each micro-batch into a partitioned table.

    Re-running a batch after a failure writes the same rows again, so the merge is idempotent.
    """
    def merge(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = dedupe_last(batch, keys, *order)
        if read_if_there(spark, path) is not None:
            upsert_partitions(spark, path, rows, keys, partition)
        else:
            rows.write.mode("overwrite").partitionBy(partition).parquet(path)
    return merge


def stream_upsert(stream: DataFrame, path: str, keys: Sequence[str], partition: str, order: Sequence[str], checkpoint: str) -> DataStreamWriter:
    """Writer that keeps a table at the latest revision of every key."""
    return (stream.writeStream.foreachBatch(upsert_batches(path, keys, partition, *order))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True))


def stream_dedupe(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """One row per key inside the revision window: the first to arrive (last-wins is the upsert)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def revision_delay(feed: str) -> str:
    """Watermark delay as long as the feed's revision window."""
    return f"{REVISION_DAYS[feed]} days"
