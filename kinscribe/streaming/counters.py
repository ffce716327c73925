"""Counters over unbounded input, and a sink that keeps their latest state.

The batch operators count in any order, so the same counts hold over a stream: running counts in
update mode, and windows by event time behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) so far. State grows with the number of distinct keys."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """(start, stop, keys, n) of event-time windows; rows more than `late` behind the newest are left out, and closed windows leave the state."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def without_repeats(stream: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key; keys are remembered for `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def keep_state(counts: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writes the counts that each batch changed to folder/batch=<number>; a batch that is run again after a failure replaces its own rows only."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def latest(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """(keys, n): the state that keep_state has left, the last batch of each key."""
    return spark.read.parquet(folder).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
