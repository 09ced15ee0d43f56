"""Counts and averages by event time: the same function over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int = 64) -> DataFrame:
    """New Parquet files under path, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed(events: DataFrame, time: str, key: str, value: str, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, key, n, mean of each window of event time. Over a stream, rows later than `late` behind the latest are dropped
    and a window's row comes when it can't change any more; over a table the watermark does nothing."""
    w = F.window(F.col(time), length)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def run_once(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes all there is, appends finished rows as Parquet and ends; state and offsets stay in the checkpoint folder."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
