"""Incremental runs: new files as a stream, upserted batch by batch; windowed findings with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Files under root as they arrive, a bounded number at a time."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)


def upsert_stream(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "path"):
    """Start a query that analyses every batch and writes it once under its batch id.

    A batch that runs again after a failure replaces its own folder, so each result is there exactly
    once; ``latest`` reads the newest row of every key.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str = "path") -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "epoch").alias("r")).select("r.*")


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; on a stream, rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = windowed_counts(e, "ts", "event_type", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"event_windows": event_windows}
SQL = {"event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"}
