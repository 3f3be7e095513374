"""Event logs as streams: JSON lines written by runs, followed, counted and handed to callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "at timestamp, path string, rel_path string, step int, kind string, error string, delivered boolean"


def append(events: DataFrame, path: str) -> None:
    """Add a run's events to the log."""
    events.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def follow(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream."""
    return spark.readStream.schema(SCHEMA).json(path)


def counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events of each kind by time window; windows close when the watermark has passed them."""
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("window"), "kind").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def each(events: DataFrame, callback: Callable[[Row], None], checkpoint: str) -> StreamingQuery:
    """Hand every event that is there to a callback, batch by batch, in the order of the walk."""

    def batch(rows: DataFrame, _: int) -> None:
        for row in rows.orderBy("at", F.split("rel_path", "/"), "step").toLocalIterator():
            callback(row)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
