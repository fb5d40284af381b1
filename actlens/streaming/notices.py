"""Incremental ingestion of notices as a stream: an addition for portals that deliver files continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema, *, time: str, key: str, late: str = "7 days") -> DataFrame:  # noqa: ANN001
    """New files of a folder, each key once within the watermark."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, time: str, *, late: str = "1 day") -> DataFrame:
    """Counts and sums per hour and event type, late rows included up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops: the nightly job."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
