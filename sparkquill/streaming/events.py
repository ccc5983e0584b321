"""Event streams: windows with watermarks, duplicates, stage durations. Each works on static frames too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream; ``ts`` becomes a timestamp that watermarks accept."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _late(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total over tumbling or sliding windows."""
    rows = _late(events, late).groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, n."""
    rows = _late(events, late).groupBy("user_id", F.session_window("ts", gap))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, as redelivered work is."""
    return _late(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def stage_durations(events: DataFrame) -> DataFrame:
    """event_type, n, mean_seconds until the user's next event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.lead("ts").over(order).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    return events.withColumn("s", seconds).where("s is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 3).alias("mean_seconds"))
