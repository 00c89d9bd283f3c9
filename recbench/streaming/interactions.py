"""Running interaction counts with event time, so that a recommender's input can follow its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(events: DataFrame, user: str, item: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, user, item, rating) for each window of event time; rows later than that are dropped.

    Works on a stream and on a table alike; on a stream a window comes out once nothing can change it.
    """
    timed = events.withColumn("_time", F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_time", late)
    counted = timed.groupBy(F.window("_time", window).alias("w"), F.col(user).alias("user"), F.col(item).alias("item")).agg(F.count(F.lit(1)).cast("double").alias("rating"))
    return counted.select(F.col("w.start").alias("start"), "user", "item", "rating")
