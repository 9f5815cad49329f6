"""Running note statistics of tracks over an unbounded stream of note events (an extension; the batch operators
do not depend on it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_note_stats(events: DataFrame, time: str = "ts", late: str = "1 day", span: str = "7 days") -> DataFrame:
    """Note count, mean pitch and pitch range by track and tumbling window; rows later than `late` are dropped.

    Works on a streaming and on a static frame with columns track_id, pitch, is_drum and the event time."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).where(~F.col("is_drum"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark(time, late)
    grouped = stamped.groupBy(F.window(time, span).alias("span"), "track_id")
    stats = grouped.agg(F.count(F.lit(1)).alias("note_count"), F.avg("pitch").alias("mean_pitch"), (F.max("pitch") - F.min("pitch")).alias("pitch_range"))
    return stats.select(F.col("span.start").alias("window_start"), "track_id", "note_count", "mean_pitch", "pitch_range")
