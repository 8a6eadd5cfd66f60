"""Envelope and activity of live samples in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_qc_envelope(stream: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Least, greatest and mean absolute value in tumbling windows of event time `ts` by recording and unit.

    Rows that arrive after the watermark are dropped; works on a stream and on a table alike.
    """
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "recording_id", "unit_uid")
    out = w.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg(F.abs("value")).alias("activity"))
    return out.select("recording_id", "unit_uid", F.col("window.start").alias("start"), "low", "high", "activity")
