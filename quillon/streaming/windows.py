"""Extensions beyond batch: the sliding window over samples as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(samples: DataFrame, time: str, key: str, value: str, size: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n, mean, std of each event-time window; works on a stream (late rows dropped) and on a table."""
    w = F.window(time, size, step)
    # A watermark needs a time with a zone: the session's.
    rows = samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if samples.isStreaming else samples
    out = rows.groupBy(key, w).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "std")
