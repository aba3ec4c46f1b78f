"""Running statistics of images that arrive one by one: the streaming form of the averaging tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_average(stream: DataFrame, by: str = "i") -> DataFrame:
    """Count, mean and sample deviation of v by voxel, over all images seen so far; works on a stream and on a table."""
    return stream.where(~F.isnan("v")).groupBy(by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def windowed_average(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """The same by tumbling windows of event time, rows later than the watermark being dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
