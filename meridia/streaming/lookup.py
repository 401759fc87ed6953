"""Streams of points: a stateless stream-static lookup, and windowed counts (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.finder import ZoneFinder


def lookup(points: DataFrame, finder: ZoneFinder) -> DataFrame:
    """points, a table or a stream (px, py and any other columns), and their zone's name ('' where there is none).

    The index is static, so a stream keeps no state and no micro-batch is shuffled while the index is broadcast."""
    return finder.met(points, strict=False).select(*points.columns, F.coalesce(finder.first_name(), F.lit("")).alias("name"))


def lookup_stream(points: DataFrame, finder: ZoneFinder, sink, checkpoint: str):
    """Start a query that hands every looked-up micro-batch to sink(df, epoch)."""
    return lookup(points, finder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).start()


def windowed_counts(named: DataFrame, time: str = "ts", window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Extension: points by zone and tumbling window."""
    rows = named.withWatermark(time, late) if late else named
    return rows.groupBy(F.window(time, window).alias("w"), "name").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "name", "n")
