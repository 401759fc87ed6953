"""Dense numbers in a global order, without a task that holds all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import settled

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str, n_parts: int | None = None) -> DataFrame:
    """df with name, a long: each row's place (from 0) in the order.

    Rows are dealt by ranges of the order and sorted there; a row's number is its range's first number plus its place in
    the range.  Only one count a range comes to the driver.  Rows that are equal in the order get different numbers, in no
    defined order; equal values all fall into one range, so an order that tells rows apart keeps the ranges even."""
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", PLACE_BITS)
    counts = {r[0]: r[1] for r in at.groupBy(part.alias("part")).count().collect()}  # one row a range
    ranges = sorted(counts)
    firsts = [0, *accumulate(counts[p] for p in ranges)]
    known = at.sparkSession.createDataFrame(list(zip(ranges, firsts[:-1], strict=True)), "__part long, __first long")
    joined = at.withColumn("__part", part).join(F.broadcast(known), "__part")
    return joined.withColumn(name, F.col("__first") + F.col("__at") - F.shiftleft(F.col("__part"), PLACE_BITS)).drop("__at", "__part", "__first")
