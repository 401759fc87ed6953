"""Joins by place whose cells are of the boxes' own size, so that what meets does not grow with how densely boxes lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import spread

PLACE = ["size", "cx", "cy"]


def size_of(extent: Column, most: int | None = None) -> Column:
    """Cell size of an extent: the power of two that holds it (64 at least), or most if that is less."""
    size = F.pow(F.lit(2.0), F.greatest(F.lit(6), F.ceil(F.log2(F.greatest(extent, F.lit(1)).cast("double"))))).cast("long")
    return size if most is None else F.least(size, F.lit(most).cast("long"))


def placed(boxes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, most: int | None = None) -> DataFrame:
    """boxes once for each cell (size, cx, cy) that they reach: four at most, unless most cuts their cells down."""
    sized = boxes.withColumns({"__x0": x0, "__y0": y0, "__x1": x1, "__y1": y1})
    sized = sized.withColumn("size", size_of(F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")), most))
    for place, low, high in (("cx", "__x0", "__x1"), ("cy", "__y0", "__y1")):
        sized = sized.withColumn(place, F.explode(F.sequence(F.floor(F.col(low) / F.col("size")), F.floor(F.col(high) / F.col("size")))))
    return sized.drop("__x0", "__y0", "__x1", "__y1")


def meeting(points: DataFrame, x: Column, y: Column, cells: DataFrame) -> DataFrame:
    """points with the placed boxes whose cells hold them, each pair once; points look in the cells of all sizes that there are (25 at most)."""
    at = points.crossJoin(F.broadcast(cells.select("size").distinct()))
    at = at.withColumns({"cx": F.floor(x / F.col("size")), "cy": F.floor(y / F.col("size"))})
    return at.join(spread(cells), PLACE).drop(*PLACE)
