"""Rings and edges: boxes, areas, windings, stripes, self-intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..stages import spread

RING = ["tz_idx", "poly_idx", "hole_idx"]


def edges(rings: DataFrame) -> DataFrame:
    """One row an edge; the ring is opened first and closes on its first point."""
    opened = rings.select(*RING, G.open_ring(F.col("pts")).alias("p"))
    n = F.size("p")
    each = opened.select(*RING, "p", F.posexplode("p").alias("edge_idx", "a"))
    following = F.get("p", (F.col("edge_idx") + 1) % n)
    return each.select(*RING, "edge_idx", F.col("a.x").alias("xa"), F.col("a.y").alias("ya"), following["x"].alias("xb"), following["y"].alias("yb"))


def vertices(rings: DataFrame) -> DataFrame:
    return rings.select(*RING, F.posexplode(G.open_ring(F.col("pts"))).alias("pt_idx", "p")).select(*RING, "pt_idx", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def bounds(edge_table: DataFrame, *by: str) -> DataFrame:
    return edge_table.groupBy(*by).agg(F.min("xa").alias("min_x"), F.min("ya").alias("min_y"), F.max("xa").alias("max_x"), F.max("ya").alias("max_y"))


def cross_product() -> Column:
    return F.col("xa").cast("double") * F.col("yb") - F.col("xb").cast("double") * F.col("ya")


def area_perimeter(edge_table: DataFrame) -> DataFrame:
    """area (absolute), signed_area, perimeter in scaled units, n points."""
    dx, dy = (F.col("xb") - F.col("xa")).cast("double"), (F.col("yb") - F.col("ya")).cast("double")
    return edge_table.groupBy(*RING).agg(F.sum(cross_product()).alias("twice"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter"), F.count(F.lit(1)).alias("n")).select(*RING, (F.abs("twice") / 2).alias("area"), (F.col("twice") / 2).alias("signed_area"), "perimeter", "n")


def stripe_counts(edge_table: DataFrame) -> DataFrame:
    m = area_perimeter(edge_table)
    return m.select(*RING, "n", G.stripe_count(F.col("n"), F.col("area"), F.col("perimeter")).alias("stripes"))


def normalise_windings(rings: DataFrame) -> DataFrame:
    """Exteriors counter-clockwise, holes clockwise."""
    signed = area_perimeter(edges(rings)).select(*RING, "signed_area")
    wrong = F.when(F.col("hole_idx") < 0, F.col("signed_area") < 0).otherwise(F.col("signed_area") > 0)
    return rings.join(spread(signed), RING, "left").withColumn("pts", F.when(wrong, F.reverse("pts")).otherwise(F.col("pts"))).select(rings.columns)


def _orientation(ax: str, ay: str, bx: str, by_: str, cx: str, cy: str) -> Column:
    value = f"cast({bx} - {ax} as double) * ({cy} - {ay}) - cast({by_} - {ay} as double) * ({cx} - {ax})"
    return F.expr(f"sign({value})")


def self_intersections(edge_table: DataFrame) -> DataFrame:
    """Pairs of edges of a ring, not neighbours, that touch or cross.

    Edges meet in the cells that their boxes reach; a ring's cells are four of its mean edges wide, so that a long
    coast's edges meet few others (and a 64th of its longest at least, so that this one does not reach too many)."""
    extent = F.greatest(F.abs(F.col("xb") - F.col("xa")), F.abs(F.col("yb") - F.col("ya")))
    n = edge_table.groupBy(*RING).agg(F.count(F.lit(1)).cast("int").alias("n"), F.greatest(F.lit(1).cast("long"), F.ceil(4 * F.avg(extent)), F.ceil(F.max(extent) / 64)).alias("cell"))
    sized = edge_table.join(spread(n.select(*RING, "cell")), RING)
    n = n.drop("cell")
    place = lambda f, a, b: F.floor(f(F.col(a), F.col(b)) / F.col("cell"))
    cells = sized.select(*RING, "edge_idx", "xa", "ya", "xb", "yb", F.explode(F.sequence(place(F.least, "xa", "xb"), place(F.greatest, "xa", "xb"))).alias("cx"), place(F.least, "ya", "yb").alias("y0"), place(F.greatest, "ya", "yb").alias("y1"))
    cells = cells.withColumn("cy", F.explode(F.sequence("y0", "y1"))).drop("y0", "y1")
    a = cells
    b = cells.select(*RING, "cx", "cy", F.col("edge_idx").alias("j"), F.col("xa").alias("xc"), F.col("ya").alias("yc"), F.col("xb").alias("xd"), F.col("yb").alias("yd"))
    pairs = a.join(spread(b), [*RING, "cx", "cy"]).where(F.col("edge_idx") < F.col("j")).join(spread(n), RING)
    apart = (F.col("j") - F.col("edge_idx") > 1) & ~((F.col("edge_idx") == 0) & (F.col("j") == F.col("n") - 1))
    o1, o2 = _orientation("xa", "ya", "xb", "yb", "xc", "yc"), _orientation("xa", "ya", "xb", "yb", "xd", "yd")
    o3, o4 = _orientation("xc", "yc", "xd", "yd", "xa", "ya"), _orientation("xc", "yc", "xd", "yd", "xb", "yb")
    proper = (o1 != o2) & (o3 != o4)
    touch = F.expr("(least(xa, xb) <= greatest(xc, xd)) and (least(xc, xd) <= greatest(xa, xb)) and (least(ya, yb) <= greatest(yc, yd)) and (least(yc, yd) <= greatest(ya, yb))")
    collinear = (o1 == 0) & (o2 == 0) & touch
    return pairs.where(apart & touch & (proper | collinear)).select(*RING, F.col("edge_idx").alias("i"), "j").distinct()
