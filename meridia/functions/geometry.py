"""Column expressions for planar geometry, map tiles and codecs' scalars.

Coordinates are BIGINT in units of 1e-5 degree; divisions are done in DOUBLE.  Nothing here is a
Python UDF: every function returns a SQL text or a Column that Catalyst compiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100_000
TOLERANCE = 1e-6
MIN_STRIPES = 32
MERCATOR_LIMIT = 85.05112878
MAX_ZOOM = 28


def on_edge_sql(px: str = "px", py: str = "py", xa: str = "xa", ya: str = "ya", xb: str = "xb", yb: str = "yb") -> str:
    """Does the point lie on the edge?"""
    return f"""(CASE WHEN {ya} = {yb} THEN {py} = {ya} AND {px} BETWEEN least({xa}, {xb}) AND greatest({xa}, {xb})
      WHEN {xa} = {xb} THEN {px} = {xa} AND {py} BETWEEN least({ya}, {yb}) AND greatest({ya}, {yb})
      WHEN {py} BETWEEN least({ya}, {yb}) AND greatest({ya}, {yb})
        THEN cast({px} - {xa} as double) / cast({xb} - {xa} as double) = cast({py} - {ya} as double) / cast({yb} - {ya} as double)
      ELSE false END)"""


def crossing_sql(px: str = "px", py: str = "py", xa: str = "xa", ya: str = "ya", xb: str = "xb", yb: str = "yb") -> str:
    """1 if a ray to the right of the point crosses the edge (half-open in y), else 0."""
    return f"""(CASE WHEN {ya} = {yb} OR {py} < least({ya}, {yb}) OR {py} >= greatest({ya}, {yb}) THEN 0
      WHEN {px} >= greatest({xa}, {xb}) THEN 0
      WHEN {px} <= least({xa}, {xb}) THEN 1
      WHEN {ya} < {yb} THEN CASE WHEN cast({py} - {ya} as double) / cast({px} - {xa} as double) >= cast({yb} - {ya} as double) / cast({xb} - {xa} as double) THEN 1 ELSE 0 END
      ELSE CASE WHEN cast({py} - {yb} as double) / cast({px} - {xb} as double) >= cast({ya} - {yb} as double) / cast({xa} - {xb} as double) THEN 1 ELSE 0 END END)"""


def _points(given: dict[str, Column]) -> dict[str, Column]:
    return {c: given.get(c, F.col(c)) for c in ("px", "py", "xa", "ya", "xb", "yb")}


def on_edge(**given: Column) -> Column:
    """on_edge_sql of the columns px, py, xa, ya, xb, yb, or of those given: also inside arrays."""
    p = _points(given)
    low, high = p["py"] >= F.least(p["ya"], p["yb"]), p["py"] <= F.greatest(p["ya"], p["yb"])
    between_x = (p["px"] >= F.least(p["xa"], p["xb"])) & (p["px"] <= F.greatest(p["xa"], p["xb"]))
    slope = (p["px"] - p["xa"]).cast("double") / (p["xb"] - p["xa"]).cast("double") == (p["py"] - p["ya"]).cast("double") / (p["yb"] - p["ya"]).cast("double")
    straight = F.when(p["ya"] == p["yb"], between_x).when(p["xa"] == p["xb"], p["px"] == p["xa"]).otherwise(slope)
    return F.when(low & high, straight).otherwise(F.lit(False))


def crossing(**given: Column) -> Column:
    """crossing_sql of the columns, or of those given."""
    p = _points(given)
    rising = p["ya"] < p["yb"]
    x0, y0, x1, y1 = (F.when(rising, p[a]).otherwise(p[b]) for a, b in (("xa", "xb"), ("ya", "yb"), ("xb", "xa"), ("yb", "ya")))
    left = (p["py"] - y0).cast("double") / (p["px"] - x0).cast("double") >= (y1 - y0).cast("double") / (x1 - x0).cast("double")
    inner = F.when(p["px"] <= F.least(p["xa"], p["xb"]), F.lit(1)).when(left, F.lit(1)).otherwise(F.lit(0))
    out = (p["py"] < F.least(p["ya"], p["yb"])) | (p["py"] >= F.greatest(p["ya"], p["yb"])) | (p["px"] >= F.greatest(p["xa"], p["xb"]))
    return F.when(out, F.lit(0)).otherwise(inner)


def contains(on: Column, crossings: Column, allow_edge: bool) -> Column:
    """Even-odd rule; standing on the ring overrides it."""
    return F.when(on, F.lit(allow_edge)).otherwise(crossings % 2 == 1)


def cell(coordinate: Column) -> Column:
    """One-degree grid cell of a scaled coordinate."""
    return F.floor(coordinate / F.lit(float(SCALE))).cast("int")


def scaled(degrees: Column) -> Column:
    """Degrees to 1e-5 units, rounded half away from zero."""
    return F.round(degrees.cast("double") * SCALE).cast("long")


def in_domain(lng: Column, lat: Column) -> Column:
    return lng.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def round_half_away(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))


def almost_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) < tolerance


def same_point(ax: Column, ay: Column, bx: Column, by_: Column) -> Column:
    return almost_equal(ax, bx) & almost_equal(ay, by_)


def segment_bounds(xa: Column, ya: Column, xb: Column, yb: Column, pad: float = TOLERANCE) -> tuple[Column, Column, Column, Column]:
    return F.least(xa, xb) - pad, F.least(ya, yb) - pad, F.greatest(xa, xb) + pad, F.greatest(ya, yb) + pad


def point_bounds(x: Column, y: Column, pad: float = TOLERANCE) -> tuple[Column, Column, Column, Column]:
    return x - pad, y - pad, x + pad, y + pad


# Map tiles


def tile_x(lng: Column, zoom: Column) -> Column:
    """Column of the slippy-map tile; null outside the domain."""
    x = F.floor((lng / 360.0 + 0.5) * F.pow(F.lit(2.0), zoom)).cast("long")
    return F.when(lng.between(-180.0, 180.0), x)


def tile_y(lat: Column, zoom: Column) -> Column:
    """Row of the slippy-map tile; latitudes beyond the projection's limit are clamped."""
    s = F.sin(F.radians(F.greatest(F.lit(-MERCATOR_LIMIT), F.least(F.lit(MERCATOR_LIMIT), lat))))
    y = F.floor((F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * F.pow(F.lit(2.0), zoom)).cast("long")
    rows = F.pow(F.lit(2.0), zoom).cast("long")
    return F.when(lat.between(-90.0, 90.0), F.greatest(F.lit(0).cast("long"), F.least(rows - 1, y)))


def pack_tile(x: Column, y: Column, z: Column) -> Column:
    """One BIGINT: z in the top byte, then 28 bits each of x and y."""
    return F.shiftleft(z.cast("long"), 56).bitwiseOR(F.shiftleft(x.cast("long"), 28)).bitwiseOR(y.cast("long"))


def unpack_tile(packed: Column) -> tuple[Column, Column, Column]:
    mask = F.lit((1 << 28) - 1)
    return F.shiftright(packed, 28).bitwiseAND(mask), packed.bitwiseAND(mask), F.shiftright(packed, 56)


def parent_tile(packed: Column, up: Column) -> Column:
    """The tile up levels above; 0 if there are not so many."""
    x, y, z = unpack_tile(packed)
    shifted = pack_tile(_shift(x, up), _shift(y, up), z - up)
    return F.when(up > z, F.lit(0).cast("long")).otherwise(shifted)


def _shift(value: Column, by_: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), by_)).cast("long")


def tile_lng(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def tile_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def tile_ring(x: Column, y: Column, z: Column) -> Column:
    """Five corners, closed: array of (lng, lat)."""
    west, east, north, south = tile_lng(x, z), tile_lng(x + 1, z), tile_lat(y, z), tile_lat(y + 1, z)

    def corner(a: Column, b: Column) -> Column:
        return F.struct(a.alias("lng"), b.alias("lat"))

    return F.array(corner(west, north), corner(east, north), corner(east, south), corner(west, south), corner(west, north))


# Y-stripes


def stripe_count(n: Column, area: Column, perimeter: Column) -> Column:
    """max(32, floor(n 4 pi A / P^2)); degenerate rings get the minimum."""
    score = F.floor(n * (4 * F.pi() * area / (perimeter * perimeter)))
    return F.when(perimeter > 0, F.greatest(F.lit(MIN_STRIPES).cast("long"), score.cast("long"))).otherwise(F.lit(MIN_STRIPES).cast("long"))


def stripe_of(y: Column, min_y: Column, max_y: Column, count: Column) -> Column:
    """Stripe of a height, clamped to the ring's stripes."""
    raw = F.floor((y - min_y) / F.greatest(max_y - min_y, F.lit(1)) * count).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(count - 1, raw))


# Rings as arrays of struct<x, y>


def bound(col: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of col with col computed once: a lambda variable holds it, where the optimizer may copy a repeated expression."""
    return F.element_at(F.transform(F.array(col), fn), 1)


def open_ring(ring: Column) -> Column:
    """Without the repeated last point."""

    def opened(r: Column) -> Column:
        closed = (F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1))
        return F.when(closed, F.slice(r, 1, F.size(r) - 1)).otherwise(r)

    return bound(ring, opened)


def close_ring(ring: Column) -> Column:
    return bound(open_ring(ring), lambda r: F.when(F.size(r) > 0, F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def rotate_ring(ring: Column, start: Column) -> Column:
    """The open ring from its start-th (0-based) point on."""
    return F.concat(F.slice(ring, start + 1, F.size(ring)), F.slice(ring, 1, start))
