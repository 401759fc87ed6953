"""Zone lookup: exact (one index row a cell and stripe), by tiles, and layered.

The exact index is a table of one row for each one-degree cell and stripe of latitude in it, as many
stripes as the cell has edges to spread.  A row holds the candidate zones with their rings: the edges that reach the
stripe inside the cell, and, for all edges wholly to the right of the cell, only the heights at which
the parity of their crossings changes (along a border that goes on up they cancel, so they are few).
Edges to the left never count.  A lookup is two joins on the cell: points are not shuffled, and the even-odd rule and the
border test are evaluated inside the joined row.

Index tables are built once, written to a checkpoint and measured: up to ``broadcast_bytes`` they are
broadcast; beyond, they are repeated ``SALTS`` times and joined by shuffle, so that a crowded cell is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..stages import settled, spread
from . import near
from . import rings as R

BAND = 100_000  # a degree of latitude
EDGES_A_STRIPE, MAX_STRIPES = 8, 256
BROADCAST_BYTES = 256 << 20
SALTS = 16
CELL = ["cell_lng", "cell_lat"]


def build_grid(edge_table: DataFrame) -> DataFrame:
    """cell_lng, cell_lat, tz_idx, n_cand: the cells that each zone's box reaches."""
    return grid_of(R.bounds(edge_table.where("hole_idx < 0"), "tz_idx"))


def grid_of(box: DataFrame) -> DataFrame:
    """The grid of zones' boxes (tz_idx, min_x, min_y, max_x, max_y)."""
    x = F.explode(F.sequence(G.cell(F.col("min_x")), G.cell(F.col("max_x"))))
    cells = box.select("tz_idx", x.alias("cell_lng"), "min_y", "max_y").withColumn("cell_lat", F.explode(F.sequence(G.cell(F.col("min_y")), G.cell(F.col("max_y")))))
    cells = cells.select("cell_lng", "cell_lat", "tz_idx")
    counts = cells.groupBy("cell_lng", "cell_lat").agg(F.count(F.lit(1)).alias("n_cand"))
    return cells.join(spread(counts), ["cell_lng", "cell_lat"])


def grid_lists(grid: DataFrame) -> DataFrame:
    """The serving form: a sorted candidate list for each cell."""
    return grid.groupBy("cell_lng", "cell_lat").agg(F.array_sort(F.collect_list("tz_idx")).alias("tz_indices"))


def banded(edge_table: DataFrame) -> DataFrame:
    """Edges once for each latitude band that they reach."""
    lo, hi = F.floor(F.least("ya", "yb") / BAND).cast("int"), F.floor(F.greatest("ya", "yb") / BAND).cast("int")
    return edge_table.withColumn("band", F.explode(F.sequence(lo, hi)))


def cell_edges(edge_table: DataFrame) -> DataFrame:
    """Edges once for each cell that their box reaches."""
    across = F.explode(F.sequence(G.cell(F.least("xa", "xb")), G.cell(F.greatest("xa", "xb"))))
    up = F.explode(F.sequence(G.cell(F.least("ya", "yb")), G.cell(F.greatest("ya", "yb"))))
    return edge_table.withColumn("cell_lng", across).withColumn("cell_lat", up)


def right_turns(edge_table: DataFrame) -> DataFrame:
    """cell, ring, turns: heights in the cell's row at which the parity of crossings with the ring's edges right of the cell changes."""
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    rows = edge_table.where("ya <> yb").withColumn("cell_lat", F.explode(F.sequence(G.cell(low), G.cell(high))))
    floor = F.col("cell_lat").cast("long") * BAND
    ends = F.filter(F.array(F.greatest(low, floor), F.when(high < floor + BAND, high)), lambda y: y.isNotNull() & (y < floor + BAND))
    at = rows.select(*R.RING, "cell_lat", G.cell(F.least("xa", "xb")).alias("upto"), F.explode(ends).alias("y"))
    odd = at.groupBy(*R.RING, "cell_lat", "upto", "y").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")  # a border that goes on up cancels here
    first = edge_table.groupBy(*R.RING).agg(G.cell(F.min("xa")).alias("first"))
    left = odd.join(spread(first), R.RING).where("first < upto").withColumn("cell_lng", F.explode(F.sequence(F.col("first"), F.col("upto") - 1)))
    left = left.groupBy(*CELL, *R.RING, "y").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return left.groupBy(*CELL, *R.RING).agg(F.array_sort(F.collect_list("y")).alias("turns"))


def stripe_in_cell(y: Column, n: Column) -> Column:
    """Stripe of a height in its row of cells, clamped to the cell's n stripes."""
    place = y - F.col("cell_lat").cast("long") * BAND
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.floor(place * n / F.lit(float(BAND)))))


def build_index(zones: DataFrame, edge_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, stripes): n_cand, lone zone and number of stripes of each cell; the zones with their rings of each stripe."""
    own = cell_edges(edge_table)
    count = own.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_edges"))
    grid = build_grid(edge_table).join(spread(zones.select("tz_idx", "name")), "tz_idx").groupBy(*CELL).agg(F.min("n_cand").alias("n_cand"), F.min(F.struct("tz_idx", "name")).alias("lone"))
    n = F.least(F.lit(MAX_STRIPES), F.greatest(F.lit(1), F.ceil(F.coalesce("n_edges", F.lit(0)) / EDGES_A_STRIPE))).cast("long")
    cells = settled(grid.join(spread(count), CELL, "left").select(*CELL, "n_cand", "lone", n.alias("n_stripes")))
    numbered = own.join(spread(cells.select(*CELL, "n_stripes")), CELL)
    floor = F.col("cell_lat").cast("long") * BAND
    lo, hi = F.greatest(F.least("ya", "yb"), floor), F.least(F.greatest("ya", "yb"), floor + BAND - 1)
    each = numbered.withColumn("stripe", F.explode(F.sequence(stripe_in_cell(lo, F.col("n_stripes")), stripe_in_cell(hi, F.col("n_stripes")))))
    striped = each.groupBy(*CELL, "stripe", *R.RING).agg(F.collect_list(F.struct("xa", "ya", "xb", "yb")).alias("edges"))
    turns = right_turns(edge_table).join(spread(cells.select(*CELL, "n_stripes")), CELL)
    # Below a stripe only the parity of a ring's turns counts, above it none: it stands in the stripes where its parity is odd or changes.
    base = floor + F.ceil(F.col("stripe") * F.lit(BAND) / F.col("n_stripes")).cast("long")
    below, inner = F.filter("turns", lambda y: y <= base), F.filter("turns", lambda y: (y > base) & (stripe_in_cell(y, F.col("n_stripes")) <= F.col("stripe")))
    start = F.when(F.size(below) % 2 == 1, F.array(base)).otherwise(F.array().cast("array<bigint>"))
    everywhere = turns.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_stripes") - 1))).select(*CELL, "stripe", *R.RING, F.concat(start, inner).alias("turns")).where(F.size("turns") > 0)
    none = F.array().cast("array<struct<xa:bigint,ya:bigint,xb:bigint,yb:bigint>>")
    ring = F.struct("poly_idx", "hole_idx", F.coalesce("turns", F.array().cast("array<bigint>")).alias("turns"), F.coalesce("edges", none).alias("edges"))
    rings = everywhere.join(spread(striped), [*CELL, "stripe", *R.RING], "full").groupBy(*CELL, "stripe", "tz_idx").agg(F.array_sort(F.collect_list(ring)).alias("rings"))
    named = rings.join(spread(zones.select("tz_idx", "name")), "tz_idx")
    stripes = named.groupBy(*CELL, "stripe").agg(F.array_sort(F.collect_list(F.struct("tz_idx", "name", "rings"))).alias("zones"))
    return cells, settled(stripes)


def _ring_state(ring: Column) -> Column:
    """on, odd of a point px, py against one ring of a stripe."""
    names = {f"{c}": F.col(c) for c in ("px", "py")}
    edge = lambda e: {**names, **{c: e[c] for c in ("xa", "ya", "xb", "yb")}}
    start = F.struct(F.lit(False).alias("on"), F.size(F.filter(ring["turns"], lambda y: y <= F.col("py"))).alias("crossed"))
    return F.aggregate(ring["edges"], start, lambda a, e: F.struct((a["on"] | G.on_edge(**edge(e))).alias("on"), (a["crossed"] + G.crossing(**edge(e))).alias("crossed")))


def zone_contains(rings: Column, allow_edge: bool) -> Column:
    """Whether some polygon of the zone holds the point: inside its exterior and strictly inside none of its holes."""
    states = F.transform(rings, lambda r: F.struct(r["poly_idx"].alias("poly"), r["hole_idx"].alias("hole"), _ring_state(r).alias("s")))

    def held(all_rings: Column) -> Column:
        def outer(r: Column) -> Column:
            filled = F.exists(all_rings, lambda h: (h["poly"] == r["poly"]) & (h["hole"] >= 0) & G.contains(h["s"]["on"], h["s"]["crossed"], False))
            return (r["hole"] < 0) & G.contains(r["s"]["on"], r["s"]["crossed"], allow_edge) & ~filled

        return F.exists(all_rings, outer)

    return G.bound(states, held)


def _joined(points: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Left join of points with an index table: broadcast if it is small, else shuffled by keys and a salt."""
    if small:
        return points.join(F.broadcast(table), keys, "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = points.withColumn("salt", F.pmod(F.xxhash64("px", "py"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*keys, "salt"], "left").drop("salt")


@dataclass
class ZoneFinder:
    """Exact lookup over zones (tz_idx, name) and their edges."""

    zones: DataFrame
    edges: DataFrame
    version: str = ""
    use_grid: bool = True
    broadcast_bytes: int = BROADCAST_BYTES

    def __post_init__(self) -> None:
        self._cells, self._stripes = build_index(self.zones, self.edges)
        size = self._stripes.agg(F.sum(F.aggregate("zones", F.lit(40), lambda a, z: a + 40 + F.aggregate(z["rings"], F.lit(0), lambda b, r: b + 40 + 8 * F.size(r["turns"]) + 40 * F.size(r["edges"])))).alias("b")).first()["b"] or 0
        self._small = size + 64 * self._cells.count() <= self.broadcast_bytes

    @classmethod
    def from_rings(cls, rings: DataFrame, version: str = "", use_grid: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> ZoneFinder:
        return cls(rings.select("tz_idx", "name").distinct(), R.edges(rings), version, use_grid, broadcast_bytes)

    def timezone_names(self) -> DataFrame:
        return self.zones.select("tz_idx", "name").orderBy("tz_idx")

    def data_version(self) -> str:
        return self.version

    def _sure(self) -> Column:
        """Whether a point needs no test: its cell has one candidate only, away from the domain's rim."""
        if not self.use_grid:
            return F.lit(False)
        return (F.col("n_cand") == 1) & F.col("px").between(-17_899_999, 17_899_999) & F.col("py").between(-8_899_999, 8_899_999)

    def met(self, points: DataFrame, where: Column | None = None, strict: bool = True) -> DataFrame:
        """points (px, py among their columns) with n_cand, lone and the zones of their stripe.

        where: only these meet the index; unless strict, points that need no test meet no stripe."""
        here = F.lit(True) if where is None else where
        celled = points.withColumns({"cell_lng": F.when(here, G.cell(F.col("px"))), "cell_lat": F.when(here, G.cell(F.col("py")))})
        stripe = stripe_in_cell(F.col("py"), F.col("n_stripes"))
        numbered = _joined(celled, self._cells, CELL, self._small).withColumn("stripe", stripe if strict else F.when(~self._sure(), stripe))
        return _joined(numbered, self._stripes, [*CELL, "stripe"], self._small).drop(*CELL, "stripe", "n_stripes")

    @staticmethod
    def hits(allow_edge: bool = True) -> Column:
        """The zones of a met row that hold its point, by index."""
        return F.filter("zones", lambda z: zone_contains(z["rings"], allow_edge))

    def first_name(self, strict: bool = False, allow_edge: bool = True) -> Column:
        """Name, for met rows, of the containing zone with the lowest index, or null; unless strict, sure points take their cell's zone."""
        tested = F.get(self.hits(allow_edge), F.lit(0))["name"]
        return tested if strict else F.when(self._sure(), F.col("lone")["name"]).otherwise(tested)

    def first(self, points: DataFrame, strict: bool = False, allow_edge: bool = True) -> DataFrame:
        """pt_id, name of the containing zone with the lowest index, or null; one row a point."""
        return self.met(points, strict=strict).select("pt_id", self.first_name(strict, allow_edge).alias("name"))

    def all(self, points: DataFrame, allow_edge: bool = True) -> DataFrame:
        """pt_id, names (sorted) of all containing zones; an empty list where there is none."""
        names = F.array_sort(F.transform(self.hits(allow_edge), lambda z: z["name"]))
        return self.met(points).select("pt_id", F.coalesce(names, F.array().cast("array<string>")).alias("names"))

    def matches(self, points: DataFrame, allow_edge: bool = False) -> DataFrame:
        """pt_id, tz_idx of all containing zones, one row each (strict unless asked): any value can be joined on."""
        return self.met(points).select("pt_id", F.explode(F.transform(self.hits(allow_edge), lambda z: z["tz_idx"])).alias("tz_idx"))

    def geojson(self, rings: DataFrame, name: str | None = None) -> DataFrame:
        """One row: the FeatureCollection of the zones of a name (of all without one); an unknown name raises."""
        from ..sources.geojson import feature_collection

        return feature_collection(rings.join(self.zones.select("tz_idx"), "tz_idx", "left_semi"), name)


@dataclass
class FuzzyFinder:
    """Approximate lookup over tiles (name, x, y, z, key_ord, packed)."""

    tiles: DataFrame
    agg_zoom: int
    idx_zoom: int
    version: str = ""
    broadcast_rows: int = 2_000_000

    def __post_init__(self) -> None:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("key_ord", "name"))), lambda t: t["name"])
        self._lists = settled(self.tiles.groupBy("packed").agg(ordered.alias("names")))
        self._small = self._lists.count() <= self.broadcast_rows
        self._zooms = sorted(r[0] for r in self._lists.select(F.shiftright("packed", 56).alias("z")).distinct().collect())  # at most 29

    def met(self, points: DataFrame) -> DataFrame:
        """points (px, py among their columns) with tile_names: the names at the first zoom that hits, in key order, or null."""
        finest = F.lit(self.idx_zoom)
        at = points.withColumns({"fx": G.tile_x(F.col("px") / 100_000.0, finest), "fy": G.tile_y(F.col("py") / 100_000.0, finest)})
        zooms = [z for z in self._zooms if self.agg_zoom <= z <= self.idx_zoom]
        for z in zooms:  # one join a zoom level, without a shuffle of the points
            up = float(1 << self.idx_zoom - z)
            own = self._lists.where(F.shiftright("packed", 56) == z).select(F.col("packed").alias("tile"), F.col("names").alias(f"names_{z}"))
            at = at.withColumn("tile", G.pack_tile(F.floor(F.col("fx") / up), F.floor(F.col("fy") / up), F.lit(z)))
            at = _joined(at, own, ["tile"], self._small).drop("tile")
        names = F.coalesce(*[F.col(f"names_{z}") for z in zooms], F.lit(None).cast("array<string>"))
        return at.select(*points.columns, names.alias("tile_names"))

    def first(self, points: DataFrame) -> DataFrame:
        return self.met(points).select("pt_id", F.get("tile_names", F.lit(0)).alias("name"))

    def all(self, points: DataFrame) -> DataFrame:
        """The names at the first zoom that hits, in key order."""
        return self.met(points).select("pt_id", F.coalesce("tile_names", F.array().cast("array<string>")).alias("names"))

    def timezone_names(self) -> DataFrame:
        return self.tiles.select("name").distinct().orderBy("name")

    def data_version(self) -> str:
        return self.version

    def geojson(self, name: str | None = None) -> DataFrame:
        """name, feature: a MultiPolygon of the tiles of each zone (of one name, if given; an unknown name raises)."""
        from .tiles import zone_features

        drawn = zone_features(self.tiles if name is None else self.tiles.where(F.col("name") == name))
        if name is not None and not drawn.limit(1).count():
            raise ValueError(f"no timezone found: {name}")
        return drawn


@dataclass
class DefaultFinder:
    """Tiles first; only what they miss meets the exact finder's index, in the same pass."""

    fuzzy: FuzzyFinder
    exact: ZoneFinder

    def __post_init__(self) -> None:
        if self.fuzzy.version != self.exact.version:
            raise ValueError(f"data versions differ: {self.fuzzy.version!r} and {self.exact.version!r}")

    def first(self, points: DataFrame) -> DataFrame:
        tiled = self.fuzzy.met(points).withColumn("tile_name", F.get("tile_names", F.lit(0)))
        both = self.exact.met(tiled, F.col("tile_name").isNull(), strict=False)
        return both.select("pt_id", F.coalesce("tile_name", self.exact.first_name()).alias("name"))

    def all(self, points: DataFrame) -> DataFrame:
        return self.exact.all(points)

    def timezone_names(self) -> DataFrame:
        return self.exact.timezone_names()

    def data_version(self) -> str:
        return self.exact.version

    def geojson(self, rings: DataFrame, name: str | None = None) -> DataFrame:
        return self.exact.geojson(rings, name)


def parity(a: DataFrame, b: DataFrame, column: str = "name", limit: int = 20) -> tuple[int, DataFrame]:
    """How many points two finders judge differently, and some of them."""
    both = a.select("pt_id", F.col(column).alias("a")).join(b.select("pt_id", F.col(column).alias("b")), "pt_id", "full").where("not (a <=> b)")
    return both.count(), both.orderBy("pt_id").limit(limit)


#: Units (1e-5 degree) within which rounding to 32 bits may move a border: half a step of a float32 beyond 128 degrees, and the grid's own.
ROUNDING = 2


def float_first(points: DataFrame, rings: DataFrame) -> DataFrame:
    """pt_id, name by a second path that shares nothing with the index: edges in degrees of 32 bits and a textbook ray test in doubles.
    A reference for parity, not a serving path.

    A point meets the rings whose box (widened by what rounding may move) holds it, and of a ring the edges of one band: four of
    the ring's mean edges high (a 64th of its highest at least)."""
    names = rings.select("tz_idx", "name").distinct()
    e = R.edges(rings)
    height = F.abs(F.col("yb") - F.col("ya"))
    step = F.greatest(F.lit(1).cast("long"), F.ceil(4 * F.avg(height)), F.ceil(F.max(height) / 64)).alias("step")
    box = settled(e.groupBy(*R.RING).agg((F.min("xa") - ROUNDING).alias("x0"), (F.min("ya") - ROUNDING).alias("y0"), (F.max("xa") + ROUNDING).alias("x1"), (F.max("ya") + ROUNDING).alias("y1"), step))
    cells = near.placed(box, *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    at = near.meeting(points.select("pt_id", "px", "py"), F.col("px"), F.col("py"), cells).where("px between x0 and x1 and py between y0 and y1")
    at = at.select("pt_id", "px", "py", *R.RING, F.floor(F.col("py") / F.col("step")).alias("band"))
    low, high = F.floor((F.least("ya", "yb") - ROUNDING) / F.col("step")), F.floor((F.greatest("ya", "yb") + ROUNDING) / F.col("step"))
    degrees = {c: (F.col(c) / 100_000.0).cast("float").cast("double") for c in ("xa", "ya", "xb", "yb")}
    edge_table = e.join(spread(box.select(*R.RING, "step")), R.RING).withColumn("band", F.explode(F.sequence(low, high))).withColumns(degrees).drop("step", "edge_idx")
    met = at.join(spread(edge_table), [*R.RING, "band"]).withColumns({"lng": F.col("px") / 100_000.0, "lat": F.col("py") / 100_000.0}).where("lat between least(ya, yb) and greatest(ya, yb)")
    on = F.expr("(xb - xa) * (lat - ya) = (yb - ya) * (lng - xa) and lng between least(xa, xb) and greatest(xa, xb)")
    crossed = F.expr("case when (ya > lat) <> (yb > lat) and lng < (xb - xa) * (lat - ya) / (yb - ya) + xa then 1 else 0 end")
    by_ring = met.groupBy("pt_id", *R.RING).agg(F.max(on).alias("on"), (F.sum(crossed) % 2 == 1).alias("odd"))
    outer, hole = (F.col("hole_idx") < 0) & (F.col("on") | F.col("odd")), (F.col("hole_idx") >= 0) & ~F.col("on") & F.col("odd")
    held = by_ring.groupBy("pt_id", "tz_idx", "poly_idx").agg(F.bool_or(outer).alias("o"), F.bool_or(hole).alias("h")).where("o and not h")
    first = held.groupBy("pt_id").agg(F.min("tz_idx").alias("tz_idx")).join(spread(names), "tz_idx")
    return points.select("pt_id").join(spread(first.select("pt_id", "name")), "pt_id", "left")


def unexplained(points: DataFrame, edge_table: DataFrame, reach: int = ROUNDING) -> DataFrame:
    """Points (pt_id, px, py) that no edge comes within reach of: edges and points meet in cells of the edges' size, a degree at most."""
    near_ = f"py between least(ya, yb) - {reach} and greatest(ya, yb) + {reach} and px between least(xa, xb) - {reach} and greatest(xa, xb) + {reach} and abs(cast(xb - xa as double) * (py - ya) - cast(yb - ya as double) * (px - xa)) <= {reach} * sqrt(pow(xb - xa, 2) + pow(yb - ya, 2))"
    cells = near.placed(edge_table, F.least("xa", "xb") - reach, F.least("ya", "yb") - reach, F.greatest("xa", "xb") + reach, F.greatest("ya", "yb") + reach, BAND)
    close = near.meeting(points.select("pt_id", "px", "py"), F.col("px"), F.col("py"), cells).where(near_).select("pt_id").distinct()
    return points.join(spread(close), "pt_id", "left_anti")
