"""Tile pre-index: cover, containment, edge dropping, merging, exclusion, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..stages import settled, spread
from . import near
from . import rings as R
from .finder import banded

MIN_EXTERIOR, MIN_HOLE, MIN_TILES = 10, 3, 9
#: Regions whose tiles are never indexed, as west, south, east, north in degrees.
EXCLUDED: list[tuple[float, float, float, float]] = [
    (12.339432952014505, 43.87602439370005, 12.557460275211781, 44.01647806102579),
    (12.38052725392916, 41.86113906106772, 12.51280768234605, 41.961248101954794),
    (34.21443172445592, 31.177539955925, 35.66363343657645, 32.72106191308954),
    (39.8, 42.3, 42.2, 43.7),
]


def exclusion_rings(spark: SparkSession, boxes: list[tuple[float, float, float, float]] | None = None) -> DataFrame:
    rows = []
    for k, (w, s, e, n) in enumerate(EXCLUDED if boxes is None else boxes):
        w, s, e, n = (round(v * 100_000) for v in (w, s, e, n))
        rows.append((k, f"excluded/{k}", 0, -1, [(w, s), (e, s), (e, n), (w, n)]))
    from ..schemas import RINGS

    return spark.createDataFrame(rows, RINGS)


def strictly_inside(points: DataFrame, edge_table: DataFrame, keys: list[str], zone: str | None = None) -> DataFrame:
    """keys, tz_idx, poly_idx of each polygon that strictly contains the point; points: keys, px, py (double).

    With zone, a key of the points, a point meets that zone's edges only; without one, the edges are those of a few regions."""
    band = F.floor(F.col("py") / 100_000).cast("int")
    left, right = points.withColumn("band", band), banded(edge_table)
    joined = left.join(F.broadcast(right), "band") if zone is None else left.join(spread(right.withColumn(zone, F.col("tz_idx"))), ["band", zone])
    met = joined.where("py between least(ya, yb) and greatest(ya, yb)")
    keys_ = ["band", *keys]  # a point has one band: grouped by it as well, what the join has dealt is not shuffled again
    by_ring = met.select(*keys_, *R.RING, G.on_edge().alias("on"), G.crossing().alias("cross")).groupBy(*keys_, *R.RING).agg(F.max("on").alias("on"), F.sum("cross").alias("cross"))
    inside = G.contains(F.col("on"), F.col("cross"), False)
    whole = by_ring.groupBy(*keys_, "tz_idx", "poly_idx").agg(F.bool_or(inside & (F.col("hole_idx") < 0)).alias("out"), F.bool_or(inside & (F.col("hole_idx") >= 0)).alias("hole"))
    return whole.where("out and not hole").select(*keys, "tz_idx", "poly_idx")


def containing_zones(rings: DataFrame) -> DataFrame:
    """outer_idx, inner_idx: zones whose exterior strictly contains all vertices of another zone's exterior (holes are left out here).

    Such a zone's box strictly contains the other's: only these pairs of zones meet, and of them only vertices and edges of one band.
    A band is four of the outer zone's mean edges high (a 64th of its highest at least)."""
    outer = rings.where("hole_idx < 0")
    e = R.edges(outer)
    height = F.abs(F.col("yb") - F.col("ya"))
    step = F.greatest(F.lit(1).cast("long"), F.ceil(4 * F.avg(height)), F.ceil(F.max(height) / 64)).alias("step")
    box = settled(e.groupBy("tz_idx").agg(F.min("xa").alias("x0"), F.min("ya").alias("y0"), F.max("xa").alias("x1"), F.max("ya").alias("y1"), F.count(F.lit(1)).alias("n"), step))
    inner = box.select(F.col("tz_idx").alias("t"), "n", *[F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")])
    cells = near.placed(box.drop("n"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    pairs = near.meeting(inner, F.col("ix0"), F.col("iy0"), cells).where("x0 < ix0 and y0 < iy0 and x1 > ix1 and y1 > iy1").select("t", "n", "tz_idx", "step")
    pts = R.vertices(outer).select(F.col("tz_idx").alias("t"), F.col("poly_idx").alias("p"), "pt_idx", F.col("x").alias("px"), F.col("y").alias("py"))
    banded_ = lambda y: F.floor(y / F.col("step"))
    asked = pts.join(spread(pairs), "t").withColumn("band", banded_(F.col("py")))
    tall = e.join(spread(box.select("tz_idx", "step")), "tz_idx").withColumn("band", F.explode(F.sequence(banded_(F.least("ya", "yb")), banded_(F.greatest("ya", "yb"))))).drop("step")
    met = asked.join(spread(tall), ["tz_idx", "band"]).where("py between least(ya, yb) and greatest(ya, yb)")
    key = ["t", "p", "pt_idx", "n", "tz_idx", "poly_idx"]
    by_polygon = met.groupBy(*key).agg(F.max(G.on_edge()).alias("on"), F.sum(G.crossing()).alias("cross")).where(G.contains(F.col("on"), F.col("cross"), False))
    inside = by_polygon.groupBy("t", "n", "tz_idx").agg(F.countDistinct("p", "pt_idx").alias("k"))
    return inside.where("k = n").select(F.col("tz_idx").alias("outer_idx"), F.col("t").alias("inner_idx"))


def exclusion_match(points: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Points (pt_id, px, py) strictly inside an excluded region."""
    return points.join(strictly_inside(points, edge_table, ["pt_id"]).select("pt_id").distinct(), "pt_id", "left_semi")


#: Units (1e-5 degree) by which a tile's rectangle is widened before edges are tested against it.
PAD = 0.01
POLYGON = ["tz_idx", "poly_idx"]


def _tile(x: Column, y: Column, z: Column) -> Column:
    """A tile with the rim of its padded rectangle: made inside explode(), so that it is computed once, however often it is used after."""
    west, east = G.tile_lng(x, z) * 100_000 - PAD, G.tile_lng(x + 1, z) * 100_000 + PAD
    north, south = G.tile_lat(y, z) * 100_000 + PAD, G.tile_lat(y + 1, z) * 100_000 - PAD
    return F.struct(x.alias("x"), y.alias("y"), west.alias("west"), east.alias("east"), north.alias("north"), south.alias("south"))


def edge_meets_tile(tile: Column) -> Column:
    """Whether the edge xa, ya, xb, yb meets the tile's closed rectangle: their boxes do, and its line parts the corners."""
    west, east, north, south = (tile[c] for c in ("west", "east", "north", "south"))
    boxes = (F.least("xa", "xb") <= east) & (F.greatest("xa", "xb") >= west) & (F.least("ya", "yb") <= north) & (F.greatest("ya", "yb") >= south)
    dx, dy = (F.col("xb") - F.col("xa")).cast("double"), (F.col("yb") - F.col("ya")).cast("double")
    sides = [dx * (b - F.col("ya")) - dy * (a - F.col("xa")) for a in (west, east) for b in (south, north)]
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _children(tiles: DataFrame) -> DataFrame:
    """Each tile's four children, in place of x and y."""
    four = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (0, 1) for b in (0, 1)]))
    return tiles.withColumn("__c", four).withColumns({"x": 2 * F.col("x") + F.col("__c.a"), "y": 2 * F.col("y") + F.col("__c.b")}).drop("__c")


def crossing_tiles(edge_table: DataFrame, zoom: int) -> DataFrame:
    """tz_idx, poly_idx, x, y: tiles of a zoom that an edge of the polygon meets.

    An edge goes through the rows of tiles that it reaches, and in each row through the columns between the places where it enters and
    leaves it: no box of a long edge is spelled out.  Nothing is shuffled until the tiles are made distinct."""
    z, n, edge = F.lit(zoom), (1 << zoom) - 1, ["xa", "ya", "xb", "yb"]
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")

    def reached(of: Column, by_: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n), of + by_)).cast("long")

    def column(x: Column) -> Column:
        return F.floor((x / 36_000_000.0 + 0.5) * 2.0**zoom)

    def row(y: Column) -> Column:
        return G.tile_y(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), y / 100_000.0)), z)

    def at(y: str) -> Column:  # the edge's longitude where it enters or leaves a row
        return F.col("xa") + (F.col(y) - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))

    # A tile more on every side than the edge's own: rounding at a tile's rim and the padding stay inside.
    rows = edge_table.select(*POLYGON, *edge, F.explode(F.sequence(reached(row(high), -1), reached(row(low), 1))).alias("y"))
    ends = F.struct(*[F.greatest(low, F.least(high, G.tile_lat(F.col("y") + k, z) * 100_000)).alias(e) for k, e in ((0, "yn"), (1, "ys"))])
    within = rows.select(*POLYGON, *edge, "y", F.explode(F.array(ends)).alias("r")).select(*POLYGON, *edge, "y", F.col("r.yn").alias("yn"), F.col("r.ys").alias("ys"))
    level = F.col("ya") == F.col("yb")
    west, east = (F.when(level, f("xa", "xb")).otherwise(f(at("yn"), at("ys"))) for f in (F.least, F.greatest))
    own = within.select(*POLYGON, *edge, "y", F.explode(F.sequence(reached(column(west), -1), reached(column(east), 1))).alias("x"))
    met = own.select(*POLYGON, *edge, F.explode(F.array(_tile(F.col("x"), F.col("y"), z))).alias("t")).where(edge_meets_tile(F.col("t")))
    return met.select(*POLYGON, "t.x", "t.y").distinct()


def cover(edge_table: DataFrame, zoom: int) -> DataFrame:
    """tz_idx, poly_idx, x, y, z, inside: tiles that cover each polygon, all different places.

    A tile that no edge meets is wholly inside or outside; only tiles that an edge meets are parted further.  So what comes are
    inside tiles of any zoom up to the given one, and (inside false) the tiles of that zoom on the border."""
    key = [*POLYGON, "x", "y"]
    crossed = {zoom: settled(crossing_tiles(edge_table, zoom))}
    for z in range(zoom - 1, -1, -1):  # a tile's ancestors are crossed as well; half as many a zoom
        crossed[z] = settled(crossed[z + 1].select(*POLYGON, F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).distinct())
    free = None
    for z in range(1, zoom + 1):
        own = _children(crossed[z - 1]).join(spread(crossed[z]), key, "left_anti").select(*key, F.lit(z).alias("z"))
        free = own if free is None else free.unionByName(own)
    border = crossed[zoom].select(*key, F.lit(zoom).alias("z"), F.lit(False).alias("inside"))
    if free is None:
        return border
    names = {k: f"t_{k}" for k in (*key, "z")}
    lng, lat = G.tile_lng(F.col("x") + 0.5, F.col("z")), G.tile_lat(F.col("y") + 0.5, F.col("z"))
    centres = free.withColumns({"px": lng * 100_000, "py": lat * 100_000}).withColumnsRenamed(names)
    held = strictly_inside(centres, edge_table, list(names.values()), "t_tz_idx").where("poly_idx = t_poly_idx")
    inside = held.select(*[F.col(n).alias(k) for k, n in names.items()], F.lit(True).alias("inside"))
    return inside.unionByName(border)


def at_zoom(tiles: DataFrame, zoom: int) -> DataFrame:
    """tz_idx, x, y, z: the tiles' descendants of one zoom."""
    n = F.pow(F.lit(2.0), F.lit(zoom) - F.col("z")).cast("long")
    wide = tiles.withColumn("__n", n).withColumn("x", F.explode(F.sequence(F.col("x") * F.col("__n"), (F.col("x") + 1) * F.col("__n") - 1)))
    full = wide.withColumn("y", F.explode(F.sequence(F.col("y") * F.col("__n"), (F.col("y") + 1) * F.col("__n") - 1)))
    return full.select("tz_idx", "x", "y", F.lit(zoom).alias("z"))


def _corners(tiles: DataFrame, names: list[str]) -> DataFrame:
    """The tiles' four corners as points px, py; tz_idx, x, y and z under the given names."""
    key = ["tz_idx", "x", "y", "z"]
    corners = tiles.select(*key, F.posexplode(F.slice(G.tile_ring(F.col("x"), F.col("y"), F.col("z")), 1, 4)).alias("corner", "c"))
    return corners.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], "corner", (F.col("c.lng") * 100_000).alias("px"), (F.col("c.lat") * 100_000).alias("py"))


def not_excluded(tiles: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Tiles (tz_idx, x, y, z; all different) no corner of which is strictly inside an excluded region."""
    if excluded is None:
        return tiles
    key, names = ["tz_idx", "x", "y", "z"], ["t_tz_idx", "t_x", "t_y", "t_z"]
    bad = strictly_inside(_corners(tiles, names), excluded, [*names, "corner"]).select(*[F.col(n).alias(k) for n, k in zip(names, key, strict=True)]).distinct()
    return tiles.join(spread(bad), key, "left_anti")


def ensure_inside(tiles: DataFrame, edge_table: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Tiles (tz_idx, x, y, z; all different) whose corners are all strictly inside one polygon of their zone, and in no excluded region.

    One corner is asked after another, opposite ones first: most tiles on a border fail soon."""
    key, names = ["tz_idx", "x", "y", "z"], ["t_tz_idx", "t_x", "t_y", "t_z"]
    left = tiles.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)])
    for corner, (dx, dy) in enumerate([(0, 0), (1, 1), (1, 0), (0, 1)]):
        asked = left.withColumns({"px": G.tile_lng(F.col("t_x") + dx, F.col("t_z")) * 100_000, "py": G.tile_lat(F.col("t_y") + dy, F.col("t_z")) * 100_000})
        found = strictly_inside(asked, edge_table, [*names, "t_poly_idx"] if corner else names, "t_tz_idx")
        left = (found.where("poly_idx = t_poly_idx") if corner else found).select(*names, F.col("poly_idx").alias("t_poly_idx"))
    return not_excluded(left.select(*[F.col(n).alias(k) for n, k in zip(names, key, strict=True)]).distinct(), excluded)


def drop_edge_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles whose eight neighbours are all in the zone's set; the world's rim has none beyond it."""
    key = ["tz_idx", "x", "y", "z"]
    steps = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    votes = tiles.select("tz_idx", "x", "y", "z", F.explode(steps).alias("s")).select("tz_idx", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "z")
    full = votes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n = 8").select(*key)
    return tiles.join(spread(full), key, "left_semi")


def merge_up(tiles: DataFrame, to_zoom: int, from_zoom: int) -> DataFrame:
    """Four siblings become their parent, zoom by zoom."""
    done, level = None, tiles
    for _ in range(from_zoom, to_zoom, -1):
        keyed = level.withColumns({"px": F.floor(F.col("x") / 2).cast("long"), "py": F.floor(F.col("y") / 2).cast("long")})
        parents = settled(keyed.groupBy("tz_idx", "px", "py", "z").agg(F.count(F.lit(1)).alias("n")).where("n = 4").drop("n"))  # used twice at each zoom
        left = keyed.join(spread(parents), ["tz_idx", "px", "py", "z"], "left_anti").select("tz_idx", "x", "y", "z")
        done = left if done is None else done.unionByName(left)
        level = parents.select("tz_idx", F.col("px").alias("x"), F.col("py").alias("y"), (F.col("z") - 1).alias("z"))
    return level if done is None else done.unionByName(level)


def index_zoom(rings: DataFrame, parts: int = 16) -> int:
    """The least zoom (4 at least) whose tiles are no wider than one of so many parts of the polygons' mean shorter side.

    With smaller zones the tiles are smaller: as many fit into a zone, however many zones there are."""
    box = R.bounds(R.edges(rings.where("hole_idx < 0")), *POLYGON)
    side = F.least(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    n, total = box.agg(F.count(F.lit(1)), F.sum(side)).first()
    if not total:
        return G.MAX_ZOOM
    return min(G.MAX_ZOOM, max(4, (-(-36_000_000 * parts * n // total) - 1).bit_length()))


def _indexed_zones(crossed: DataFrame, edge_table: DataFrame, zoom: int) -> DataFrame:
    """crossed without zones whose cover is under MIN_TILES tiles: only if the border's tiles are so few, those inside are counted."""
    few = settled(crossed.groupBy("tz_idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < MIN_TILES).select("tz_idx"))
    if few.isEmpty():
        return crossed
    places = F.sum(F.pow(F.lit(4.0), F.lit(zoom) - F.col("z")))
    covered = cover(edge_table.join(spread(few), "tz_idx", "left_semi"), zoom)
    less = covered.groupBy("tz_idx").agg(places.alias("n")).where(F.col("n") < MIN_TILES)
    return crossed.join(spread(less), "tz_idx", "left_anti")


def _barred(tiles: DataFrame, edge_table: DataFrame, zoom: int, excluded: DataFrame | None) -> DataFrame:
    """tz_idx, x, y: tiles outside a zone's set that touch it.  Such a tile is on the zone's border (tiles) or on an excluded region's."""
    barred = tiles.join(spread(ensure_inside(tiles, edge_table, excluded)), ["tz_idx", "x", "y"], "left_anti").select("tz_idx", "x", "y")
    if excluded is None:
        return barred
    rim = crossing_tiles(excluded, zoom).select("tz_idx", "x", "y", F.lit(zoom).alias("z")).distinct()
    rim = rim.join(spread(not_excluded(rim, excluded)), ["tz_idx", "x", "y"], "left_anti").select(F.col("tz_idx").alias("region"), "x", "y")
    zones = R.bounds(edge_table.where("hole_idx < 0"), "tz_idx")
    regions = R.bounds(excluded, "tz_idx").select(F.col("tz_idx").alias("region"), *[F.col(c).alias(f"r_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    met = zones.crossJoin(F.broadcast(regions)).where("min_x <= r_max_x and r_min_x <= max_x and min_y <= r_max_y and r_min_y <= max_y")
    return barred.unionByName(met.select("tz_idx", "region").join(spread(rim), "region").select("tz_idx", "x", "y"))


def _world_rim(edge_table: DataFrame, zoom: int, up: int, layers: int) -> DataFrame:
    """tz_idx, x, y: the world's outermost layers of tiles of a zoom where zones reach them, as tiles of the zoom up levels above."""
    n = 1 << zoom
    box, z = R.bounds(edge_table.where("hole_idx < 0"), "tz_idx"), F.lit(zoom)
    across = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) / 36_000_000.0 + 0.5) * n) + by_)).cast("long") for c, by_ in (("min_x", -1), ("max_x", 1))]
    down = [F.greatest(F.lit(0), F.least(F.lit(n - 1), G.tile_y(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col(c) / 100_000.0)), z) + by_)).cast("long") for c, by_ in (("max_y", -1), ("min_y", 1))]
    found = None
    for along, over in (("y", across), ("x", down)):  # the outer rows over the zone's columns, and the outer columns over its rows
        low, high = down if along == "y" else across
        other = "x" if along == "y" else "y"
        for reached, first, last in ((low < layers, 0, layers - 1), (high >= n - layers, n - layers, n - 1)):
            at = box.where(reached).withColumn(other, F.explode(F.sequence(F.shiftright(over[0], up), F.shiftright(over[1], up))))
            at = at.withColumn(along, F.explode(F.sequence(F.lit(max(0, first) >> up).cast("long"), F.lit(min(n - 1, last) >> up).cast("long")))).select("tz_idx", "x", "y")
            found = at if found is None else found.unionByName(at)
    return found


def _free_of(marked: DataFrame, zoom: int) -> DataFrame:
    """tz_idx, x, y, z, mask: for each zoom from 1 to the given one, the parents x, y of children of zoom z without marked tiles in
    them, where others have some (mask, a bit a child).  marked: tz_idx, x, y, tiles of the zoom, repeats allowed."""
    child = (F.col("y") % 2 * 2 + F.col("x") % 2).cast("int")
    level, free = marked, None
    for z in range(zoom, 0, -1):
        bit = F.expr("shiftleft(1, __child)")
        parents = level.select("tz_idx", child.alias("__child"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
        parents = settled(parents.groupBy("tz_idx", "x", "y").agg(F.bit_or(bit).alias("mask")))
        own = parents.where("mask < 15").select("tz_idx", "x", "y", F.lit(z).alias("z"), "mask")
        free = own if free is None else free.unionByName(own)
        level = parents
    return free


def preindex(rings: DataFrame, idx_zoom: int = 13, agg_zoom: int = 3, max_keep: int = 10, drop: int = 2, excluded: DataFrame | None = None, min_exterior: int = MIN_EXTERIOR) -> DataFrame:
    """name, x, y, z, key_ord, packed: tiles that lie wholly in one zone.

    The zone's set: tiles of idx_zoom with all corners inside.  Of these, drop layers along the rim go, four siblings become their
    parent up to agg_zoom, and tiles of up to max_keep stay.  The inside is never spelled out: tiles outside the set that touch it are
    on a border, so tiles within drop of those are marked, and a greatest tile without marked ones is wholly in what is left or
    wholly out; so are its free siblings, and one corner tells for all.  The work grows with the borders' length in tiles."""
    usable = rings.where(F.when(F.col("hole_idx") < 0, F.size("pts") >= min_exterior).otherwise(F.size("pts") >= MIN_HOLE))
    edge_table = R.edges(usable)
    several = settled(usable.where("hole_idx < 0").groupBy("tz_idx").agg(F.countDistinct("poly_idx").alias("n")).where("n > 1").select("tz_idx"))
    alone = several.isEmpty()
    border = _indexed_zones(settled(crossing_tiles(edge_table, idx_zoom)), edge_table, idx_zoom).select("tz_idx", "x", "y", F.lit(idx_zoom).alias("z"))
    border = border if alone else border.distinct()  # polygons of a zone cross the same tile
    zoom, least = max(1, min(max_keep, idx_zoom)), min(agg_zoom, idx_zoom)
    up = idx_zoom - zoom
    reach = lambda c: F.explode(F.sequence(F.shiftright(F.greatest(F.lit(0).cast("long"), F.col(c) - drop), up), F.shiftright(F.least(F.lit((1 << idx_zoom) - 1).cast("long"), F.col(c) + drop), up)))
    marked = _barred(border, edge_table, idx_zoom, excluded).select("tz_idx", "y", reach("x").alias("x")).select("tz_idx", "x", reach("y").alias("y"))
    if drop:
        marked = marked.unionByName(_world_rim(edge_table, idx_zoom, up, drop))
    free = _free_of(marked, zoom)
    first = F.when(F.col("mask") % 2 == 0, 0).when(F.shiftright("mask", 1) % 2 == 0, 1).when(F.shiftright("mask", 2) % 2 == 0, 2).otherwise(3)
    names = {k: f"t_{k}" for k in ("tz_idx", "x", "y", "z", "mask")}
    lng, lat = G.tile_lng(2 * F.col("x") + first % 2, F.col("z")), G.tile_lat(2 * F.col("y") + F.shiftright(first, 1), F.col("z"))
    corners = free.withColumns({"px": lng * 100_000, "py": lat * 100_000}).withColumnsRenamed(names)
    held = strictly_inside(corners, edge_table, list(names.values()), "t_tz_idx").select(*[F.col(n).alias(k) for k, n in names.items()])
    held = held if alone else held.distinct()  # polygons that overlap hold the same corner
    places = F.explode(F.expr("filter(array(0, 1, 2, 3), c -> (shiftright(mask, c) & 1) = 0)"))
    tiles = held.withColumn("__c", places).select("tz_idx", (2 * F.col("x") + F.col("__c") % 2).alias("x"), (2 * F.col("y") + F.shiftright("__c", 1)).alias("y"), "z")
    merged = not_excluded(tiles.where(F.col("z") >= least).unionByName(at_zoom(tiles.where(F.col("z") < least), least)), excluded).where(F.col("z") <= max_keep)
    if not alone:  # a parent may have its corners in different polygons
        merged = settled(merged)
        merged = merged.join(spread(several), "tz_idx", "left_anti").unionByName(ensure_inside(merged.join(spread(several), "tz_idx", "left_semi"), edge_table))
    names = rings.select("tz_idx", "name").distinct()
    return merged.join(spread(names), "tz_idx").select("name", "x", "y", "z", F.col("tz_idx").cast("long").alias("key_ord"), G.pack_tile(F.col("x"), F.col("y"), F.col("z")).alias("packed"))


def tile_features(tiles: DataFrame) -> DataFrame:
    """One GeoJSON feature for each different tile (names are dropped)."""
    ring = F.transform(G.tile_ring(F.col("x"), F.col("y"), F.col("z")), lambda c: F.array(c["lng"], c["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return tiles.dropDuplicates(["x", "y", "z"]).select("x", "y", "z", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"))).alias("feature"))


def zone_features(tiles: DataFrame) -> DataFrame:
    """One MultiPolygon feature for each zone's tiles."""
    ring = F.transform(G.tile_ring(F.col("x"), F.col("y"), F.col("z")), lambda c: F.array(c["lng"], c["lat"]))
    zones = tiles.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("z", "x", "y", F.array(ring).alias("c")))).alias("t"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("t", lambda t: t["c"]).alias("coordinates"))
    return zones.select("name", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("name").alias("tzid")).alias("properties"), geometry.alias("geometry"))).alias("feature"))
