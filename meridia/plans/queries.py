"""The registered queries of the zone engine, and their SQL for an oracle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import audit, finder, tiles, topology
from ..operators import rings as R
from ..schemas import TILES
from ..sources import fixtures as X
from ..sources import geojson as J
from ..stages import settled
from . import pipeline

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.hashed_points(table(spark, sf_dir, "events"), "event_id")


def zone_finder(spark: SparkSession, rows: list[X.Ring], use_grid: bool = True, version: str = "") -> finder.ZoneFinder:
    return finder.ZoneFinder.from_rings(X.rings(spark, rows), version, use_grid)


#: Zones drawn from the rows of a table: one for each supplier, sharing crooked borders, every third with an enclave.
PATCHES = X.Patches("supplier", "s_suppkey")


def patch_finder(spark: SparkSession, sf_dir: str, use_grid: bool = True) -> finder.ZoneFinder:
    return finder.ZoneFinder.from_rings(PATCHES.rings(spark, sf_dir), "", use_grid)


def hits_sql(points: str, rows: list[X.Ring] | X.Patches, allow_edge: bool = True) -> str:
    """Brute force: every edge against every point."""
    zones = X.Drawn(rows) if isinstance(rows, list) else rows
    on = "is_on OR " if allow_edge else "NOT is_on AND "
    return f"""p AS {points}, e AS (SELECT * FROM {zones.edges_sql()}), z AS (SELECT * FROM {zones.zones_sql()}),
  r AS (SELECT pt_id, tz_idx, poly_idx, hole_idx, bool_or({G.on_edge_sql()}) AS is_on, sum({G.crossing_sql()}) AS c
        FROM p JOIN e ON py BETWEEN least(ya, yb) AND greatest(ya, yb) GROUP BY ALL),
  q AS (SELECT pt_id, tz_idx, poly_idx, bool_or(hole_idx < 0 AND ({on}c % 2 = 1)) AS o, bool_or(hole_idx >= 0 AND NOT is_on AND c % 2 = 1) AS h FROM r GROUP BY ALL),
  hits AS (SELECT DISTINCT pt_id, tz_idx, name FROM q JOIN z USING (tz_idx) WHERE o AND NOT h)"""


EVENTS, BORDER = X.points_sql("events", "event_id"), X.border_points_sql("events", "event_id")
FIRST = "SELECT p.pt_id, coalesce(min_by(name, tz_idx), '') AS name FROM p LEFT JOIN hits USING (pt_id) GROUP BY p.pt_id"
ALL = "SELECT p.pt_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS names FROM p LEFT JOIN hits USING (pt_id) GROUP BY p.pt_id"


def named(df: DataFrame) -> DataFrame:
    return df.select("pt_id", F.coalesce("name", F.lit("")).alias("name"))


def joined(df: DataFrame) -> DataFrame:
    return df.select("pt_id", F.array_join("names", ",").alias("names"))


@query(f"WITH {hits_sql(EVENTS, X.nautical())}, f AS ({FIRST}) SELECT name, count(*) AS n FROM f GROUP BY name")
def events_per_zone(spark, sf_dir):
    return named(zone_finder(spark, X.nautical()).first(events(spark, sf_dir))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {hits_sql(EVENTS, X.nations())} {FIRST}")
def lookup_first(spark, sf_dir):
    return named(zone_finder(spark, X.nations()).first(events(spark, sf_dir), strict=True))


_SHORTCUT = f"""g AS (SELECT b.tz_idx, x.x AS cx, y.y AS cy FROM (SELECT tz_idx, min(xa) x0, max(xa) x1, min(ya) y0, max(ya) y1 FROM e WHERE hole_idx < 0 GROUP BY tz_idx) b,
    unnest(generate_series(cast(floor(x0 / 100000.0) AS int), cast(floor(x1 / 100000.0) AS int))) x(x), unnest(generate_series(cast(floor(y0 / 100000.0) AS int), cast(floor(y1 / 100000.0) AS int))) y(y)),
  c AS (SELECT cx, cy, count(*) AS n, min(tz_idx) AS lone FROM g GROUP BY cx, cy),
  s AS (SELECT pt_id, CASE WHEN n = 1 AND abs(px) < 17900000 AND abs(py) < 8900000 THEN lone END AS sure FROM p LEFT JOIN c ON cx = floor(px / 100000.0) AND cy = floor(py / 100000.0)),
  f AS (SELECT p.pt_id, min(tz_idx) AS tz FROM p LEFT JOIN hits USING (pt_id) GROUP BY p.pt_id)
  SELECT f.pt_id, coalesce(z.name, '') AS name FROM f JOIN s USING (pt_id) LEFT JOIN z ON z.tz_idx = coalesce(sure, tz)"""


@query(f"WITH {hits_sql(EVENTS, X.nations())}, {_SHORTCUT}")
def lookup_first_shortcut(spark, sf_dir):
    return named(zone_finder(spark, X.nations()).first(events(spark, sf_dir)))


@query(f"WITH {hits_sql(BORDER, X.nautical())} {FIRST}")
def lookup_first_border(spark, sf_dir):
    return named(zone_finder(spark, X.nautical()).first(X.border_points(table(spark, sf_dir, "events"), "event_id")))


@query(f"WITH {hits_sql(BORDER, X.nautical())} {ALL}")
def lookup_all_border(spark, sf_dir):
    return joined(zone_finder(spark, X.nautical()).all(X.border_points(table(spark, sf_dir, "events"), "event_id")))


@query(f"WITH {hits_sql(EVENTS, X.overlap())} {ALL}")
def lookup_all(spark, sf_dir):
    return joined(zone_finder(spark, X.overlap()).all(events(spark, sf_dir)))


@query(f"WITH {hits_sql(EVENTS, X.jagged())} {ALL}")
def lookup_all_jagged(spark, sf_dir):
    return joined(zone_finder(spark, X.jagged()).all(events(spark, sf_dir)))


@query(f"WITH {hits_sql(EVENTS, X.nations())} {FIRST}")
def lookup_first_nogrid(spark, sf_dir):
    return named(zone_finder(spark, X.nations(), use_grid=False).first(events(spark, sf_dir)))


@query(f"WITH {hits_sql(X.points_sql('customer', 'c_custkey'), X.nations())}, v AS (SELECT p.pt_id, min(tz_idx) AS t FROM p LEFT JOIN hits USING (pt_id) GROUP BY p.pt_id) SELECT coalesce(z.name, '') AS name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM v JOIN customer ON c_custkey = pt_id LEFT JOIN z ON z.tz_idx = t GROUP BY 1")
def customers_per_zone(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    found = named(zone_finder(spark, X.nations()).first(X.hashed_points(c, "c_custkey"), strict=True))
    return found.join(c, F.col("pt_id") == F.col("c_custkey")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"WITH {hits_sql(X.border_points_sql('events', 'event_id'), X.nations(), False)} SELECT pt_id, tz_idx FROM hits")
def feature_matches(spark, sf_dir):
    return zone_finder(spark, X.nations()).matches(X.border_points(table(spark, sf_dir, "events"), "event_id"))


@query(f"SELECT tz_idx, name FROM {PATCHES.zones_sql()}")
def zone_names(spark, sf_dir):
    return patch_finder(spark, sf_dir).timezone_names()


@query("SELECT 0 AS n_different")
def parity_grid(spark, sf_dir):
    """The events, 500,000 scattered points and every half degree: the tested lookup against the one with the cells' shortcut."""
    scattered = X.hashed_points(spark.range(500_000).select((F.col("id") + (1 << 32)).alias("k")), "k")
    grid = spark.range(720 * 360).select((F.col("id") + (1 << 40)).alias("pt_id"), (-17_975_000 + 50_000 * (F.col("id") % 720)).alias("px"), (-8_975_000 + 50_000 * F.floor(F.col("id") / 720)).cast("long").alias("py"))
    p = events(spark, sf_dir).unionByName(scattered).unionByName(grid)
    n, _ = finder.parity(zone_finder(spark, X.jagged()).first(p, strict=True), zone_finder(spark, X.jagged(), use_grid=False).first(p))
    return spark.createDataFrame([(n,)], "n_different int")


_CORNERS = f"(SELECT 1099511627776 + (tz_idx * 2 + hole_idx + 1) * 64 + edge_idx AS pt_id, xa AS px, ya AS py FROM {PATCHES.edges_sql()})"
_SINGLE = ", ".join(f"cast(cast({c} / 1e5 AS float) AS double) AS {c}" for c in ("xa", "ya", "xb", "yb"))
_NEAR = f"py BETWEEN least(ya, yb) - {finder.ROUNDING} AND greatest(ya, yb) + {finder.ROUNDING} AND px BETWEEN least(xa, xb) - {finder.ROUNDING} AND greatest(xa, xb) + {finder.ROUNDING} AND abs(cast(xb - xa AS double) * (py - ya) - cast(yb - ya AS double) * (px - xa)) <= {finder.ROUNDING} * sqrt(pow(xb - xa, 2) + pow(yb - ya, 2))"


@query(f"""WITH {hits_sql(f"(SELECT * FROM {EVENTS} UNION ALL SELECT * FROM {_CORNERS})", PATCHES)}, a AS ({FIRST}),
  s AS (SELECT tz_idx, poly_idx, hole_idx, {_SINGLE} FROM e), d AS (SELECT pt_id, px / 1e5 AS lng, py / 1e5 AS lat FROM p),
  t AS (SELECT pt_id, tz_idx, poly_idx, hole_idx, bool_or((xb - xa) * (lat - ya) = (yb - ya) * (lng - xa) AND lng BETWEEN least(xa, xb) AND greatest(xa, xb)) AS on_, sum(CASE WHEN (ya > lat) <> (yb > lat) AND lng < (xb - xa) * (lat - ya) / (yb - ya) + xa THEN 1 ELSE 0 END) % 2 = 1 AS odd FROM d JOIN s ON lat BETWEEN least(ya, yb) AND greatest(ya, yb) GROUP BY ALL),
  h AS (SELECT pt_id, tz_idx, poly_idx FROM t GROUP BY ALL HAVING bool_or(hole_idx < 0 AND (on_ OR odd)) AND NOT bool_or(hole_idx >= 0 AND NOT on_ AND odd)),
  b AS (SELECT p.pt_id, coalesce(min_by(z.name, h.tz_idx), '') AS name FROM p LEFT JOIN h USING (pt_id) LEFT JOIN z USING (tz_idx) GROUP BY p.pt_id),
  x AS (SELECT p.* FROM a JOIN b USING (pt_id) JOIN p USING (pt_id) WHERE a.name <> b.name)
  SELECT (SELECT count(*) FROM p) AS n_points, (SELECT count(*) FROM x) AS n_different, (SELECT count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE {_NEAR})) AS n_unexplained""")
def parity_single(spark, sf_dir):
    """The index against 32-bit borders with a predicate of their own, over the events and all corners of the zones: they may differ
    only where rounding moves a border."""
    rings = PATCHES.rings(spark, sf_dir)
    e = R.edges(rings)
    place = (F.lit(1 << 40) + (F.col("tz_idx") * 2 + F.col("hole_idx") + 1) * 64 + F.col("edge_idx")).alias("pt_id")
    points = settled(events(spark, sf_dir).unionByName(e.select(place, F.col("xa").alias("px"), F.col("ya").alias("py"))))
    exact = finder.ZoneFinder.from_rings(rings).first(points, strict=True).select("pt_id", F.col("name").alias("a"))
    both = exact.join(finder.float_first(points, rings).select("pt_id", F.col("name").alias("b")), "pt_id").where("not (a <=> b)")
    differ = settled(points.join(both.select("pt_id"), "pt_id", "left_semi"))
    count = lambda df, name: df.agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias(name))
    return count(points, "n_points").join(count(differ, "n_different"), "one").join(count(finder.unexplained(differ, e), "n_unexplained"), "one").drop("one")  # one row each


_SWEEP = "(SELECT y * 360 + x AS pt_id, -17950000 + 100000 * x AS px, -8950000 + 100000 * y AS py FROM range(360) a(x), range(180) b(y))"


@query(f"WITH {hits_sql(_SWEEP, PATCHES)} SELECT count(*) AS n FROM p WHERE pt_id NOT IN (SELECT pt_id FROM hits)")
def sweep_holes(spark, sf_dir):
    """Degrees of a sweep that no zone covers."""
    return patch_finder(spark, sf_dir).first(X.sweep_points(spark), strict=True).where("name is null").agg(F.count(F.lit(1)).alias("n"))


_GRID = f"""WITH b AS (SELECT tz_idx, min(xa) x0, max(xa) x1, min(ya) y0, max(ya) y1 FROM {PATCHES.edges_sql()} WHERE hole_idx < 0 GROUP BY tz_idx),
  g AS (SELECT x.x AS cell_lng, y.y AS cell_lat, tz_idx FROM b, unnest(generate_series(cast(floor(x0 / 100000.0) AS int), cast(floor(x1 / 100000.0) AS int))) x(x), unnest(generate_series(cast(floor(y0 / 100000.0) AS int), cast(floor(y1 / 100000.0) AS int))) y(y))"""


@query(_GRID + " SELECT cell_lng, cell_lat, string_agg(cast(tz_idx AS varchar), ',' ORDER BY tz_idx) AS tz FROM g GROUP BY ALL")
def grid_build(spark, sf_dir):
    lists = finder.grid_lists(finder.build_grid(R.edges(PATCHES.rings(spark, sf_dir))))
    return lists.select("cell_lng", "cell_lat", F.array_join(F.transform("tz_indices", lambda t: t.cast("string")), ",").alias("tz"))


@query(_GRID + ", c AS (SELECT count(*) AS n_cand FROM g GROUP BY cell_lng, cell_lat) SELECT n_cand, count(*) AS cells FROM c GROUP BY n_cand")
def grid_fanout(spark, sf_dir):
    grid = finder.build_grid(R.edges(PATCHES.rings(spark, sf_dir)))
    return grid.select("cell_lng", "cell_lat", "n_cand").distinct().groupBy("n_cand").agg(F.count(F.lit(1)).alias("cells"))


# Tiles

_MAP = [(f"T{(x * y) % 4}", x, y, 3, (x * y) % 4) for x in range(8) for y in range(8) if (x + y) % 3 == 0] + [(f"U{k}", x, y, 5, k) for x in range(32) for y in range(32) if (x * 7 + y) % 5 == 0 for k in ((x % 2), 2)]
_TILES = "(VALUES " + ",".join(f"('{n}', {x}, {y}, {z}, {k}, {z << 56 | x << 28 | y})" for n, x, y, z, k in _MAP) + ") t(name, x, y, z, key_ord, packed)"


def _fuzzy(spark: SparkSession, version: str = "") -> finder.FuzzyFinder:
    return finder.FuzzyFinder(spark.createDataFrame([(n, x, y, z, k, z << 56 | x << 28 | y) for n, x, y, z, k in _MAP], TILES), 3, 5, version)


#: Tiles of three zooms drawn from the rows of customer: zoom, name, x, y, key_ord as SQL of k.
_ROW_TILES = [(3, "'T' || k % 7", "k * 5 % 8", "(k * 3 + k // 8) % 8", "k % 7"), (5, "'U' || k % 3", "k * 7 % 32", "(k * 11 + k // 32) % 32", "10 + k % 3"), (9, "'V' || k % 11", "k * 613 % 512", "(k * 379 + k // 512) % 512", "20 + k % 11")]
_TABLE_TILES = "(" + " UNION ALL ".join(f"SELECT DISTINCT {n} AS name, {x} AS x, {y} AS y, {z} AS z, {o} AS key_ord FROM (SELECT cast(c_custkey AS bigint) AS k FROM customer)" for z, n, x, y, o in _ROW_TILES) + ") t"


def table_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    parts = [k.selectExpr(*[e.replace("//", "div") + f" AS {c}" for e, c in ((n, "name"), (x, "x"), (y, "y"))], f"{z} AS z", f"cast({o} AS bigint) AS key_ord").distinct() for z, n, x, y, o in _ROW_TILES]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.withColumn("packed", G.pack_tile(F.col("x"), F.col("y"), F.col("z")))


_XY = "cast(floor((px / 100000.0 / 360.0 + 0.5) * pow(2, {z})) AS bigint)", "greatest(0, least(cast(pow(2, {z}) AS bigint) - 1, cast(floor((0.5 - ln((1 + sin(radians(greatest(-85.05112878, least(85.05112878, py / 100000.0))))) / (1 - sin(radians(greatest(-85.05112878, least(85.05112878, py / 100000.0)))))) / (4 * pi())) * pow(2, {z})) AS bigint)))"


def _xy(z: int) -> str:
    return f"{_XY[0].format(z=z)} AS x, {_XY[1].format(z=z)} AS y"


_FUZZY = f"p AS {EVENTS}, k AS (" + " UNION ALL ".join(f"SELECT pt_id, {z} AS z, {_xy(z)} FROM p" for z in (3, 4, 5)) + f"), h AS (SELECT k.pt_id, t.name, t.z, t.key_ord FROM k JOIN {_TILES} ON t.x = k.x AND t.y = k.y AND t.z = k.z)"


@query(f"WITH {_FUZZY} SELECT p.pt_id, coalesce((array_agg(h.name ORDER BY h.z, h.key_ord))[1], '') AS name FROM p LEFT JOIN h USING (pt_id) GROUP BY p.pt_id")
def fuzzy_first(spark, sf_dir):
    return named(_fuzzy(spark).first(events(spark, sf_dir)))


@query(f"WITH {_FUZZY}, m AS (SELECT pt_id, min(z) AS z FROM h GROUP BY pt_id), l AS (SELECT pt_id, string_agg(name, ',' ORDER BY key_ord) AS names FROM h JOIN m USING (pt_id, z) GROUP BY pt_id) SELECT pt_id, coalesce(names, '') AS names FROM p LEFT JOIN l USING (pt_id)")
def fuzzy_all(spark, sf_dir):
    return joined(_fuzzy(spark).all(events(spark, sf_dir)))


@query(f"SELECT DISTINCT name FROM {_TABLE_TILES}")
def fuzzy_names(spark, sf_dir):
    return finder.FuzzyFinder(table_tiles(spark, sf_dir), 3, 9).timezone_names()


@query(f"WITH {hits_sql(EVENTS, X.nautical())}, {_FUZZY.replace('p AS ' + EVENTS + ', ', '')}, a AS ({FIRST}), b AS (SELECT pt_id, (array_agg(h.name ORDER BY h.z, h.key_ord))[1] AS t FROM h GROUP BY pt_id) SELECT pt_id, coalesce(t, name) AS name FROM a LEFT JOIN b USING (pt_id)")
def default_first(spark, sf_dir):
    return named(finder.DefaultFinder(_fuzzy(spark), zone_finder(spark, X.nautical())).first(events(spark, sf_dir)))


@query(f"WITH {hits_sql(EVENTS, X.nautical())} {ALL}")
def default_all(spark, sf_dir):
    return joined(finder.DefaultFinder(_fuzzy(spark), zone_finder(spark, X.nautical())).all(events(spark, sf_dir)))


@query(f"SELECT pt_id, {_xy(10)} FROM {EVENTS}")
def tile_xy(spark, sf_dir):
    z = F.lit(10)
    return events(spark, sf_dir).select("pt_id", G.tile_x(F.col("px") / 100_000.0, z).alias("x"), G.tile_y(F.col("py") / 100_000.0, z).alias("y"))


@query(f"SELECT pt_id, (cast(10 AS bigint) << 56) | (x << 28) | y AS packed FROM (SELECT pt_id, {_xy(10)} FROM {EVENTS})")
def tile_pack(spark, sf_dir):
    return tile_xy(spark, sf_dir).select("pt_id", G.pack_tile(F.col("x"), F.col("y"), F.lit(10)).alias("packed"))


@query(f"SELECT pt_id, (cast(7 AS bigint) << 56) | ((x >> 3) << 28) | (y >> 3) AS parent, 0 AS too_far FROM (SELECT pt_id, {_xy(10)} FROM {EVENTS})")
def tile_parent(spark, sf_dir):
    p = F.col("packed")
    return tile_pack(spark, sf_dir).select("pt_id", G.parent_tile(p, F.lit(3)).alias("parent"), G.parent_tile(p, F.lit(11)).alias("too_far"))


@query(f"SELECT DISTINCT x, y, round(x / 1024.0 * 360 - 180, 6) AS west, round(degrees(atan(sinh_(pi() * (1 - 2 * y / 1024.0)))), 6) AS north FROM (SELECT {_xy(10)} FROM {EVENTS})".replace("sinh_(pi() * (1 - 2 * y / 1024.0))", "(exp(pi() * (1 - 2 * y / 1024.0)) - exp(-pi() * (1 - 2 * y / 1024.0))) / 2"))
def tile_bounds(spark, sf_dir):
    z = F.lit(10)
    return tile_xy(spark, sf_dir).select("x", "y").distinct().select("x", "y", F.round(G.tile_lng(F.col("x"), z), 6).alias("west"), F.round(G.tile_lat(F.col("y"), z), 6).alias("north"))


_SET = "(SELECT DISTINCT k % 4 AS tz_idx, k * 37 % 50 * 5 + dx AS x, (k * 17 + k // 50) % 50 * 5 + dy AS y FROM (SELECT cast(c_custkey AS bigint) AS k FROM customer), range(6) a(dx), range(6) b(dy))"


def _tile_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of 6 x 6 tiles for each customer, in four zones."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    block = k.withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return block.selectExpr("cast(k % 4 AS int) AS tz_idx", "k * 37 % 50 * 5 + dx AS x", "(k * 17 + k div 50) % 50 * 5 + dy AS y", "8 AS z").distinct()


@query(f"WITH s AS {_SET} SELECT a.tz_idx, a.x, a.y FROM s a JOIN s b ON a.tz_idx = b.tz_idx AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL HAVING count(*) = 9")
def drop_edge_tiles(spark, sf_dir):
    return tiles.drop_edge_tiles(_tile_set(spark, sf_dir)).select("tz_idx", "x", "y")


_MERGED = "WITH s AS {s}, p7 AS (SELECT tz_idx, x >> 1 AS x, y >> 1 AS y FROM s GROUP BY ALL HAVING count(*) = 4), p6 AS (SELECT tz_idx, x >> 1 AS x, y >> 1 AS y FROM p7 GROUP BY ALL HAVING count(*) = 4)"


@query(_MERGED.format(s=_SET) + " SELECT tz_idx, x, y, 6 AS z FROM p6 UNION ALL SELECT tz_idx, x, y, 7 FROM p7 WHERE (tz_idx, x >> 1, y >> 1) NOT IN (SELECT (tz_idx, x, y) FROM p6) UNION ALL SELECT tz_idx, x, y, 8 FROM s WHERE (tz_idx, x >> 1, y >> 1) NOT IN (SELECT (tz_idx, x, y) FROM p7)")
def merge_up(spark, sf_dir):
    return tiles.merge_up(_tile_set(spark, sf_dir), 6, 8).select("tz_idx", "x", "y", "z")


@query(f"SELECT pt_id FROM {EVENTS} WHERE " + " OR ".join(f"(px > {round(w * 1e5)} AND px < {round(e * 1e5)} AND py > {round(s * 1e5)} AND py < {round(n * 1e5)})" for w, s, e, n in tiles.EXCLUDED))
def exclude_match(spark, sf_dir):
    return tiles.exclusion_match(events(spark, sf_dir), R.edges(tiles.exclusion_rings(spark))).select("pt_id")


_ZOOM = 7
_SIDES = ", ".join(f"(xb - xa) * ({b} - ya) - (yb - ya) * ({a} - xa)" for a in ("(west - 0.01)", "(east + 0.01)") for b in ("(south - 0.01)", "(north + 0.01)"))
_MEETS = f"least(xa, xb) <= east + 0.01 AND greatest(xa, xb) >= west - 0.01 AND least(ya, yb) <= north + 0.01 AND greatest(ya, yb) >= south - 0.01 AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0"
_RIM = "x / pow(2, z) * 36000000 - 18000000 AS west, (x + 1) / pow(2, z) * 36000000 - 18000000 AS east, 1e5 * degrees(atan((exp(pi() * (1 - 2 * y / pow(2, z))) - exp(-pi() * (1 - 2 * y / pow(2, z)))) / 2)) AS north, 1e5 * degrees(atan((exp(pi() * (1 - 2 * (y + 1) / pow(2, z))) - exp(-pi() * (1 - 2 * (y + 1) / pow(2, z)))) / 2)) AS south"
_BOXED = " OR ".join(f"(px > {round(w * 1e5)} AND px < {round(e * 1e5)} AND py > {round(s * 1e5)} AND py < {round(n * 1e5)})" for w, s, e, n in tiles.EXCLUDED)


def _inside_sql(name: str, of: str) -> str:
    """CTEs: name, the tiles of a table (tz_idx, x, y, z) whose corners are all strictly inside a polygon of their zone and in no excluded region."""
    return f"""{name}_c AS (SELECT tz_idx, x, y, z, unnest([1, 2, 3, 4]) AS corner, unnest([west, west, east, east]) AS px, unnest([north, south, north, south]) AS py FROM (SELECT *, {_RIM} FROM {of})),
  {name}_r AS (SELECT c.tz_idx, x, y, z, corner, px, py, poly_idx, hole_idx, bool_or({G.on_edge_sql()}) AS is_on, sum({G.crossing_sql()}) AS c FROM {name}_c c JOIN e ON c.tz_idx = e.tz_idx AND py BETWEEN least(ya, yb) AND greatest(ya, yb) GROUP BY ALL),
  {name}_q AS (SELECT tz_idx, x, y, z, corner, poly_idx, bool_or(hole_idx < 0 AND NOT is_on AND c % 2 = 1) AND NOT bool_or(hole_idx >= 0 AND NOT is_on AND c % 2 = 1) AS held, bool_or({_BOXED}) AS bad FROM {name}_r GROUP BY ALL),
  {name} AS (SELECT tz_idx, x, y, z FROM {name}_q GROUP BY tz_idx, x, y, z, poly_idx HAVING count(*) FILTER (held) = 4 AND NOT bool_or(bad))"""


def _box_tiles(z: int | str, of: str = "e") -> str:
    """Every tile of each polygon's box, of a zoom or of the zoom in a column of the table."""
    y = _XY[1].format(z=z)
    own, by_, n = ("", "ALL", (1 << z) - 1) if isinstance(z, int) else (f"{z}, ", f"tz_idx, poly_idx, {z}", f"(1 << {z}) - 1")
    return f"""(SELECT tz_idx, poly_idx, x.x AS x, y.y AS y, {z} AS z FROM (SELECT tz_idx, poly_idx, {own}{_XY[0].format(z=z).replace("px", "min(xa)")} AS x0, {_XY[0].format(z=z).replace("px", "max(xa)")} AS x1, {y.replace("py", "max(ya)")} AS y0, {y.replace("py", "min(ya)")} AS y1 FROM {of} WHERE hole_idx < 0 GROUP BY {by_}) b,
    unnest(generate_series(x0, least(x1, {n}))) x(x), unnest(generate_series(y0, y1)) y(y))"""


_CROSSED = f"""crossed AS (SELECT DISTINCT b.tz_idx, b.poly_idx, x, y, z FROM (SELECT *, {_RIM} FROM box) b JOIN e ON b.tz_idx = e.tz_idx AND b.poly_idx = e.poly_idx AND {_MEETS})"""
_COVER = f"""e AS (SELECT * FROM {PATCHES.edges_sql()}), box AS {_box_tiles(_ZOOM)},
  {_CROSSED}"""


@query(f"WITH {_COVER}, f AS (SELECT * FROM box WHERE (tz_idx, poly_idx, x, y) NOT IN (SELECT (tz_idx, poly_idx, x, y) FROM crossed)), {_inside_sql('i', 'f').replace(_BOXED, 'false')} SELECT tz_idx, x, y, true AS inside FROM i UNION ALL SELECT tz_idx, x, y, false FROM crossed")
def tile_cover(spark, sf_dir):
    """The tiles of one zoom that cover each zone, and whether an edge meets them: found by descending the quadtree, against every tile of the boxes."""
    found = tiles.cover(R.edges(PATCHES.rings(spark, sf_dir)), _ZOOM)
    flat = [tiles.at_zoom(found.where("inside" if inside else "not inside"), _ZOOM).select("tz_idx", "x", "y", F.lit(inside).alias("inside")) for inside in (True, False)]
    return flat[0].unionByName(flat[1])


#: The zoom of the pre-index follows the zones: see tiles.index_zoom().
_PARTS = 16
_FITTING = f"""zoom AS (SELECT cast(coalesce(min(z), {G.MAX_ZOOM}) AS int) AS z FROM range(4, {G.MAX_ZOOM + 1}) r(z), (SELECT count(*) AS n, sum(least(x1 - x0, y1 - y0)) AS total
    FROM (SELECT min(xa) AS x0, max(xa) AS x1, min(ya) AS y0, max(ya) AS y1 FROM e WHERE hole_idx < 0 GROUP BY tz_idx, poly_idx)) WHERE 36000000 * {_PARTS} * n <= total * (cast(1 AS bigint) << z))"""


@query(f"""WITH e AS (SELECT * FROM {PATCHES.edges_sql()}), {_FITTING}, box AS {_box_tiles("z", "e, zoom")},
  {_CROSSED}, {_inside_sql("whole", "(SELECT tz_idx, x, y, z FROM box)")},
  {_inside_sql("free", "(SELECT tz_idx, x, y, z FROM box WHERE (tz_idx, poly_idx, x, y) NOT IN (SELECT (tz_idx, poly_idx, x, y) FROM crossed))").replace(_BOXED, "false")},
  enough AS (SELECT tz_idx FROM (SELECT tz_idx FROM crossed UNION ALL SELECT tz_idx FROM free) GROUP BY tz_idx HAVING count(*) >= {tiles.MIN_TILES}),
  s AS (SELECT DISTINCT tz_idx, x, y, z FROM whole WHERE tz_idx IN (SELECT tz_idx FROM enough)),
  m AS (SELECT tz_idx, x + dx AS x, y + dy AS y, z FROM s, range(-1, 2) a(dx), range(-1, 2) b(dy) GROUP BY ALL HAVING count(*) = 9),
  full_ AS MATERIALIZED (SELECT tz_idx, x >> k AS x, y >> k AS y, cast(z - k AS int) AS z FROM m, range({G.MAX_ZOOM}) r(k) WHERE k <= z - 3 GROUP BY ALL HAVING count(*) = cast(1 AS bigint) << (2 * max(k))),
  left_ AS (SELECT * FROM full_ WHERE z = 3 OR (tz_idx, x >> 1, y >> 1, z - 1) NOT IN (SELECT (tz_idx, x, y, z) FROM full_)), {_inside_sql("done", "left_")}
  SELECT name, x, y, z, cast(tz_idx AS bigint) AS key_ord, (cast(z AS bigint) << 56) | (x << 28) | y AS packed FROM done JOIN {PATCHES.zones_sql()} USING (tz_idx) WHERE z < (SELECT zoom.z FROM zoom)""")
def preindex(spark, sf_dir):
    """Tiles wholly in one zone, of a zoom that follows the zones' size, so that zones have some however many there are; those of that zoom itself go."""
    rings = PATCHES.rings(spark, sf_dir)
    zoom = tiles.index_zoom(rings, _PARTS)
    return tiles.preindex(rings, idx_zoom=zoom, agg_zoom=3, max_keep=zoom - 1, drop=1, excluded=R.edges(tiles.exclusion_rings(spark)))


# Rings

_E = f"(SELECT * FROM {PATCHES.edges_sql()})"
_RING = "tz_idx, poly_idx, hole_idx"
_TWICE = "sum(cast(xa AS double) * yb - cast(xb AS double) * ya)"
_LEN = "sum(sqrt(cast(xb - xa AS double) * (xb - xa) + cast(yb - ya AS double) * (yb - ya)))"


def _patch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edges(PATCHES.rings(spark, sf_dir))


@query(f"SELECT {_RING}, min(xa) AS min_x, min(ya) AS min_y, max(xa) AS max_x, max(ya) AS max_y FROM {_E} GROUP BY ALL")
def ring_bbox(spark, sf_dir):
    return R.bounds(_patch_edges(spark, sf_dir), *R.RING)


@query(f"SELECT {_RING}, round(abs({_TWICE}) / 2 / 1e10, 3) AS area, round({_LEN} / 1e5, 3) AS perimeter FROM {_E} GROUP BY tz_idx, poly_idx, hole_idx")
def ring_area_perimeter(spark, sf_dir):
    return R.area_perimeter(_patch_edges(spark, sf_dir)).select(*R.RING, F.round(F.col("area") / 1e10, 3).alias("area"), F.round(F.col("perimeter") / 1e5, 3).alias("perimeter"))


@query(f"SELECT {_RING}, round({_TWICE} / 2 / 1e10, 3) AS signed_area FROM {_E} GROUP BY tz_idx, poly_idx, hole_idx")
def signed_area(spark, sf_dir):
    return R.area_perimeter(_patch_edges(spark, sf_dir)).select(*R.RING, F.round(F.col("signed_area") / 1e10, 3).alias("signed_area"))


@query(f"SELECT {_RING}, greatest(32, cast(floor(count(*) * (4 * pi() * abs({_TWICE}) / 2 / ({_LEN} * {_LEN}))) AS bigint)) AS stripes FROM {_E} GROUP BY tz_idx, poly_idx, hole_idx")
def stripe_count(spark, sf_dir):
    return R.stripe_counts(_patch_edges(spark, sf_dir)).select(*R.RING, "stripes")


@query(f"SELECT {_RING}, round(-sum(radians((xb - xa) / 1e5) * (2 + sin(radians(ya / 1e5)) + sin(radians(yb / 1e5)))) * (6371007.180918475 * 6371007.180918475 / 2) / 1e6, 0) + 0 AS area_km2 FROM {_E} GROUP BY tz_idx, poly_idx, hole_idx")
def spherical_area(spark, sf_dir):
    return audit.spherical_area(_patch_edges(spark, sf_dir)).select(*R.RING, (F.round(F.col("area_m2") / 1e6, 0) + 0.0).alias("area_km2"))


@query(f"SELECT {_RING}, round(sum(2 * 6371007.180918475 * asin(sqrt(least(1.0, pow(sin(radians((yb - ya) / 1e5) / 2), 2) + cos(radians(ya / 1e5)) * cos(radians(yb / 1e5)) * pow(sin(radians((xb - xa) / 1e5) / 2), 2))))) / 1e3, 2) AS length_km FROM {_E} GROUP BY tz_idx, poly_idx, hole_idx")
def polyline_length(spark, sf_dir):
    return audit.polyline_length(_patch_edges(spark, sf_dir)).select(*R.RING, F.round(F.col("length_m") / 1e3, 2).alias("length_km"))


@query(f"""WITH o AS (SELECT * FROM {_E} WHERE hole_idx < 0), p AS (SELECT tz_idx AS t, edge_idx AS i, xa AS px, ya AS py FROM o),
  r AS (SELECT t, i, tz_idx, bool_or({G.on_edge_sql()}) AS is_on, sum({G.crossing_sql()}) AS c FROM p JOIN o ON py BETWEEN least(ya, yb) AND greatest(ya, yb) GROUP BY ALL)
  SELECT i.tz_idx AS outer_idx, i.t AS inner_idx FROM (SELECT tz_idx, t, count(*) AS k FROM r WHERE NOT is_on AND c % 2 = 1 GROUP BY tz_idx, t) i JOIN (SELECT t, count(*) AS k FROM p GROUP BY t) n ON n.t = i.t AND n.k = i.k""")
def contains_poly(spark, sf_dir):
    return tiles.containing_zones(PATCHES.rings(spark, sf_dir))


# Topology

_KEYED = f"k AS (SELECT {_RING}, edge_idx, CASE WHEN xa = -18000000 THEN 18000000 ELSE xa END AS ax, ya AS ay, CASE WHEN xb = -18000000 THEN 18000000 ELSE xb END AS bx, yb AS by_ FROM e)"
_PAIRS = "u AS (SELECT least((ax, ay), (bx, by_)) AS lo, greatest((ax, ay), (bx, by_)) AS hi, count(*) AS n, count(DISTINCT (tz_idx, poly_idx, hole_idx)) AS rings, sum(CASE WHEN (ax, ay) <= (bx, by_) THEN 1 ELSE 0 END) AS f FROM k GROUP BY lo, hi)"
_TOPO = f"e AS {_E}, {_KEYED}, {_PAIRS}"


#: Of the simplifications below, in degrees.
_EPSILON = 0.02


def _chains_sql(zones: X.Patches = PATCHES) -> str:
    """CTEs: v, the rings' vertices turned to begin at a fixed vertex or the least; c, the chains between fixed vertices, in canonical direction."""
    return f"""e AS (SELECT * FROM {zones.edges_sql()}), {_KEYED},
  fx AS (SELECT ax, ay FROM k GROUP BY ax, ay HAVING count(DISTINCT (tz_idx, poly_idx, hole_idx)) > 2),
  v0 AS (SELECT e.tz_idx, e.hole_idx, e.edge_idx AS i, xa AS x, ya AS y, fx.ax IS NOT NULL AS f, count(*) OVER (PARTITION BY e.tz_idx, e.hole_idx) AS n FROM e JOIN k USING (tz_idx, poly_idx, hole_idx, edge_idx) LEFT JOIN fx USING (ax, ay)),
  st AS (SELECT tz_idx, hole_idx, coalesce(min(i) FILTER (f), arg_min(i, (x, y))) AS start, count(*) FILTER (f) AS fixed FROM v0 GROUP BY ALL),
  v AS (SELECT tz_idx, hole_idx, (i - start + n) % n AS pos, x, y, n, f, fixed FROM v0 JOIN st USING (tz_idx, hole_idx)),
  cu AS (SELECT tz_idx, hole_idx, n, pos AS c0, coalesce(lead(pos) OVER (PARTITION BY tz_idx, hole_idx ORDER BY pos), n) AS c1 FROM v WHERE f OR pos = 0),
  cp AS (SELECT cu.tz_idx, cu.hole_idx, c0, c1 - c0 + 1 AS m, v.pos + v.n * (CASE WHEN v.pos < c0 OR (v.pos = 0 AND c1 = v.n AND w.w = 1) THEN 1 ELSE 0 END) - c0 AS q, x, y
    FROM cu JOIN v ON v.tz_idx = cu.tz_idx AND v.hole_idx = cu.hole_idx CROSS JOIN (VALUES (0), (1)) w(w) WHERE (w.w = 0 AND v.pos BETWEEN c0 AND c1) OR (w.w = 1 AND v.pos = 0 AND c1 = v.n)),
  cl AS (SELECT tz_idx, hole_idx, c0, list((x, y) ORDER BY q) AS ahead, list((x, y) ORDER BY q DESC) AS back FROM cp GROUP BY ALL),
  c AS MATERIALIZED (SELECT cp.tz_idx, cp.hole_idx, cp.c0, m, q, CASE WHEN ahead <= back THEN q ELSE m - 1 - q END AS i, x, y, cast(least(ahead, back) AS varchar) AS canonical, ahead[1] = back[1] AS closed FROM cp JOIN cl USING (tz_idx, hole_idx, c0))"""


def _simplified_sql(epsilon: float) -> str:
    """CTEs after _chains_sql(): kept, the places i of each different chain that Douglas and Peucker's method keeps; s, the rings' vertices that stay."""
    far = "sqrt(pow(p.x - a.x - t * (b.x - a.x), 2) + pow(p.y - a.y - t * (b.y - a.y), 2))"
    return f"""u AS (SELECT DISTINCT canonical, m, i, x, y, closed FROM c),
  halves AS (SELECT u.canonical, arg_max(u.i, (cast(pow(u.x - o.x, 2) + pow(u.y - o.y, 2) AS bigint), -u.i)) AS far FROM u JOIN u o ON o.canonical = u.canonical AND o.i = 0 WHERE u.closed AND u.m > {topology.SHORT_PATH} GROUP BY ALL),
  d(canonical, a, b) AS (SELECT DISTINCT canonical, cast(0 AS bigint), cast(m - 1 AS bigint) FROM u WHERE NOT closed AND m > {topology.SHORT_PATH} UNION ALL SELECT canonical, 0, far FROM halves UNION ALL SELECT h.canonical, far, m - 1 FROM halves h JOIN u ON u.canonical = h.canonical AND u.i = 0
    UNION ALL SELECT canonical, unnest([a, f]), unnest([f, b]) FROM (SELECT canonical, a, b, -struct_extract(most, 2) AS f FROM (SELECT canonical, a, b, max((far, -i)) AS most FROM (
      SELECT d.canonical, d.a, d.b, p.i, {far.replace("t *", "g.t *").replace("p.x", "p.x")} AS far FROM d JOIN u a ON a.canonical = d.canonical AND a.i = d.a JOIN u b ON b.canonical = d.canonical AND b.i = d.b JOIN u p ON p.canonical = d.canonical AND p.i > d.a AND p.i < d.b,
        LATERAL (SELECT CASE WHEN a.x = b.x AND a.y = b.y THEN 0 ELSE greatest(0, least(1, (cast(p.x - a.x AS double) * (b.x - a.x) + cast(p.y - a.y AS double) * (b.y - a.y)) / (pow(b.x - a.x, 2) + pow(b.y - a.y, 2)))) END AS t) g)
      GROUP BY ALL) WHERE struct_extract(most, 1) > {epsilon * 100_000})),
  kept AS MATERIALIZED (SELECT canonical, a AS i FROM d UNION SELECT canonical, b FROM d UNION SELECT canonical, i FROM u WHERE m <= {topology.SHORT_PATH}),
  s AS (SELECT c.tz_idx, c.hole_idx, c0 + q AS pos, x, y FROM c JOIN kept USING (canonical, i) WHERE q < m - 1)"""


_COUNTED = ", ".join(f"sum(CASE WHEN {w} THEN uses ELSE 0 END) AS segments_{n}" for w, n in (("m <= 10", "le10"), ("m > 10 AND m <= 25", "le25"), ("m > 25 AND m <= 50", "le50"), ("m > 50 AND m <= 100", "le100"), ("m > 100", "gt100")))


@query(f"""WITH RECURSIVE {_chains_sql()}, {_simplified_sql(_EPSILON)},
  r AS (SELECT count(*) AS input_rings, sum(n) AS input_points, sum(fixed) AS fixed_vertices, count(*) FILTER (fixed = 0) AS rings_no_fixed, count(*) FILTER (fixed = 1) AS rings_one_fixed, count(*) FILTER (fixed > 1) AS rings_multi_fixed FROM (SELECT DISTINCT tz_idx, hole_idx, n, fixed FROM v)),
  w AS (SELECT canonical, any_value(m) AS m, count(*) AS uses FROM c WHERE q = 0 GROUP BY canonical), o AS (SELECT canonical, count(*) AS n_out FROM kept GROUP BY canonical),
  g AS (SELECT sum(uses) AS segments, sum(CASE WHEN uses > 1 THEN uses ELSE 0 END) AS segments_shared, sum(uses - 1) AS shared_hits, count(*) FILTER (uses > 1) AS shared_misses, count(*) FILTER (m <= {topology.SHORT_PATH}) AS segments_short, sum(uses * m) AS segment_points_in, sum(uses * n_out) AS segment_points_out, {_COUNTED} FROM w JOIN o USING (canonical))
  SELECT r.*, g.*, 0 AS snapped_rings, 0 AS snapped_vertices, 0 AS rings_fallback, 0 AS fallback_points FROM r, g""")
def simplify_stats(spark, sf_dir):
    """All counters of one simplification."""
    base = topology.prepare_baseline(PATCHES.rings(spark, sf_dir))
    return topology.simplify_stats(base, topology.simplify_baseline(base, _EPSILON))


@query(f"WITH RECURSIVE {_chains_sql()}, {_simplified_sql(_EPSILON)} SELECT tz_idx, 0 AS poly_idx, hole_idx, count(*) AS n, string_agg(x || ' ' || y, ',' ORDER BY x, y) AS pts FROM s GROUP BY tz_idx, hole_idx")
def simplify_topology(spark, sf_dir):
    return _sorted_points(topology.simplify(PATCHES.rings(spark, sf_dir), _EPSILON))


@query(f"WITH RECURSIVE {_chains_sql()}, {_simplified_sql(5 * _EPSILON)} SELECT tz_idx, 0 AS poly_idx, hole_idx, count(*) AS n, string_agg(x || ' ' || y, ',' ORDER BY x, y) AS pts FROM s GROUP BY tz_idx, hole_idx")
def simplify_again(spark, sf_dir):
    """A second epsilon from the stored baseline: no ring is snapped or cut again."""
    base = topology.prepare_baseline(PATCHES.rings(spark, sf_dir))
    topology.simplify_baseline(base, _EPSILON)
    return _sorted_points(topology.simplify_baseline(base, 5 * _EPSILON).rings)


@query(f"WITH RECURSIVE {_chains_sql()} SELECT canonical, count(DISTINCT (tz_idx, hole_idx)) AS rings, any_value(m) AS n, min(x) FILTER (i = 0) AS x, min(y) FILTER (i = 0) AS y FROM c GROUP BY canonical HAVING bool_or(closed)".replace("SELECT canonical, count", "SELECT count").replace("GROUP BY canonical", "GROUP BY c.canonical"))
def enclosed_chains(spark, sf_dir):
    """Rings that share all their edges with another (an enclave and the hole it fills): one chain of two rings, from one start."""
    cut = topology.prepare_baseline(PATCHES.rings(spark, sf_dir)).cut
    closed = cut.where(F.element_at("pts", 1) == F.element_at("pts", -1)).groupBy("canonical")
    found = closed.agg(F.count(F.lit(1)).alias("rings"), F.first(F.size("pts")).cast("long").alias("n"), F.first(F.element_at("pts", 1)).alias("p"))
    return found.select("rings", "n", F.col("p.x").alias("x"), F.col("p.y").alias("y"))




@query(f"WITH {_TOPO} SELECT count(*) AS n FROM u WHERE n = 2 AND rings = 2 AND f = 1")
def shared_edges_count(spark, sf_dir):
    return topology.shared_edges(_patch_edges(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH e AS (SELECT * FROM {PATCHES.edges_sql()}), {_KEYED}, {_PAIRS} SELECT struct_extract(lo, 1) AS x0, struct_extract(lo, 2) AS y0, struct_extract(hi, 1) AS x1, struct_extract(hi, 2) AS y1 FROM u WHERE n = 2 AND rings = 2 AND f = 1")
def shared_edges(spark, sf_dir):
    return topology.shared_edges(_patch_edges(spark, sf_dir)).select(F.col("lo.x").alias("x0"), F.col("lo.y").alias("y0"), F.col("hi.x").alias("x1"), F.col("hi.y").alias("y1"))


@query(f"WITH e AS (SELECT * FROM {PATCHES.edges_sql()}), {_KEYED} SELECT ax AS x, ay AS y FROM k GROUP BY ax, ay HAVING count(DISTINCT (tz_idx, poly_idx, hole_idx)) > 2")
def fixed_vertices(spark, sf_dir):
    return topology.fixed_vertices(_patch_edges(spark, sf_dir))


@query(f"""WITH e AS (SELECT * FROM {PATCHES.edges_sql()}), {_KEYED},
  q AS (SELECT k.*, (SELECT max((o.tz_idx, o.poly_idx, o.hole_idx)) FROM k o WHERE o.ax = k.bx AND o.ay = k.by_ AND o.bx = k.ax AND o.by_ = k.ay AND (o.tz_idx, o.poly_idx, o.hole_idx) <> (k.tz_idx, k.poly_idx, k.hole_idx)) AS partner FROM k),
  n AS (SELECT {_RING}, max(edge_idx) + 1 AS n FROM k GROUP BY ALL),
  c AS (SELECT a.ax AS x, a.ay AS y FROM q a JOIN n USING ({_RING}) JOIN q b ON a.tz_idx = b.tz_idx AND a.poly_idx = b.poly_idx AND a.hole_idx = b.hole_idx AND b.edge_idx = (a.edge_idx + n.n - 1) % n.n WHERE a.partner IS DISTINCT FROM b.partner)
  SELECT x, y FROM c UNION SELECT ax, ay FROM k GROUP BY ax, ay HAVING count(DISTINCT (tz_idx, poly_idx, hole_idx)) > 2""")
def fixed_vertices_dedup(spark, sf_dir):
    return topology.fixed_for_dedup(_patch_edges(spark, sf_dir))


#: Each supplier's ring damaged in one of eight ways by its key: none, turned about, last corner not repeated, two corners
#: swapped, a corner doubled, three corners left, all corners on one spot, all on one line.
_DAMAGE = {1: "reverse(c)", 3: "concat(slice(c, 1, 3), slice(c, 8, 1), slice(c, 5, 3), slice(c, 4, 1), slice(c, 9, 25))", 4: "concat(slice(c, 1, 5), slice(c, 5, 29))", 5: "concat(slice(c, 1, 2), slice(c, 1, 1))", 6: "transform(c, p -> c[0])", 7: "transform(c, p -> named_struct('x', p.x, 'y', c[0].y))"}
_DAMAGED = """(SELECT tz_idx, CASE tz_idx // 2 % 8 WHEN 1 THEN list_reverse(c) WHEN 2 THEN c[1:32] WHEN 3 THEN list_concat(c[1:3], c[8:8], c[5:7], c[4:4], c[9:33]) WHEN 4 THEN list_concat(c[1:5], c[5:33])
    WHEN 5 THEN list_concat(c[1:2], c[1:1]) WHEN 6 THEN list_transform(c, lambda p: c[1]) WHEN 7 THEN list_transform(c, lambda p: {'x': p.x, 'y': c[1].y}) ELSE c END AS c
    FROM (SELECT tz_idx, list_append(list({'x': x, 'y': y} ORDER BY idx), {'x': min(x) FILTER (idx = 0), 'y': min(y) FILTER (idx = 0)}) AS c FROM """ + PATCHES.points_sql() + " WHERE tz_idx % 2 = 0 AND hole_idx < 0 GROUP BY tz_idx))"


def damaged_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = PATCHES.rings(spark, sf_dir).where("tz_idx % 2 = 0 and hole_idx < 0")
    closed = settled(own.withColumn("c", G.close_ring(F.col("pts"))))
    kind = F.expr("tz_idx div 2 % 8")
    pts = F.when(kind == 2, F.slice("c", 1, 32))
    for k, sql in _DAMAGE.items():
        pts = pts.when(kind == k, F.expr(sql))
    return settled(closed.withColumn("pts", pts.otherwise(F.col("c"))).drop("c"))


_OPENED = f"w AS (SELECT * FROM {_DAMAGED}), o AS (SELECT tz_idx, CASE WHEN len(c) > 1 AND c[1] = c[-1] THEN c[1 : len(c) - 1] ELSE c END AS p FROM w), e AS (SELECT tz_idx, i - 1 AS i, p[i].x AS xa, p[i].y AS ya, p[i % len(p) + 1].x AS xb, p[i % len(p) + 1].y AS yb, len(p) AS n FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM o))"


def _turn(a: str, b: str, c: str) -> str:
    at = {"a": ("a.xa", "a.ya"), "b": ("a.xb", "a.yb"), "c": ("b.xa", "b.ya"), "d": ("b.xb", "b.yb")}
    (ax, ay), (bx, by_), (cx, cy) = at[a], at[b], at[c]
    return f"sign(cast({bx} - {ax} AS double) * ({cy} - {ay}) - cast({by_} - {ay} AS double) * ({cx} - {ax}))"


_CROSSED = f"""x AS (SELECT DISTINCT a.tz_idx, a.i AS i, b.i AS j FROM e a JOIN e b ON a.tz_idx = b.tz_idx AND b.i - a.i > 1 AND NOT (a.i = 0 AND b.i = a.n - 1)
    AND least(a.xa, a.xb) <= greatest(b.xa, b.xb) AND least(b.xa, b.xb) <= greatest(a.xa, a.xb) AND least(a.ya, a.yb) <= greatest(b.ya, b.yb) AND least(b.ya, b.yb) <= greatest(a.ya, a.yb)
    AND (({_turn('a', 'b', 'c')} <> {_turn('a', 'b', 'd')} AND {_turn('c', 'd', 'a')} <> {_turn('c', 'd', 'b')}) OR ({_turn('a', 'b', 'c')} = 0 AND {_turn('a', 'b', 'd')} = 0)))"""


@query(f"""WITH {_OPENED}, {_CROSSED}, g AS (SELECT tz_idx, sum(cast(xa AS double) * yb - cast(xb AS double) * ya) / 2 AS area FROM e GROUP BY tz_idx),
  k AS (SELECT tz_idx, least((xa, ya), (xb, yb)) AS lo, greatest((xa, ya), (xb, yb)) AS hi, CASE WHEN (xa, ya) <= (xb, yb) THEN 1 ELSE 0 END AS f FROM e),
  same AS (SELECT DISTINCT tz_idx FROM k WHERE (lo, hi) IN (SELECT (lo, hi) FROM k GROUP BY lo, hi HAVING count(*) = 2 AND sum(f) <> 1))
  SELECT tz_idx, -1 AS hole_idx, rule FROM (SELECT tz_idx, 'fewer than 4 points' AS rule FROM w WHERE len(c) < 4 UNION ALL SELECT tz_idx, 'not closed' FROM w WHERE len(c) > 0 AND c[1] <> c[-1] UNION ALL SELECT tz_idx, 'fewer than 3 different points' FROM w WHERE len(list_distinct(c)) < 3
    UNION ALL SELECT tz_idx, 'no area' FROM g WHERE abs(area) <= 1e-12 UNION ALL SELECT tz_idx, 'clockwise winding' FROM g WHERE area < -1e-12 UNION ALL SELECT DISTINCT tz_idx, 'zero-length edge' FROM e WHERE xa = xb AND ya = yb UNION ALL SELECT DISTINCT tz_idx, 'self intersects' FROM x UNION ALL SELECT tz_idx, 'same direction' FROM same)""")
def validate_rules(spark, sf_dir):
    """Every rule, on the rings of suppliers damaged in eight ways."""
    return topology.violations(damaged_rings(spark, sf_dir)).select("tz_idx", "hole_idx", "rule")


@query(f"WITH {_OPENED}, {_CROSSED} SELECT tz_idx, i, j FROM x")
def self_intersections(spark, sf_dir):
    return R.self_intersections(R.edges(damaged_rings(spark, sf_dir))).select("tz_idx", "i", "j")


_SORTED = "count(*) AS n, string_agg(xa || ' ' || ya, ',' ORDER BY xa, ya) AS pts"


def _sorted_points(rings: DataFrame) -> DataFrame:
    """Rings as their points in order of place: the same whatever vertex a ring starts at."""
    pts = F.transform(F.array_sort(G.open_ring(F.col("pts"))), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return rings.select(*R.RING, F.size(pts).cast("long").alias("n"), F.array_join(pts, ",").alias("pts"))


@query(f"SELECT tz_idx, poly_idx, hole_idx, {_SORTED} FROM {_E} GROUP BY tz_idx, poly_idx, hole_idx")
def dedup_round_trip(spark, sf_dir):
    return _sorted_points(topology.expand(*topology.deduplicate(PATCHES.rings(spark, sf_dir))))


@query(f"SELECT tz_idx, poly_idx, hole_idx, string_agg(xa || ' ' || ya, ',' ORDER BY edge_idx) AS pts FROM {_E} GROUP BY tz_idx, poly_idx, hole_idx")
def polyline_round_trip(spark, sf_dir):
    rows = pipeline.decompress(pipeline.compress(PATCHES.rings(spark, sf_dir)))
    return rows.select(*R.RING, F.array_join(F.transform("pts", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("pts"))


# Audit

#: Smaller zones, one for each supplier.
FINE = X.Patches("supplier", "s_suppkey", most=60_000, south=-4_000_000)
_FINE_EPSILON = 0.01
_BINS = "b AS (SELECT user_id % 10 AS g, cast(round(value / cast(0.1 AS double)) AS bigint) AS bin, sum(cast(1 + event_id % 3 AS double)) AS weight FROM events GROUP BY ALL)"


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), "value", (1 + F.col("event_id") % 3).cast("double").alias("weight"))
    return audit.weighted_bins(rows, "g")


@query(f"WITH {_BINS}, r AS (SELECT g, bin, sum(weight) OVER (PARTITION BY g ORDER BY bin) AS run, sum(weight) OVER (PARTITION BY g) AS total FROM b) SELECT g, round(min(bin) * cast(0.1 AS double), 4) AS p95 FROM r WHERE run >= 0.95 * total GROUP BY g")
def weighted_quantile(spark, sf_dir):
    return audit.weighted_quantile(_bins(spark, sf_dir), 0.95, "g").select("g", F.round("quantile", 4).alias("p95"))


@query(f"WITH {_BINS} SELECT g, round(sum(CASE WHEN bin * cast(0.1 AS double) > 50 THEN weight ELSE 0 END) / sum(weight), 6) AS share FROM b GROUP BY g")
def proportion_above(spark, sf_dir):
    return audit.proportion_above(_bins(spark, sf_dir), 50.0, "g").select("g", F.round("proportion", 6).alias("share"))


@query("SELECT event_type || '+' || (user_id % 7) AS pair, cast(count(*) AS double) AS area FROM events GROUP BY ALL ORDER BY area DESC, pair LIMIT 20")
def top_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").groupBy(F.concat_ws("+", "event_type", (F.col("user_id") % 7).cast("string")).alias("pair")).agg(F.count(F.lit(1)).cast("double").alias("area"))
    return audit.top_pairs(pairs)


def _unit(x: str, y: str) -> str:
    """Unit vector of a scaled place."""
    return f"[cos(radians({y} / 1e5)) * cos(radians({x} / 1e5)), cos(radians({y} / 1e5)) * sin(radians({x} / 1e5)), sin(radians({y} / 1e5))]"


def _off(p: str, a: str, b: str) -> str:
    """Metres from unit vector p to the nearest place of the segment from a to b."""
    t = f"CASE WHEN {a} = {b} THEN 0.0::double ELSE greatest(0.0::double, least(1.0::double, list_dot_product({_minus(p, a)}, {_minus(b, a)}) / list_dot_product({_minus(b, a)}, {_minus(b, a)}))) END"
    near = f"[{', '.join(f'{a}[{i}] + t * ({b}[{i}] - {a}[{i}])' for i in (1, 2, 3))}]"
    unit = "list_transform(q, lambda c: c / sqrt(list_dot_product(q, q)))"
    return f"list_transform([{t}], lambda t: list_transform([{near}], lambda q: {_metres(f'list_distance({p}, {unit})')})[1])[1]"


def _minus(a: str, b: str) -> str:
    return f"[{', '.join(f'{a}[{i}] - {b}[{i}]' for i in (1, 2, 3))}]"


def _metres(chord: str) -> str:
    return f"2 * asin(least(1.0, {chord} / 2)) * {audit.RADIUS_M}"


_BAND = "radians((bx - ax) / 1e5) * (2 + sin(radians(ay / 1e5)) + sin(radians(by_ / 1e5)))"


def _audit_sql(epsilon: float) -> str:
    """CTEs after the simplification's: g, the densified segments of each different arc (w 0) and its chord (w 1) in order o; m, its length and area."""
    wide = f"{_metres('list_distance(va, vb)')} > {audit.MAX_CHORD_M} OR {_off('vm', 'va', 'vb')} > {audit.SAGITTA_M / 2}"
    return f"""{_chains_sql(FINE)}, {_simplified_sql(epsilon)},
  a0 AS (SELECT s.tz_idx, s.hole_idx, s.pos AS p0, coalesce(lead(s.pos) OVER w, min(s.pos) OVER (PARTITION BY s.tz_idx, s.hole_idx) + 32) AS p1 FROM s WINDOW w AS (PARTITION BY s.tz_idx, s.hole_idx ORDER BY s.pos)),
  ap AS (SELECT a0.tz_idx, a0.hole_idx, p0, v.pos + 32 * r.r - p0 AS q, x, y FROM a0 JOIN v ON v.tz_idx = a0.tz_idx AND v.hole_idx = a0.hole_idx CROSS JOIN range(2) r(r) WHERE v.pos + 32 * r.r BETWEEN p0 AND p1),
  al AS (SELECT tz_idx, hole_idx, p0, list({{'x': x, 'y': y}} ORDER BY q) AS f, list({{'x': x, 'y': y}} ORDER BY q DESC) AS r FROM ap GROUP BY ALL),
  arcs AS MATERIALIZED (SELECT row_number() OVER () AS id, c, len(c) AS n FROM (SELECT DISTINCT least(f, r) AS c FROM al)),
  e0 AS MATERIALIZED (SELECT id, 0 AS w, cast(i AS double) AS o, c[i].x AS ax, c[i].y AS ay, c[i + 1].x AS bx, c[i + 1].y AS by_ FROM (SELECT *, unnest(range(1, n)) AS i FROM arcs) UNION ALL SELECT id, 1, 1.0, c[1].x, c[1].y, c[n].x, c[n].y FROM arcs),
  g0(id, w, o, span, ax, ay, bx, by_, va, vb, wide) AS (SELECT id, w, o, 1.0::double, ax, ay, bx, by_, va, vb, {wide} FROM (SELECT id, w, o, ax::double AS ax, ay::double AS ay, bx::double AS bx, by_::double AS by_, {_unit('ax', 'ay')} AS va, {_unit('bx', 'by_')} AS vb, {_unit('((ax + bx) / 2.0)', '((ay + by_) / 2.0)')} AS vm FROM e0)
    UNION ALL SELECT id, w, o, span, ax, ay, bx, by_, va, vb, {wide} FROM (SELECT *, {_unit('ax', 'ay')} AS va, {_unit('bx', 'by_')} AS vb, {_unit('((ax + bx) / 2.0)', '((ay + by_) / 2.0)')} AS vm FROM
      (SELECT id, w, o + h * span / 2 AS o, span / 2 AS span, CASE WHEN h = 0 THEN ax ELSE (ax + bx) / 2 END AS ax, CASE WHEN h = 0 THEN ay ELSE (ay + by_) / 2 END AS ay, CASE WHEN h = 1 THEN bx ELSE (ax + bx) / 2 END AS bx, CASE WHEN h = 1 THEN by_ ELSE (ay + by_) / 2 END AS by_ FROM g0, (VALUES (0), (1)) r(h) WHERE wide))),
  g AS MATERIALIZED (SELECT id, w, o, row_number() OVER (PARTITION BY id, w ORDER BY o) AS k, ax, ay, bx, by_, va, vb FROM g0 WHERE NOT wide),
  m AS (SELECT id, n, length, area FROM arcs JOIN (SELECT id, sum({_metres('list_distance(va, vb)')}) AS length FROM g WHERE w = 0 GROUP BY id) USING (id)
    JOIN (SELECT id, abs(sum(CASE WHEN w = 0 THEN 1 ELSE -1 END * {_BAND})) * {audit.RADIUS_M**2 / 2} AS area FROM e0 GROUP BY id) USING (id))"""


def _audited(spark: SparkSession, sf_dir: str, *figures: str) -> DataFrame:
    """Arcs of the suppliers' zones against their simplification."""
    base = topology.prepare_baseline(FINE.rings(spark, sf_dir))
    return settled(audit.analyse(base.ready, topology.simplify_baseline(base, _FINE_EPSILON).rings, figures))


_FAR = f"SELECT p.id, p.v, min({_off('p.v', 'g.va', 'g.vb')}) AS far FROM (SELECT id, w, va AS v FROM g JOIN m USING (id) WHERE n > 2 UNION ALL SELECT id, w, vb FROM g JOIN m USING (id) WHERE n > 2) p JOIN g ON g.id = p.id AND g.w <> p.w GROUP BY ALL"


@query(f"""WITH RECURSIVE {_audit_sql(_FINE_EPSILON)}, f AS ({_FAR})
  SELECT count(*) AS unique_arcs, count(*) FILTER (area > 1e-6 AND n > 2) AS changed_arcs, round(sum(length) / 1000, 2) AS length_km, round(sum(CASE WHEN area > 1e-6 AND n > 2 THEN length ELSE 0 END) / 1000, 2) AS changed_length_km, round(sum(CASE WHEN n > 2 THEN area ELSE 0 END) / 1e6, 1) AS area_km2, (SELECT round(max(far), 1) FROM f) AS max_m FROM m""")
def border_audit(spark, sf_dir):
    """Totals of the audit: different arcs, their lengths, the area between, the greatest displacement."""
    r = audit.report(_audited(spark, sf_dir, "max"))
    return r.select("unique_arcs", "changed_arcs", *[F.round(c, n).alias(c) for c, n in (("length_km", 2), ("changed_length_km", 2), ("area_km2", 1), ("max_m", 1))])


_SHARES = (100, 1000, 5000)


def _spread_sql(samples: str) -> str:
    """Quantiles and shares of samples (value, weight) in bins."""
    quantiles = ", ".join(f"round(min(bin) FILTER (run >= {q} * total) * cast(0.1 AS double), 1) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999")))
    shares = ", ".join(f"round(sum(CASE WHEN bin * cast(0.1 AS double) > {t} THEN weight ELSE 0 END) / max(total), 5) AS above_{t}" for t in _SHARES)
    return f"bins AS (SELECT cast(round(value / 0.1::double) AS bigint) AS bin, sum(weight) AS weight FROM ({samples}) WHERE weight > 0 GROUP BY 1), runs AS (SELECT *, sum(weight) OVER (ORDER BY bin) AS run, sum(weight) OVER () AS total FROM bins) SELECT {quantiles}, {shares} FROM runs"


def _spread(bins: DataFrame) -> DataFrame:
    bins = settled(bins)
    one = F.lit(1).alias("one")
    out = bins.agg(one)
    for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999")):
        out = out.join(audit.weighted_quantile(bins.withColumn("one", F.lit(1)), q, "one").select("one", F.round("quantile", 1).alias(name)), "one")
    for t in _SHARES:
        out = out.join(audit.proportion_above(bins.withColumn("one", F.lit(1)), t, "one").select("one", F.round("proportion", 5).alias(f"above_{t}")), "one")
    return out.drop("one")


_MIDDLE = "[(va[1] + vb[1]) / h, (va[2] + vb[2]) / h, (va[3] + vb[3]) / h]"
_DISPLACED = f"""SELECT min({_off('p.v', 'g.va', 'g.vb')}) AS value, any_value(p.weight) AS weight FROM (SELECT id, w, o, {_MIDDLE} AS v, {_metres('list_distance(va, vb)')} AS weight FROM (SELECT *, sqrt(pow(va[1] + vb[1], 2) + pow(va[2] + vb[2], 2) + pow(va[3] + vb[3], 2)) AS h FROM g) JOIN m USING (id) WHERE n > 2) p
  JOIN g ON g.id = p.id AND g.w <> p.w GROUP BY p.id, p.w, p.o UNION ALL SELECT 0.0, 2 * length FROM m WHERE n = 2"""


@query(f"WITH RECURSIVE {_audit_sql(_FINE_EPSILON)}, {_spread_sql(_DISPLACED)}")
def border_displacement(spark, sf_dir):
    """How far borders moved, by length: quantiles, and shares beyond some metres."""
    return _spread(audit.displacement_bins(_audited(spark, sf_dir, "samples")))


_TRIANGLE = "abs(" + " + ".join(f"radians(({b}x - {a}x) / 1e5) * (2 + sin(radians({a}y / 1e5)) + sin(radians({b}y / 1e5)))" for a, b in (("p", "q"), ("q", "r"), ("r", "p"))) + f") * {audit.RADIUS_M**2 / 2}"
_WIDTHS = f"""SELECT value, weight * area / sum(weight) OVER (PARTITION BY id) AS weight FROM (SELECT t.id, t.k, any_value(t.area) AS area, any_value(t.weight) AS weight, min({_off('t.v', 'g.va', 'g.vb')}) AS value FROM
  (SELECT *, [(v0[1] + va[1] + vb[1]) / h, (v0[2] + va[2] + vb[2]) / h, (v0[3] + va[3] + vb[3]) / h] AS v FROM (SELECT *, {_TRIANGLE} AS weight, sqrt(pow(v0[1] + va[1] + vb[1], 2) + pow(v0[2] + va[2] + vb[2], 2) + pow(v0[3] + va[3] + vb[3], 2)) AS h FROM
    (SELECT g.id, g.k, m.area, f.va AS v0, g.va, g.vb, f.ax AS px, f.ay AS py, g.ax AS qx, g.ay AS qy, g.bx AS rx, g.by_ AS ry FROM g JOIN m USING (id) JOIN g f ON f.id = g.id AND f.w = 0 AND f.k = 1 WHERE g.w = 0 AND g.k > 1 AND m.n > 2 AND m.area > 1e-6)) WHERE weight > 0) t
  JOIN g ON g.id = t.id AND g.w = 0 GROUP BY t.id, t.k)"""


@query(f"WITH RECURSIVE {_audit_sql(_FINE_EPSILON)}, {_spread_sql(_WIDTHS)}")
def strip_widths(spark, sf_dir):
    """How wide the strips between borders and their simplification are, by area: triangles fanned over each arc."""
    return _spread(audit.width_bins(_audited(spark, sf_dir, "widths")))


@query(f"WITH RECURSIVE {_audit_sql(_FINE_EPSILON)} SELECT CASE WHEN len(names) = 1 THEN names[1] || '+{audit.OUTSIDE}' ELSE array_to_string(names, '+') END AS pair, round(sum(area) / 1e6, 2) AS area FROM (SELECT m.id, any_value(m.area) AS area, list_sort(list(DISTINCT z.name)) AS names FROM m JOIN arcs USING (id) JOIN al ON least(al.f, al.r) = arcs.c JOIN {FINE.zones_sql()} USING (tz_idx) WHERE m.area > 1e-6 AND m.n > 2 GROUP BY m.id) GROUP BY ALL")
def pair_areas(spark, sf_dir):
    """Square kilometres that changed between each two zones."""
    return audit.pair_areas(_audited(spark, sf_dir)).select("pair", F.round("area", 2).alias("area"))


# Sources, sinks and reports


_QUANTISED = ", ".join(f"cast(round(cast(cast({c} / 1e5 AS float) AS double) * 100000) AS bigint) AS {c}" for c in ("xa", "ya"))


@query(f"SELECT tz_idx, poly_idx, hole_idx, {_SORTED} FROM (SELECT dense_rank() OVER (ORDER BY tz_idx) - 1 AS tz_idx, poly_idx, hole_idx, {_QUANTISED} FROM {_E}) GROUP BY tz_idx, poly_idx, hole_idx")
def geojson_round_trip(spark, sf_dir):
    """Zones written as one FeatureCollection and read again (numbered by place), through degrees of 32 bits as boundaries are stored."""
    return _sorted_points(J.parse_features(J.feature_collection(PATCHES.rings(spark, sf_dir))))


@query("SELECT event_id AS pt_id, cast(event_id % 360 - 180 AS double) AS lng, cast(event_id % 180 - 90 AS double) AS lat FROM events")
def point_lines(spark, sf_dir):
    line = F.concat((F.col("event_id") % 180 - 90).cast("string"), F.element_at(F.array(*map(F.lit, (" ", "\t", ",", "; "))), (F.col("event_id") % 4 + 1).cast("int")), (F.col("event_id") % 360 - 180).cast("string"))
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("pt_id"), line.alias("value"))
    return J.parse_point_lines(lines, "lat-lng").select("pt_id", "lng", "lat")


@query(f"SELECT x, y, z, 5 AS n, round(x / pow(2, z) * 360 - 180, 6) AS west, round((x + 1) / pow(2, z) * 360 - 180, 6) AS east, round(degrees(atan((exp(pi() * (1 - 2 * y / pow(2, z))) - exp(-pi() * (1 - 2 * y / pow(2, z)))) / 2)), 6) AS north FROM (SELECT DISTINCT x, y, z FROM {_TABLE_TILES})")
def tile_geojson(spark, sf_dir):
    """One feature for each different tile; each is a closed ring of five corners."""
    drawn = tiles.tile_features(table_tiles(spark, sf_dir))
    ring = F.from_json(F.get_json_object("feature", "$.geometry.coordinates[0]"), "array<array<double>>")
    at = lambda k: F.transform(ring, lambda c: c[k])
    return drawn.select("x", "y", "z", F.size(ring).alias("n"), F.round(F.array_min(at(0)), 6).alias("west"), F.round(F.array_max(at(0)), 6).alias("east"), F.round(F.array_max(at(1)), 6).alias("north"))


@query(f"SELECT name, count(*) AS n_tiles, round(min(x / pow(2, z) * 360 - 180), 6) AS west, round(max((x + 1) / pow(2, z) * 360 - 180), 6) AS east FROM {_TABLE_TILES} GROUP BY name")
def fuzzy_geojson(spark, sf_dir):
    """Each name's tiles as one MultiPolygon: how many, and how far they reach."""
    drawn = finder.FuzzyFinder(table_tiles(spark, sf_dir), 3, 9).geojson()
    parts = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<array<array<double>>>>")
    lng = F.flatten(F.transform(parts, lambda p: F.transform(p[0], lambda c: c[0])))
    return drawn.select(F.get_json_object("feature", "$.properties.tzid").alias("name"), F.size(parts).cast("long").alias("n_tiles"), F.round(F.array_min(lng), 6).alias("west"), F.round(F.array_max(lng), 6).alias("east"))


#: Boxes of a lattice, one a supplier; odd ones have their sides' quarters as vertices, which their even neighbours lack.  A quarter (p)
#: is half a degree, or less where the boxes would not fit between the meridians of 0 and 180 degrees.
_LATTICE = """SELECT 2 * k AS tz_idx, unnest(range(16)) AS i, p, k % w * 4 * p AS x0, k // w * 4 * p AS y0, (k % w + k // w) % 2 = 1 AS fine FROM (SELECT *, least(50000, 4500000 // w) AS p FROM (SELECT cast(s_suppkey AS bigint) AS k, cast(ceil(sqrt((SELECT max(s_suppkey) + 1 FROM supplier))) AS bigint) AS w FROM supplier))"""
_CORNER = "x0 + CASE i {d} 4 WHEN 0 THEN p * (i % 4) WHEN 1 THEN 4 * p WHEN 2 THEN 4 * p - p * (i % 4) ELSE 0 END AS x", "y0 + CASE i {d} 4 WHEN 0 THEN 0 WHEN 1 THEN p * (i % 4) WHEN 2 THEN 4 * p ELSE 4 * p - p * (i % 4) END AS y"


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    w = math.ceil(math.sqrt(1 + (k.agg(F.max("k")).first()[0] or 0)))
    p = min(50_000, 4_500_000 // w)
    each = k.selectExpr("k", f"{p}L AS p", f"k % {w} * {4 * p}L AS x0", f"k div {w} * {4 * p}L AS y0", f"(k % {w} + k div {w}) % 2 = 1 AS fine")
    corner = "transform(filter(sequence(0L, 15L), i -> fine or i % 4 = 0), i -> named_struct('x', {}, 'y', {}))".format(*(c.format(d="div").rpartition(" AS ")[0] for c in _CORNER))
    return each.selectExpr("cast(2 * k AS int) AS tz_idx", "concat('box/', k) AS name", "0 AS poly_idx", "-1 AS hole_idx", f"{corner} AS pts")


@query(f"""WITH p AS (SELECT tz_idx, i, {_CORNER[0].format(d="//")}, {_CORNER[1].format(d="//")}, fine FROM ({_LATTICE})), v AS (SELECT * FROM p WHERE fine OR i % 4 = 0)
  SELECT tz_idx, string_agg(x || ' ' || y, ',' ORDER BY i) AS pts FROM p WHERE fine OR i % 4 = 0 OR (x, y) IN (SELECT (x, y) FROM v) GROUP BY tz_idx""")
def snap_vertices(spark, sf_dir):
    """Plain boxes take the vertices that their neighbours have on the common sides."""
    snapped = topology.snap_vertices(topology.clean_rings(lattice(spark, sf_dir)))
    return snapped.select("tz_idx", F.array_join(F.transform("pts", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("pts"))


@query(f"WITH {_TOPO}, s AS (SELECT count(*) AS n FROM u WHERE n = 2 AND rings = 2 AND f = 1 AND NOT (struct_extract(lo, 1) = 18000000 AND struct_extract(hi, 1) = 18000000)), a AS (SELECT count(*) AS n FROM e) SELECT s.n AS shared_edges, a.n AS ring_points FROM s, a")
def compressed_sharing(spark, sf_dir):
    """Shared edges in the library (the two sides of the antimeridian differ by a turn), and ring points, after compression of the deduplicated dataset and back."""
    segments, library = pipeline.decompress_topology(*pipeline.compress_topology(*topology.deduplicate(PATCHES.rings(spark, sf_dir))))
    segments, library = settled(segments), settled(library)
    edges = library.agg(F.lit(1).alias("one"), F.sum(F.size("pts") - 1).alias("shared_edges"))
    return edges.join(topology.expand(segments, library).agg(F.lit(1).alias("one"), F.sum(F.size("pts")).alias("ring_points")), "one").drop("one")  # one row each


#: A ring of 128 corners for each supplier: every zone's rim, each side's parts halved three times, so that the classic reduction applies.
def _fine_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = PATCHES.rings(spark, sf_dir)
    part = "transform(sequence(0, 127), n -> named_struct('x', ({0}.x * (4 - n % 4) + {1}.x * (n % 4)) div 4, 'y', ({0}.y * (4 - n % 4) + {1}.y * (n % 4)) div 4))".format("pts[n div 4]", "pts[(n div 4 + 1) % 32]")
    return own.withColumn("pts", F.expr(part))


_FINE = f"(SELECT tz_idx, hole_idx, n AS i, CASE WHEN ax < 0 THEN -((-ax) // 4) ELSE ax // 4 END AS x, CASE WHEN ay < 0 THEN -((-ay) // 4) ELSE ay // 4 END AS y FROM (SELECT tz_idx, hole_idx, edge_idx * 4 + t AS n, xa * (4 - t) + xb * t AS ax, ya * (4 - t) + yb * t AS ay FROM {_E}, range(4) r(t)))"
_CLASSIC = f"""u AS (SELECT tz_idx || ':' || hole_idx AS canonical, 128 AS m, i, x, y, false AS closed FROM {_FINE})"""


@query(f"""WITH RECURSIVE {_CLASSIC}, {_simplified_sql(_EPSILON).partition("closed FROM c),")[2].partition(", s AS (")[0].strip().rstrip(",").rpartition("  s AS (")[0].strip().rstrip(",")}
  SELECT (SELECT count(DISTINCT tz_idx) FROM {_E}) AS zones_before, (SELECT count(DISTINCT tz_idx) FROM {_E} WHERE hole_idx >= 0) AS holes_before, (SELECT count(*) FROM u) AS points_before, (SELECT count(DISTINCT tz_idx) FROM {_E}) AS zones_after, (SELECT count(DISTINCT tz_idx) FROM {_E} WHERE hole_idx >= 0) AS holes_after,
    count(*) AS points_after, round(100 * (1 - count(*) / (SELECT count(*) FROM u)), 2) AS points_removed_percent FROM kept""")
def reduction_report(spark, sf_dir):
    """Rings of 128 vertices before and after the classic reduction, each ring by itself."""
    rings = _fine_rings(spark, sf_dir)
    return topology.reduction_report(rings, topology.reduce_classic(rings, _EPSILON))


@query(f"SELECT tz_idx, min(xa) AS min_x, min(ya) AS min_y, max(xa) AS max_x, max(ya) AS max_y FROM {_E} GROUP BY tz_idx")
def compressed_bounds(spark, sf_dir):
    """Boxes from the bytes of the compressed topology, each shared edge's once, against those of the rings."""
    return pipeline.compressed_bounds(*map(settled, pipeline.compress_topology(*topology.deduplicate(PATCHES.rings(spark, sf_dir)))))


@query(_GRID.replace(" WHERE hole_idx < 0", "") + " SELECT cell_lng, cell_lat, tz_idx, count(*) OVER (PARTITION BY cell_lng, cell_lat) AS n_cand FROM g")
def compressed_grid(spark, sf_dir):
    """The grid that travels with the compressed topology."""
    return pipeline.compressed_grid(*map(settled, pipeline.compress_topology(*topology.deduplicate(PATCHES.rings(spark, sf_dir)))))
