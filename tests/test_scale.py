"""What must not grow faster than the tables: joins that are dealt, cells of the boxes' size."""

from pyspark.sql import functions as F

from meridia.operators import rings as R
from meridia.operators import tiles
from meridia.plans.queries import PATCHES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_and_edges_are_not_broadcast(spark, sf):  # F1
    e = R.edges(PATCHES.rings(spark, sf))
    points = e.select(F.col("tz_idx").alias("t"), F.col("edge_idx").alias("at"), F.col("xa").cast("double").alias("px"), F.col("ya").cast("double").alias("py"))
    plan = plan_of(tiles.strictly_inside(points, e, ["t", "at"], "t"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_crossed_tiles_of_short_and_long_edges(spark):  # F1
    edges = [(0, 0, -1, 0, 10, 10, 900, 700), (0, 0, -1, 1, -17_900_000, -8_000_000, 17_900_000, 8_100_000), (1, 0, -1, 0, 2_812_500, 0, 2_812_500, 90_000), (1, 0, -1, 1, 17_999_990, 8_990_000, 18_000_000, 9_000_000)]
    table = spark.createDataFrame(edges, "tz_idx int, poly_idx int, hole_idx int, edge_idx int, xa bigint, ya bigint, xb bigint, yb bigint")
    n = F.lit(7)
    every = spark.range(1 << 14).select((F.col("id") % 128).alias("x"), F.floor(F.col("id") / 128).cast("long").alias("y")).select(F.explode(F.array(tiles._tile(F.col("x"), F.col("y"), n))).alias("t"))
    wanted = table.crossJoin(every).where(tiles.edge_meets_tile(F.col("t"))).select("tz_idx", "poly_idx", "t.x", "t.y").distinct()
    assert sorted(map(tuple, tiles.crossing_tiles(table, 7).collect())) == sorted(map(tuple, wanted.collect()))


def square(t, x, y, w, n=16):
    side = [(x + w * i // n, y) for i in range(n)] + [(x + w, y + w * i // n) for i in range(n)] + [(x + w - w * i // n, y + w) for i in range(n)] + [(x, y + w - w * i // n) for i in range(n)]
    return (t, str(t), 0, -1, side)


def test_zones_within_zones_meet_few_edges(spark):  # F5
    import inspect

    from meridia.sources import fixtures as X

    rows = [square(0, 0, 0, 90_000), square(1, 10_000, 10_000, 20_000), square(2, 12_000, 12_000, 4_000), square(3, 60_000, 60_000, 30_000), square(4, 100_000, 0, 90_000)]
    rings = X.rings(spark, rows)
    assert sorted(map(tuple, tiles.containing_zones(rings).collect())) == [(0, 1), (0, 2), (1, 2)]  # 3 touches the rim of 0
    assert "near.meeting" in inspect.getsource(tiles.containing_zones)


def test_cells_follow_the_density(spark):  # F12, with F10, F11 and F14
    """Four times as many boxes in one degree: what meets grows with them, not with their square."""
    from meridia.operators import near

    def pairs(n):
        w = 80_000 // n
        e = R.edges(spark.createDataFrame([(k, str(k), 0, -1, [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]) for k in range(n * n) for x, y in [(k % n * w, k // n * w)]], "tz_idx int, name string, poly_idx int, hole_idx int, pts array<struct<x:bigint,y:bigint>>"))
        cells = near.placed(e, F.least("xa", "xb"), F.least("ya", "yb"), F.greatest("xa", "xb"), F.greatest("ya", "yb"), 100_000)
        return near.meeting(e.select(F.col("xa").alias("px"), F.col("ya").alias("py")).distinct(), F.col("px"), F.col("py"), cells).count()

    assert pairs(20) < 6 * pairs(10)


def test_lattice_stays_on_the_globe(spark, tmp_path):  # F4
    """Beyond 90 boxes a row their sides shrink: none is wrapped round, and the query equals its SQL."""
    from oracle import oracle, spark_rows

    from meridia.plans.queries import SQL, Q

    spark.range(0, 9_000, 25).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    folder = str(tmp_path)
    assert spark_rows(Q["snap_vertices"](spark, folder)) == oracle(SQL["snap_vertices"].replace("FROM supplier", f"FROM read_parquet('{folder}/supplier.parquet/*.parquet')"), folder)


def test_stripes_hold_only_rings_that_matter(spark):  # F13
    """A ring that lies beside one stripe is not repeated in all stripes of its cell."""
    from meridia.operators import finder

    rings = spark.createDataFrame([square(k, k % 8 * 12_000, k // 8 * 12_000, 11_000, 8) for k in range(64)], "tz_idx int, name string, poly_idx int, hole_idx int, pts array<struct<x:bigint,y:bigint>>")
    cells, stripes = finder.build_index(rings.select("tz_idx", "name"), R.edges(rings))
    n_stripes = cells.agg(F.sum("n_stripes")).first()[0]
    held = stripes.agg(F.sum(F.size("zones"))).first()[0]
    assert held < 64 * n_stripes / 3


def test_reference_path_meets_rings_by_their_boxes(spark, sf):  # F2
    from meridia.operators import finder

    rings = PATCHES.rings(spark, sf)
    points = R.edges(rings).select((F.col("tz_idx") * 64 + F.col("edge_idx")).alias("pt_id"), F.col("xa").alias("px"), F.col("ya").alias("py"))
    plan = plan_of(finder.float_first(points, rings))
    assert "size#" in plan and plan.count("SortMergeJoin") >= 4


def test_small_arcs_meet_all_segments_as_runs_do(monkeypatch):  # F3, F6, F7
    import numpy as np

    from meridia.operators import audit

    rng = np.random.default_rng(3)
    line, points = (audit._vectors(rng.integers(0, 50_000, (n, 2)).astype(float)) for n in (100, 60))
    at_once = audit.nearest(points, line)
    monkeypatch.setattr(audit, "SMALL_PAIRS", 0)
    assert all(np.array_equal(a, b) for a, b in zip(at_once, audit.nearest(points, line), strict=True))


def test_only_the_figures_asked_for_are_measured(spark, sf):  # F3, F7, F9
    from meridia.operators import audit
    from meridia.plans import queries

    row = queries._audited(spark, sf, "widths").where("widths is not null and size(widths) > 0").first()
    assert row["max_m"] is None and row["samples"] is None and row["area_m2"] > 0
    assert audit.FIGURES == ("max", "samples", "widths")


def brute_preindex(rows, zoom, least, keep, drop, boxes):
    """The pre-index by every tile of the world against every ring, with the operator's own predicates in floats."""
    import math

    def strictly(ring, px, py):
        odd = False
        for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if not min(ya, yb) <= py <= max(ya, yb):
                continue
            if (min(xa, xb) <= px <= max(xa, xb)) if ya == yb else (px - xa) * (yb - ya) == (py - ya) * (xb - xa):
                return False
            odd ^= ya != yb and py < max(ya, yb) and px < xa + (py - ya) * (xb - xa) / (yb - ya)
        return odd

    def corners(x, y, z):
        lng = [(x + a) / 2**z * 36_000_000 - 18_000_000 for a in (0, 1)]
        lat = [1e5 * math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + b) / 2**z)))) for b in (0, 1)]
        return [(a, b) for a in lng for b in lat]

    found = set()
    for t in {r[0] for r in rows}:
        name, polygons = next(r[1] for r in rows if r[0] == t), {}
        for _, _, p, h, pts in [r for r in rows if r[0] == t and len(r[4]) >= (10 if r[3] < 0 else 3)]:
            polygons.setdefault(p, ([], []))[h >= 0].append(pts)
        known = {}

        def held(place, rings):
            return any(strictly(r, *place) for r in rings[0]) and not any(strictly(r, *place) for r in rings[1])

        def whole(x, y, z):
            at = corners(x, y, z)
            if any(w < a < e and s < b < n for w, s, e, n in boxes for a, b in at):
                return False
            return any(all(known.setdefault((place, p), held(place, rings)) for place in at) for p, rings in polygons.items())

        level = {(x, y) for x in range(1 << zoom) for y in range(1 << zoom) if whole(x, y, zoom)}
        for _ in range(drop):
            level = {(x, y) for x, y in level if all((x + a, y + b) in level for a in (-1, 0, 1) for b in (-1, 0, 1))}
        for z in range(zoom, least - 1, -1):
            up = {(x // 2, y // 2) for x, y in level if all((x // 2 * 2 + a, y // 2 * 2 + b) in level for a in (0, 1) for b in (0, 1))} if z > least else set()
            found |= {(name, x, y, z) for x, y in level if (x // 2, y // 2) not in up and z <= keep and whole(x, y, z)}
            level = up
    return found


def test_preindex_of_odd_zones_by_brute_force(spark):  # F1
    """Zones of several polygons (apart, side by side, overlapping), with holes, at the world's rim, and around excluded boxes."""
    from meridia.sources import fixtures as X

    def oblong(t, name, p, h, x, y, w, high):
        return (t, name, p, h, [(x + w * a // 16, y + high * b // 16) for a, b in square(0, 0, 0, 16)[4]])

    d = 100_000
    rows = [oblong(0, "apart", 0, -1, -10 * d, -10 * d, 40 * d, 45 * d), oblong(0, "apart", 0, 0, 2 * d, 0, 9 * d, 7 * d), oblong(0, "apart", 1, -1, 40 * d, 0, 30 * d, 30 * d)]
    rows += [oblong(1, "over", 0, -1, -70 * d, 5 * d, 35 * d, 40 * d), oblong(1, "over", 1, -1, -50 * d, 0, 40 * d, 40 * d), oblong(2, "side", 0, -1, 90 * d, -40 * d, 20 * d, 30 * d), oblong(2, "side", 1, -1, 110 * d, -40 * d, 20 * d, 30 * d)]
    rows += [oblong(3, "rim", 0, -1, -180 * d, 40 * d, 60 * d, 50 * d), oblong(4, "south", 0, -1, 130 * d, -90 * d, 50 * d, 60 * d), oblong(5, "small", 0, -1, 80 * d, 50 * d, 200_000, 100_000)]
    rows.append((6, "few", 0, -1, [(-100 * d, -60 * d), (-40 * d, -60 * d), (-40 * d, -20 * d)]))
    boxes = [(0, 20 * d, 4 * d, 26 * d), (52 * d, 8 * d, 75 * d, 24 * d)]
    cut = R.edges(tiles.exclusion_rings(spark, [tuple(v / d for v in b) for b in boxes]))
    for zoom, least, keep, drop in ((6, 2, 5, 1), (6, 3, 6, 0)):
        got = [tuple(r) for r in tiles.preindex(X.rings(spark, rows), zoom, least, keep, drop, cut).select("name", "x", "y", "z").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_preindex(rows, zoom, least, keep, drop, boxes)


def test_every_zone_is_indexed_however_many(spark, tmp_path):  # F1
    """With a thousand zones the zoom of a hundred leaves no tile: the zoom follows the zones."""
    from meridia.plans.queries import Q

    spark.range(1_000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    found = Q["preindex"](spark, str(tmp_path)).select("name").distinct().count()
    assert found == 1_000 + 334
