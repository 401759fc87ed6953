"""Literal cases: codec, GeoJSON, exclusion, point lines, compression, layered versions."""

import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import polyline as P
from meridia.operators import audit, finder, tiles, topology
from meridia.operators import rings as R
from meridia.plans import pipeline
from meridia.sources import fixtures as X
from meridia.sources import geojson as J
from meridia.streaming import lookup


def test_polyline_literal():
    pts = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert P.encode_coords(pts) == b"_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert P.decode_coords(P.encode_coords(pts)) == pts and P.decode_ints(b"") == []
    for bad in (b"_p~iF", b"_p~iF~", b"\x01\x02"):
        with pytest.raises(P.PolylineError):
            P.decode_ints(bad)


def test_geojson_round_trip(spark, tmp_path):
    rings = X.rings(spark, X.nations())
    text = J.feature_collection(rings).first()[0]
    assert len(json.loads(text)["features"]) == 50
    (tmp_path / "z.geojson").write_text(text)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("z.geojson", text)
    wanted = {tuple(r) for r in R.bounds(R.edges(rings), *R.RING).collect()}
    for name in ("z.geojson", "z.zip"):
        back = J.load_zones(spark, str(tmp_path / name))
        assert {tuple(r) for r in R.bounds(R.edges(back), *R.RING).collect()} == wanted
    assert len(json.loads(J.feature_collection(rings, "nation/03").first()[0])["features"]) == 1
    with pytest.raises(Exception, match="no timezone found"):
        J.feature_collection(rings, "nowhere").collect()


def test_excluded_points(spark):
    at = [(40.267, 43.278), (40.342, 43.160), (41.0167, 43.0015), (41.468, 42.712), (40.1, 43.0), (40.08, 43.34), (0.0, 0.0)]
    pts = spark.createDataFrame([(i, round(a * 1e5), round(b * 1e5)) for i, (a, b) in enumerate(at)], "pt_id long, px long, py long")
    got = tiles.exclusion_match(pts, R.edges(tiles.exclusion_rings(spark)))
    assert {r["pt_id"] for r in got.collect()} == set(range(6))


def test_point_lines(spark):
    lines = spark.createDataFrame([("116.6, 40.07",), ("1;2",), (" 3\t4 ",)], "value string")
    assert {(r["lng"], r["lat"]) for r in J.parse_point_lines(lines).collect()} == {(116.6, 40.07), (1.0, 2.0), (3.0, 4.0)}
    with pytest.raises(Exception, match="two numbers"):
        J.parse_point_lines(spark.createDataFrame([("1 2 3",)], "value string")).collect()


def test_compression_and_sharing(spark):
    segments, library = topology.deduplicate(X.rings(spark, X.jagged()))
    s, e = pipeline.decompress_topology(*pipeline.compress_topology(segments, library))
    assert topology.segment_counts(s, e).collect() == topology.segment_counts(segments, library).collect()


def square(x0, y0, x1, y1, dense=1):
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(a[0] + (b[0] - a[0]) * k // dense, a[1] + (b[1] - a[1]) * k // dense) for a, b in zip(corners, corners[1:] + corners[:1]) for k in range(dense)]


@pytest.mark.parametrize(("dense", "size"), [(1, 1 << 28), (200, 1 << 28), (200, 0)])
def test_shared_border(spark, dense, size):
    """Two squares that touch, with few and many vertices, index broadcast or shuffled: strict neither, allow-edge both."""
    rows = [(0, "A", 0, -1, square(0, 0, 1_000_000, 1_000_000, dense)), (1, "B", 0, -1, square(1_000_000, 0, 2_000_000, 1_000_000, dense))]
    found = finder.ZoneFinder.from_rings(X.rings(spark, rows), broadcast_bytes=size)
    at = [(0, 1_000_000, 500_000), (1, 1_000_000, 1_000_000), (2, 1_000_000, 0), (3, 500_000, 500_000), (4, 1_500_000, 500_001), (5, 2_500_000, 5), (3, 500_000, 500_000)]
    pts = spark.createDataFrame(at, "pt_id long, px long, py long")
    both = sorted((r["pt_id"], r["names"]) for r in found.all(pts).collect())
    assert both == [(0, ["A", "B"]), (1, ["A", "B"]), (2, ["A", "B"]), (3, ["A"]), (3, ["A"]), (4, ["B"]), (5, [])]
    assert sorted(r["pt_id"] for r in found.matches(pts).collect()) == [3, 3, 4]
    assert sorted((r["pt_id"], r["name"]) for r in found.first(pts, strict=True).collect())[:3] == [(0, "A"), (1, "A"), (2, "A")]
    plan = found.first(pts)._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in plan) == (size == 0)


def test_lookup_by_brute_force(spark):
    """Stars with holes over many cells, by the even-odd rule over all edges; index broadcast and shuffled agree."""
    rng = random.Random(3)

    def star(cx, cy, r, n):
        return [(int(cx + r * rng.uniform(0.3, 1) * math.cos(6.2832 * k / n)), int(cy + r * rng.uniform(0.3, 1) * math.sin(6.2832 * k / n))) for k in range(n)]

    rows = []
    for t in range(6):
        cx, cy = rng.randrange(-9_000_000, 9_000_000), rng.randrange(-5_000_000, 5_000_000)
        rows += [(t, f"Z{t}", 0, -1, star(cx, cy, 3_000_000, 300)), (t, f"Z{t}", 0, 0, star(cx, cy, 800_000, 40)), (t, f"Z{t}", 1, -1, star(cx + 500_000, cy, 60_000, 9))]
    pts = [(i, rng.randrange(-12_000_000, 12_000_000), rng.randrange(-8_000_000, 8_000_000)) for i in range(1500)] + [(2000 + k, *rng.choice(rng.choice(rows)[4])) for k in range(300)]

    def side(ring, x, y):
        inside = False
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
            if min(xa, xb) <= x <= max(xa, xb) and min(ya, yb) <= y <= max(ya, yb) and (xb - xa) * (y - ya) == (yb - ya) * (x - xa):
                return None
            if (ya > y) != (yb > y) and (x - xa) * abs(yb - ya) < (xb - xa) * (y - ya) * (1 if yb > ya else -1):
                inside = not inside
        return inside

    want = {}
    for i, x, y in pts:
        got = set()
        for t in range(6):
            for poly in (0, 1):
                outer = [side(r[4], x, y) for r in rows if r[0] == t and r[2] == poly and r[3] < 0]
                holes = [side(r[4], x, y) for r in rows if r[0] == t and r[2] == poly and r[3] >= 0]
                if outer[0] is not False and True not in holes:
                    got.add(f"Z{t}")
        want[i] = sorted(got)
    for size in (1 << 28, 0):
        found = finder.ZoneFinder.from_rings(X.rings(spark, rows), broadcast_bytes=size)
        assert {r["pt_id"]: r["names"] for r in found.all(spark.createDataFrame(pts, "pt_id long, px long, py long")).collect()} == want


def test_stream_lookup(spark, tmp_path):
    X.hashed_points(spark.range(500).withColumnRenamed("id", "k"), "k").withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "in"))
    exact = finder.ZoneFinder.from_rings(X.rings(spark, X.nautical()))
    points = spark.readStream.schema("pt_id long, px long, py long, other string").parquet(str(tmp_path / "in"))
    seen = []
    query = lookup.lookup_stream(points, exact, lambda df, epoch: seen.extend(df.collect()), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    batch = {r["pt_id"]: r["name"] for r in exact.first(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert {r["pt_id"]: r["name"] for r in seen} == batch and len(seen) == 500 and {r["other"] for r in seen} == {"x"}


def test_zone_pipeline(spark, tmp_path):
    """GeoJSON in, every table of the offline build out, and all finders agree on it."""
    (tmp_path / "z.geojson").write_text(J.feature_collection(X.rings(spark, X.jagged())).first()[0])
    build = pipeline.ZonePipeline(spark, str(tmp_path / "store"), "v1")
    build.ingest(str(tmp_path / "z.geojson"))
    build.reduce(0.15)
    build.deduplicate()
    build.compress_topology()
    build.compress()
    build.grid()
    build.preindex(idx_zoom=6, agg_zoom=3, max_keep=6, drop=1)
    pts = X.hashed_points(spark.range(1000).withColumnRenamed("id", "k"), "k")
    wanted = {r["pt_id"]: r["name"] for r in build.finder().first(pts).collect()}
    assert {r["pt_id"]: r["name"] for r in build.topology_finder().first(pts).collect()} == wanted
    layered = build.default_finder(3, 6)
    assert {r["pt_id"]: r["name"] for r in layered.first(pts).collect()} == wanted and layered.data_version() == "v1"
    assert len(json.loads(layered.geojson(build.read("reduced"), "Jag/03").first()[0])["features"]) == 1
    with pytest.raises(Exception, match="no timezone found"):
        layered.geojson(build.read("reduced"), "nowhere").collect()
    with pytest.raises(ValueError, match="no timezone found"):
        layered.fuzzy.geojson("nowhere")


def test_simplify_falls_back(spark):
    """A tiny polygon under a great epsilon, and one that simplification would make cross itself, keep their points."""
    tiny = square(-900_000, 0, -899_990, 10, 30)
    bay = [(0, 0), (50_000, -900), (100_000, 0), (100_000, 50_000), (51_000, 50_000), (50_000, -300), (49_000, 50_000), (0, 50_000)]
    plain = [(500_000, 0), (550_000, -900), (600_000, 0), (600_000, 50_000), (500_000, 50_000)]
    rows = [(0, "tiny", 0, -1, [p for k, p in enumerate(tiny) if p not in tiny[:k]]), (1, "bay", 0, -1, bay), (2, "plain", 0, -1, plain)]
    out = topology.simplify(X.rings(spark, rows), 0.01)
    assert {r["tz_idx"]: r["n"] for r in out.selectExpr("tz_idx", "size(pts) as n").collect()} == {0: 40, 1: 8, 2: 4}
    assert topology.violations(out.withColumn("pts", G.close_ring(F.col("pts")))).count() == 0
    doubled = X.rings(spark, [(0, "d", 0, -1, [(0, 0), (0, 0), (9, 0), (9, 9), (0, 0), (0, 0)])])
    assert [(p["x"], p["y"]) for p in topology.clean_rings(doubled).first()["pts"]] == [(0, 0), (9, 0), (9, 9)]


def test_self_intersections_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(t, "z", 0, -1, [(rng.randrange(400), rng.randrange(400)) for _ in range(25)] + [(50_000 * (t % 2), 30)]) for t in range(8)]

    def turn(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)

    def meet(a, b, c, d):
        if not all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1)):
            return False
        o = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        return o[0] != o[1] and o[2] != o[3] or o[0] == o[1] == 0

    want = {(t, i, j) for t, _, _, _, p in rows for i in range(len(p)) for j in range(i + 2, len(p)) if (i, j) != (0, len(p) - 1) and meet(p[i], p[i + 1], p[j], p[(j + 1) % len(p)])}
    assert {(r["tz_idx"], r["i"], r["j"]) for r in R.self_intersections(R.edges(X.rings(spark, rows))).collect()} == want and want


def test_farthest_is_certified():
    """Against 500 places a part: between coarse points the greatest distance lies where two segments are equally near."""
    rng = np.random.default_rng(5)
    for trial in range(20):
        x = np.stack([np.linspace(0, 40_000, 9), rng.integers(-3_000, 3_000, 9)], axis=1).astype(float)
        y = np.stack([np.linspace(0, 40_000, 3 + trial), rng.integers(-3_000, 3_000, 3 + trial)], axis=1).astype(float)
        a, b = audit._vectors(x), audit._vectors(y)
        t = np.linspace(0, 1, 501)[:, None]
        dense = np.concatenate([(1 - t) * p + t * q for p, q in zip(a, a[1:], strict=False)])
        dense /= np.linalg.norm(dense, axis=1)[:, None]
        brute = audit.distances(dense, b)
        got, place = audit.farthest(a, b)
        assert brute.max() - 2 * audit.TOLERANCE_M <= got <= brute.max() + 15  # places of the brute force are up to 30 m apart
        assert abs(audit.distances(place[None], b)[0] - got) < 1e-6
        assert got >= audit.distances(a, b).max()
    flat = audit._vectors(np.stack([np.arange(0, 50_000, 500.0), np.full(100, 100.0)], axis=1))
    base = audit._vectors(np.stack([np.arange(0, 50_000, 130.0), np.zeros(385)], axis=1))
    assert abs(audit.farthest(flat, base)[0] - audit.distances(flat, base).max()) < 0.1


def test_versions_must_agree(spark):
    exact = finder.ZoneFinder.from_rings(X.rings(spark, X.nautical()), "a")
    with pytest.raises(ValueError, match="versions"):
        finder.DefaultFinder(finder.FuzzyFinder(spark.createDataFrame([], "name string, packed long, key_ord long"), 3, 5, "b"), exact)


def test_numbered(spark):
    from pyspark.sql import functions as F

    from meridia.operators.numbering import numbered

    rows = spark.range(5000).selectExpr("cast(hash(id) % 900 as string) as k", "id").repartition(7)
    got = numbered(rows, [F.col("k").asc_nulls_last(), F.col("id")], "n", 11).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (r["k"], r["id"]))] == list(range(5000))
    assert numbered(rows.where("false"), [F.col("k")], "n").count() == 0


def test_columnar_codec(spark):
    """Whole columns against the scalar codec: empty and null rows, large differences, ten million points, named errors."""
    import time

    rng = random.Random(3)
    rows = [None, []] + [[(rng.randrange(-(1 << 31), 1 << 31), rng.choice([0, -1, 31, 32, -18_000_000, (1 << 31) - 1])) for _ in range(rng.randrange(0, 9))] for _ in range(300)]
    df = spark.createDataFrame([(i, None if r is None else [(a, b) for a, b in r]) for i, r in enumerate(rows)], "i int, pts array<struct<x:bigint,y:bigint>>").repartition(3)
    packed = df.select("i", "pts", P.encode_points("pts").alias("b"))
    for r in packed.select("i", "b", P.decode_points("b").alias("back"), P.points_box("b").alias("box")).collect():
        want = rows[r["i"]]
        assert (r["b"] is None) if want is None else bytes(r["b"]) == P.encode_ints(want)
        assert (r["back"] is None) if want is None else [tuple(p) for p in r["back"]] == want
        assert tuple(r["box"]) == (*map(min, zip(*want)), *map(max, zip(*want))) if want else r["box"] is None
    n = 10_000_000
    x, y = np.arange(n) % 36_000_000 - 18_000_000, (np.arange(n) * 7919) % 18_000_000 - 9_000_000
    ends = np.arange(0, n + 1, 1000)
    began = time.time()
    data, at = P.encode_column(x, y, ends)
    a, b, points = P.decode_column(data, at)
    assert time.time() - began < 30 and (a == x).all() and (b == y).all() and (points == ends).all()
    for bad, name in ((b"_p~iF", "empty"), (b"_p~iF~", "unterminated"), (b"\x01\x02", "invalid byte"), (b"~" * 14 + b"??", "overflow"), (P.encode_ints([(1 << 30, 0), (1 << 32, 0)]), "overflow")):
        with pytest.raises(P.PolylineError, match=name):
            P.decode_column(np.frombuffer(b"??" + bad, np.uint8), np.array([0, 2, 2 + len(bad)]))


def test_tile_cover_of_long_edges(spark):
    """A thin slanted zone across the map: the border's tiles, not those of its box."""
    rings = spark.createDataFrame([(0, "slant", 0, -1, [(-17_000_000, -7_000_000), (17_000_000, 6_900_000), (17_000_000, 7_000_000)])], "tz_idx int, name string, poly_idx int, hole_idx int, pts array<struct<x:bigint,y:bigint>>")
    crossed = tiles.crossing_tiles(R.edges(rings), 10).count()
    assert 1000 < crossed < 8000  # the box holds over 700,000


def test_alignment():
    ring = [(0, 0), (1, 0), (2, 0), (1, 1), (1, 0), (0, 1)]
    assert audit.aligned(ring, [(1, 1), (0, 1), (0, 0)]) == [3, 5, 6]
    assert audit.aligned(ring, [(1, 0), (0, 1), (0, 0)]) == [1, 5, 6]
    assert audit.aligned(ring, [(1, 0), (0, 0), (2, 0)]) == [4, 6, 8]
    assert audit.aligned(ring, ring) == list(range(6)) and audit.aligned(ring, ring[4:] + ring[:4]) == list(range(4, 10))
    with pytest.raises(ValueError, match="order"):
        audit.aligned(ring, [(2, 0), (0, 0), (0, 1)])
    with pytest.raises(ValueError, match="not in the original"):
        audit.aligned(ring, [(9, 9)])


def test_sagitta_bound():
    """Places of the map's straight lines against the great circles of the densified ones."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.uniform(-18e6, 18e6, 2), rng.uniform(-8.9e6, 8.9e6, 2)
        line = np.array([[a[0], b[0]], [a[1], b[1]]])
        dense = audit.densify(line)
        start, end = audit.unwrapped(line)
        places = start + (end - start) * np.linspace(0, 1, 4001)[:, None]
        assert audit.distances(audit._vectors(places), audit._vectors(dense)).max() <= audit.SAGITTA_M


def test_baseline_update(spark):
    """A changed zone: only rings near it are snapped again, and the result is that of a fresh baseline."""
    rows = X.nations()
    rings = X.rings(spark, rows)
    base = topology.prepare_baseline(rings)
    changed = [(t, n, p, h, [*pts[:1], (pts[0][0] + 700_000, pts[0][1]), *pts[1:]] if t == 48 and h < 0 else pts) for t, n, p, h, pts in rows if t != 47]
    updated, again = topology.update_baseline(base, X.rings(spark, changed))
    fresh = topology.prepare_baseline(X.rings(spark, changed))
    key = lambda df: sorted((r["tz_idx"], r["hole_idx"], sorted(map(tuple, r["pts"]))) for r in df.collect())
    assert key(updated.ready) == key(fresh.ready) and 0 < again.count() < rings.count() / 2
    assert key(topology.simplify_baseline(updated, 0.01).rings) == key(topology.simplify_baseline(fresh, 0.01).rings)
    same, none = topology.update_baseline(base, rings)
    assert none.count() == 0 and key(same.ready) == key(base.ready)
