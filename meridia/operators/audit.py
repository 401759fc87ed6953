"""Accuracy audit of simplified borders: spherical lengths, areas, displacement, weighted quantiles."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..stages import settled, spread
from . import rings as R

RADIUS_M = 6_371_007.180918475  # authalic
BIN_M = 0.1
TOLERANCE_M = 0.01  # of the certified greatest displacement between the densified lines
SMALL_PAIRS = 16_384  # of points and segments
MAX_CHORD_M, SAGITTA_M, MAX_HALVINGS = 5_000.0, 0.4, 40
OUTSIDE = "outside-dataset"


def _rad(c: str) -> Column:
    return F.radians(F.col(c) / 100_000.0)


def edge_length() -> Column:
    """Great-circle length in metres of the edge xa, ya, xb, yb."""
    la, lb, ya, yb = _rad("xa"), _rad("xb"), _rad("ya"), _rad("yb")
    h = F.pow(F.sin((yb - ya) / 2), 2) + F.cos(ya) * F.cos(yb) * F.pow(F.sin((lb - la) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def spherical_area(edge_table: DataFrame, *by: str) -> DataFrame:
    """Signed area in square metres by ring (or by), counter-clockwise positive."""
    d = _rad("xb") - _rad("xa")
    turn = 2 * np.pi
    d = F.when(d > np.pi, d - turn).when(d < -np.pi, d + turn).otherwise(d)
    return edge_table.groupBy(*(by or R.RING)).agg((-F.sum(d * (2 + F.sin(_rad("ya")) + F.sin(_rad("yb")))) * (RADIUS_M * RADIUS_M / 2)).alias("area_m2"))


def polyline_length(edge_table: DataFrame, *by: str) -> DataFrame:
    return edge_table.groupBy(*(by or R.RING)).agg(F.sum(edge_length()).alias("length_m"))


def weighted_bins(values: DataFrame, *by: str, bin_width: float = BIN_M) -> DataFrame:
    """Histogram (bin, weight) of value, weight rows; weights over zero and finite values only."""
    ok = values.where((F.col("weight") > 0) & ~F.isnan("value") & F.col("value").between(-1e300, 1e300))
    return ok.groupBy(*by, F.round(F.col("value") / bin_width).cast("long").alias("bin")).agg(F.sum("weight").alias("weight"))


def weighted_quantile(bins: DataFrame, q: float, *by: str, bin_width: float = BIN_M) -> DataFrame:
    """The least bin whose running weight reaches q of the total.  Bins are few: one row for each 0.1 m."""
    w = Window.partitionBy(*by).orderBy("bin") if by else Window.partitionBy(F.lit(0)).orderBy("bin")
    run = bins.withColumn("run", F.sum("weight").over(w)).withColumn("total", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    reached = run.where(F.col("run") >= q * F.col("total"))
    return reached.groupBy(*by).agg((F.min("bin") * bin_width).alias("quantile"))


def proportion_above(bins: DataFrame, threshold: float, *by: str, bin_width: float = BIN_M) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.when(F.col("bin") * bin_width > threshold, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("proportion"))


def top_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    """pair, area: the greatest, then by name."""
    return pairs.orderBy(F.desc("area"), "pair").limit(n)


def zone_pair(names: Column) -> Column:
    """The sorted names of a border's zones, joined; the outside where there is one only."""
    s = F.array_sort(F.array_distinct(names))
    return F.array_join(F.when(F.size(s) == 1, F.concat(s, F.array(F.lit(OUTSIDE)))).otherwise(s), "+")


def _vectors(pts: np.ndarray) -> np.ndarray:
    lng, lat = np.radians(pts[:, 0] / 1e5), np.radians(pts[:, 1] / 1e5)
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)


def unwrapped(pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a polyline's edges, the ends moved by a turn where that is the shorter way over the antimeridian."""
    a, b = pts[:-1].astype(float), pts[1:].astype(float)
    b[:, 0] -= 36_000_000 * np.sign(b[:, 0] - a[:, 0]) * (np.abs(b[:, 0] - a[:, 0]) > 18_000_000)
    return a, b


def densify(pts: np.ndarray, max_chord_m: float = MAX_CHORD_M, sagitta_m: float = SAGITTA_M) -> np.ndarray:
    """Points along the straight lines of the map, so dense that the great circles between them stay near those lines.

    An edge is halved until its chord is at most max_chord_m and its middle at most half of sagitta_m off the chord; the other half
    is for places beside the middle.  Meridians are great circles and stay coarse; what runs east to west near a pole is cut finely."""
    if len(pts) < 2:
        return pts.astype(float)
    a, b = unwrapped(pts)
    for _ in range(MAX_HALVINGS):
        m = (a + b) / 2
        va, vb = _vectors(a), _vectors(b)
        wide = (_metres(np.linalg.norm(vb - va, axis=1)) > max_chord_m) | (_metres(_to_segments(_vectors(m), va, vb)) > sagitta_m / 2)
        if not wide.any():
            break
        at = np.repeat(np.arange(len(a)), 1 + wide)
        second = np.r_[False, at[1:] == at[:-1]]
        first = np.r_[second[1:], False]
        a, b = np.where(second[:, None], m[at], a[at]), np.where(first[:, None], m[at], b[at])
    return np.concatenate([a, b[-1:]])


def _caps(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and chord radii of caps around runs of points; a cap holds the arcs between its points."""
    centres = np.array([points[s:e].mean(axis=0) for s, e in zip(starts, ends, strict=True)])
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    radii = np.array([np.linalg.norm(points[s:e] - c, axis=1).max() for s, e, c in zip(starts, ends, centres, strict=True)])
    return centres, radii


def _to_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chord lengths on the unit sphere from points to the nearest place of segments (arrays that broadcast)."""
    d = b - a
    n = (d * d).sum(axis=-1)
    t = np.clip(((p - a) * d).sum(axis=-1) / np.where(n > 0, n, 1), 0, 1)
    near = a + t[..., None] * d
    near /= np.linalg.norm(near, axis=-1)[..., None]
    return np.linalg.norm(p - near, axis=-1)


def _metres(chord: np.ndarray) -> np.ndarray:
    return 2 * np.arcsin(np.minimum(1, chord / 2)) * RADIUS_M


def nearest(points: np.ndarray, line: np.ndarray, run: int = 32, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Great-circle distance in metres of unit vectors to a polyline of unit vectors, and the nearest segment's index.

    Up to SMALL_PAIRS, all points meet all segments at once; beyond, neighbouring points meet only those runs of segments whose
    cap may hold the nearest one."""
    if len(points) * (len(line) - 1) <= SMALL_PAIRS:
        away = _to_segments(points[:, None], line[:-1], line[1:])
        at = away.argmin(axis=1)
        return _metres(away[np.arange(len(points)), at]), at
    first = np.arange(0, len(line) - 1, run)
    last = np.minimum(first + run, len(line) - 1)
    line_at, line_r = _caps(line, first, last + 1)
    begins = np.arange(0, len(points), few)
    point_at, point_r = _caps(points, begins, np.minimum(begins + few, len(points)))
    best, segment = np.empty(len(points)), np.empty(len(points), np.int64)
    for s, c, r in zip(begins, point_at, point_r, strict=True):
        p, apart = points[s : s + few], np.linalg.norm(line_at - c, axis=1)
        near_runs = np.flatnonzero(apart - line_r <= (apart + line_r).min() + 2 * r + 1e-12)
        own = np.concatenate([np.arange(first[k], last[k]) for k in near_runs])
        away = _to_segments(p[:, None], line[own], line[own + 1])
        at = away.argmin(axis=1)
        best[s : s + few], segment[s : s + few] = away[np.arange(len(p)), at], own[at]
    return _metres(best), segment


def distances(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    return nearest(points, line)[0]


def farthest(points: np.ndarray, line: np.ndarray, tolerance_m: float = TOLERANCE_M) -> tuple[float, np.ndarray]:
    """The greatest distance in metres of the polyline through points from line, certified to tolerance_m, and its place.

    The distance to one segment is convex along a part, so it is greatest at an end; the distance to the line is at most
    that to any of its segments.  A part whose bound, by the segments nearest to its two ends, exceeds the greatest
    distance met so far by more than the tolerance is halved."""
    away, near = nearest(points, line)
    k = int(away.argmax())
    best, place = float(away[k]), points[k]
    u, v, du, dv, nu, nv = points[:-1], points[1:], away[:-1], away[1:], near[:-1], near[1:]
    while len(u):
        by_u = np.maximum(du, _metres(_to_segments(v, line[nu], line[nu + 1])))
        by_v = np.maximum(dv, _metres(_to_segments(u, line[nv], line[nv + 1])))
        open_ = np.minimum(by_u, by_v) > best + tolerance_m
        u, v, du, dv, nu, nv = (c[open_] for c in (u, v, du, dv, nu, nv))
        if not len(u):
            break
        m = u + v
        m /= np.linalg.norm(m, axis=1)[:, None]
        dm, nm = nearest(m, line)
        k = int(dm.argmax())
        if dm[k] > best:
            best, place = float(dm[k]), m[k]
        u, v = (np.stack(c, axis=1).reshape(-1, 3) for c in ((u, m), (m, v)))
        du, dv, nu, nv = (np.stack(c, axis=1).ravel() for c in ((du, dm), (dm, dv), (nu, nm), (nm, nv)))
    return best, place


def aligned(original: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[int]:
    """Where a simplified ring's vertices stand in its original: places that go forward, once round at most, from any start.

    Each vertex is met at its next occurrence.  Where the first one occurs more than once, the first occurrence that lets all
    others follow is taken.  A vertex that the original lacks, and another order, raise."""
    places: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(original):
        places.setdefault(p, []).append(i)
    for p in kept:
        if p not in places:
            raise ValueError(f"vertex {p[0] / 1e5:.5f},{p[1] / 1e5:.5f} is not in the original ring")
    n = len(original)
    for start in places[kept[0]]:
        out = [start]
        for p in kept[1:]:
            own, turn = places[p], out[-1] // n * n
            k = bisect_right(own, out[-1] - turn)
            out.append(turn + own[k] if k < len(own) else turn + n + own[0])
        if out[-1] < start + n:
            return out
    raise ValueError("the simplified vertices do not follow the order of the original ring")


def _arcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut original rings at the vertices that their simplified rings keep; both in the same direction, from any start."""
    for rows in batches:
        yield _arcs_of(rows)


def _arcs_of(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.to_dict("records"):
        key = tuple(r[c] for c in R.RING)
        a, b = [(int(p["x"]), int(p["y"])) for p in r["original"]], [(int(p["x"]), int(p["y"])) for p in r["candidate"]]
        if len(set(a)) < 3 or len(set(b)) < 3:
            raise ValueError(f"ring {key} has fewer than three different points")
        at = aligned(a, b)
        for m, s in enumerate(at):
            e = at[m + 1] if m + 1 < len(at) else at[0] + len(a)
            chain, chord = [a[i % len(a)] for i in range(s, e + 1)], [b[m], b[(m + 1) % len(b)]]
            if chain[::-1] < chain:
                chain, chord = chain[::-1], chord[::-1]
            out.append((r["name"], str(chain), [{"x": x, "y": y} for x, y in chain], [{"x": x, "y": y} for x, y in chord]))
    return pd.DataFrame(out, columns=["name", "arc", "chain", "chord"])


def _areas(lng_lat: np.ndarray) -> np.ndarray:
    """Areas in square metres of closed polygons (polygon, corner, lng and lat in radians; the first corner repeated)."""
    d = (np.diff(lng_lat[..., 0], axis=-1) + np.pi) % (2 * np.pi) - np.pi
    lat = np.sin(lng_lat[..., 1])
    return np.abs((d * (2 + lat[..., :-1] + lat[..., 1:])).sum(axis=-1)) * RADIUS_M**2 / 2


def strip_widths(dense: np.ndarray, area_m2: float) -> list[tuple[float, float]]:
    """(width in metres, square metres) samples of the strip between a densified arc and its chord, which weigh the whole area.

    The arc is fanned into triangles from its first point; a triangle's width is the distance of its middle from the arc."""
    if len(dense) < 3 or not area_m2:
        return []
    v, flat = _vectors(dense), np.radians(dense / 1e5)
    corners = np.stack([np.broadcast_to(flat[0], flat[1:-1].shape), flat[1:-1], flat[2:], np.broadcast_to(flat[0], flat[1:-1].shape)], axis=1)
    areas = _areas(corners)
    middle = v[0] + v[1:-1] + v[2:]
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    live = areas > 0
    if not live.any():
        return []
    widths = distances(middle[live], v)
    return list(zip(widths.tolist(), (areas[live] * (area_m2 / areas.sum())).tolist(), strict=True))


#: What analyse() measures beside lengths and areas, each dear on its own.
FIGURES = ("max", "samples", "widths")


def analyse(original: DataFrame, candidate: DataFrame, figures: tuple[str, ...] = FIGURES) -> DataFrame:
    """One row for each different arc: pair, length_m, max_m and its place max_at (lng, lat), area_m2, samples of displacement by
    length (value, weight) and widths of the strip by area (value, weight).

    figures: which of max_m with its place, samples and widths are wanted; the others are null.
    max_m is certified to TOLERANCE_M for the densified lines, which are at most SAGITTA_M off the map's own."""
    both = original.select(*R.RING, "name", F.col("pts").alias("original")).join(spread(candidate.select(*R.RING, F.col("pts").alias("candidate"))), R.RING, "full")
    checked = both.withColumn("name", F.when(F.col("original").isNull() | F.col("candidate").isNull(), F.raise_error(F.lit("the datasets' rings differ")).cast("string")).otherwise(F.col("name")))
    kind = "array<struct<x:bigint,y:bigint>>"
    arcs = checked.mapInPandas(_arcs, f"name string, arc string, chain {kind}, chord {kind}")
    unique = arcs.groupBy("arc").agg(F.collect_set("name").alias("names"), F.first("chain").alias("chain"), F.first("chord").alias("chord"))

    sample = "array<struct<value:double,weight:double>>"

    @F.pandas_udf(f"length_m double, max_m double, max_at struct<lng:double,lat:double>, area_m2 double, samples {sample}, widths {sample}")
    def measure(chain: pd.Series, chord: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(chain, chord, strict=True):
            p, q = (np.array([(s["x"], s["y"]) for s in c], float) for c in (a, b))
            flat_p, flat_q = densify(p), densify(q)
            dp, dq = _vectors(flat_p), _vectors(flat_q)
            length = float(_metres(np.linalg.norm(np.diff(dp, axis=0), axis=1)).sum())
            far, place, samples, widths, area = 0.0, dp[0], [(0.0, 2 * length)], [], 0.0
            if len(p) > 2:
                samples = []
                for x, y in ((dp, dq), (dq, dp)):
                    if "max" in figures:
                        most, at = farthest(x, y)
                        if most > far:
                            far, place = most, at
                    if "samples" not in figures:
                        continue
                    mid = x[:-1] + x[1:]
                    mid /= np.linalg.norm(mid, axis=1)[:, None]
                    samples += zip(distances(mid, y).tolist(), _metres(np.linalg.norm(np.diff(x, axis=0), axis=1)).tolist(), strict=True)
                area = float(_areas(np.radians(np.concatenate([p, q[::-1], p[:1]]) / 1e5)))
                widths = strip_widths(flat_p, area) if area > 1e-6 and "widths" in figures else []
            at = {"lng": float(np.degrees(np.arctan2(place[1], place[0]))), "lat": float(np.degrees(np.arcsin(np.clip(place[2], -1, 1))))}
            rows = ([{"value": v, "weight": w} for v, w in own] if name in figures else None for name, own in (("samples", samples), ("widths", widths)))
            out.append((length, far if "max" in figures else None, at if "max" in figures else None, area, *rows))
        return pd.DataFrame(out, columns=["length_m", "max_m", "max_at", "area_m2", "samples", "widths"])

    parts = int(original.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unique = unique.repartition(parts, "arc")  # arcs are small and dear: not to be gathered into few tasks
    return unique.select("arc", zone_pair(F.col("names")).alias("pair"), measure("chain", "chord").alias("m")).select("arc", "pair", "m.*")


def report(arcs: DataFrame) -> DataFrame:
    """One row of totals."""
    changed = F.col("area_m2") > 1e-6
    return arcs.agg(F.count(F.lit(1)).alias("unique_arcs"), F.count_if(changed).alias("changed_arcs"), (F.sum("length_m") / 1000).alias("length_km"), (F.sum(F.when(changed, F.col("length_m")).otherwise(0.0)) / 1000).alias("changed_length_km"), (F.sum("area_m2") / 1e6).alias("area_km2"), F.max("max_m").alias("max_m"), F.max_by("pair", "max_m").alias("max_pair"), F.max_by("max_at", "max_m").alias("max_at"))


def pair_areas(arcs: DataFrame) -> DataFrame:
    return arcs.where("area_m2 > 1e-6").groupBy("pair").agg((F.sum("area_m2") / 1e6).alias("area"))


def displacement_bins(arcs: DataFrame) -> DataFrame:
    """Histogram of the displacement by length."""
    return weighted_bins(arcs.select(F.explode("samples").alias("s")).select("s.value", "s.weight"))


def width_bins(arcs: DataFrame) -> DataFrame:
    """Histogram of the strips' widths by area."""
    return weighted_bins(arcs.select(F.explode("widths").alias("s")).select("s.value", "s.weight"))


def markdown(arcs: DataFrame, top: int = 20) -> str:
    """The audit's report; what is collected is one row, four quantiles and the top pairs."""
    arcs = settled(arcs)  # each figure below is a query of its own
    r = report(arcs).first().asDict()
    bins = displacement_bins(arcs)
    lines = ["# Border change", "", "| figure | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in r.items())]
    lines += [f"| displacement p{100 * q:g} | {weighted_quantile(bins, q).first()[0]:.1f} m |" for q in (0.5, 0.95, 0.99, 0.999)]
    lines += [f"| above {t} m | {100 * proportion_above(bins, t).first()[0]:.4f}% |" for t in (10, 50, 100, 500)]
    widths = settled(width_bins(arcs))
    if widths.count():
        lines += [f"| width p{100 * q:g} | {weighted_quantile(widths, q).first()[0]:.1f} m |" for q in (0.5, 0.95, 0.99, 0.999)]
        lines += [f"| area wider than {t} m | {100 * proportion_above(widths, t).first()[0]:.4f}% |" for t in (10, 50, 100, 500)]
    lines += ["", "| pair | km2 |", "|---|---|", *(f"| {p['pair']} | {p['area']:.6f} |" for p in top_pairs(pair_areas(arcs), top).collect())]
    return "\n".join(lines) + "\n"
