"""Shared borders: marking, topology-aware simplification, deduplication, validation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..stages import settled, spread
from . import near
from . import rings as R
from .numbering import numbered

EPSILON = 0.001
CHECKED_POINTS = 100
SHORT_PATH = 4
SHORT_RING = 100


def key_x(x: Column) -> Column:
    """The antimeridian's two sides are one key."""
    return F.when(x == -18_000_000, F.lit(18_000_000)).otherwise(x)


def keyed(edge_table: DataFrame) -> DataFrame:
    a, b = F.struct(key_x(F.col("xa")).alias("x"), F.col("ya").alias("y")), F.struct(key_x(F.col("xb")).alias("x"), F.col("yb").alias("y"))
    return edge_table.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b), "forward": a <= b})


def shared_edges(edge_table: DataFrame) -> DataFrame:
    """lo, hi: undirected edges used exactly twice, by different rings, in opposite directions."""
    uses = keyed(edge_table).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(*R.RING)).alias("rings"), F.sum(F.col("forward").cast("int")).alias("f"))
    return uses.where("n = 2 and rings = 2 and f = 1").select("lo", "hi")


def fixed_vertices(edge_table: DataFrame) -> DataFrame:
    """x, y of vertices in more than two rings."""
    at = edge_table.select(key_x(F.col("xa")).alias("x"), F.col("ya").alias("y"), *R.RING).distinct()
    return at.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("x", "y")


def edge_partners(edge_table: DataFrame) -> DataFrame:
    """Edges with shared (boolean) and partner (the other ring, or null)."""
    k = keyed(edge_table)
    ring = F.struct(*R.RING)
    pairs = k.groupBy("lo", "hi").agg(F.collect_set(ring).alias("rs"), F.count(F.lit(1)).alias("n"), F.sum(F.col("forward").cast("int")).alias("f")).where("n = 2 and f = 1 and size(rs) = 2").select("lo", "hi", "rs")
    joined = k.join(spread(pairs), ["lo", "hi"], "left")
    other = F.get(F.filter("rs", lambda r: r != ring), F.lit(0))
    return joined.select(*edge_table.columns, F.col("rs").isNotNull().alias("shared"), other.alias("partner"))


def fixed_for_dedup(edge_table: DataFrame) -> DataFrame:
    """x, y of vertices where sharing begins or ends, the partner changes, or more than two rings meet."""
    p = edge_partners(edge_table)
    n = Window.partitionBy(*R.RING).orderBy("edge_idx")
    whole = n.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(F.struct("shared", "partner")).over(n), F.last(F.struct("shared", "partner")).over(whole))
    changed = p.withColumn("b", before).where(~(F.col("b.shared").eqNullSafe(F.col("shared"))) | ~(F.col("b.partner").eqNullSafe(F.col("partner"))))
    return changed.select(key_x(F.col("xa")).alias("x"), F.col("ya").alias("y")).unionByName(fixed_vertices(edge_table)).distinct()


def clean_rings(rings: DataFrame) -> DataFrame:
    """Open rings without repeated neighbours, the last and the first among them; longitudes in [-180, 180]."""
    p = G.open_ring(F.col("pts"))
    wrapped = F.transform(p, lambda q: F.struct(F.when(q["x"] > 18_000_000, q["x"] - 36_000_000).when(q["x"] < -18_000_000, q["x"] + 36_000_000).otherwise(q["x"]).alias("x"), q["y"].alias("y")))
    return rings.withColumn("pts", G.open_ring(G.bound(wrapped, lambda r: F.filter(r, lambda q, i: (i == 0) | (q != F.get(r, i - 1))))))


def snap_vertices(rings: DataFrame, cell: int = 100_000) -> DataFrame:
    """Insert other rings' vertices that lie on an edge (within 1e-6 degree), in order along it.

    Edges are cut into the cells that their boxes reach, of their own size (cell at most); vertices meet them by an equi-join on the cell."""
    e = R.edges(rings)
    cells = near.placed(e, F.least("xa", "xb"), F.least("ya", "yb"), F.greatest("xa", "xb"), F.greatest("ya", "yb"), cell)
    v = R.vertices(rings).select("x", "y").distinct()
    on = F.expr("(cast(xb - xa as double) * (y - ya) - cast(yb - ya as double) * (x - xa)) = 0 and x between least(xa, xb) and greatest(xa, xb) and y between least(ya, yb) and greatest(ya, yb) and not (x = xa and y = ya) and not (x = xb and y = yb)")
    found = near.meeting(v, F.col("x"), F.col("y"), cells).where(on).select(*R.RING, "edge_idx", F.expr("abs(x - xa) + abs(y - ya)").alias("t"), "x", "y").distinct()
    own = R.vertices(rings).select(*R.RING, F.col("pt_idx").alias("edge_idx"), F.lit(0).cast("long").alias("t"), "x", "y")
    merged = own.unionByName(found).groupBy(*R.RING).agg(F.array_sort(F.collect_list(F.struct("edge_idx", "t", "x", "y"))).alias("p"))
    pts = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return rings.drop("pts").join(spread(merged.select(*R.RING, pts.alias("pts"))), R.RING).select(rings.columns)


def kept_places(p: np.ndarray, epsilon: float) -> np.ndarray:
    """Which points (n x 2) stay: the ends, and what is farther than epsilon (scaled units) from its chord, measured to the segment."""
    keep, work = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while work:
        i, j = work.pop()
        if j - i < 2:
            continue
        away, chord = p[i + 1 : j] - p[i], p[j] - p[i]
        length = chord @ chord
        t = np.clip(away @ chord / length, 0, 1) if length else np.zeros(len(away))
        far = np.hypot(*(away - t[:, None] * chord).T)
        at = int(far.argmax())
        if far[at] > epsilon:
            keep[i + 1 + at] = True
            work += [(i, i + 1 + at), (i + 1 + at, j)]
    return keep


def douglas_peucker(points: list[tuple[int, int]], epsilon: float) -> list[tuple[int, int]]:
    """Keep what is farther than epsilon (scaled units) from the chord, measured to the segment."""
    return [points[k] for k in np.flatnonzero(kept_places(np.array(points, np.float64).reshape(-1, 2), epsilon))]


def chains(rings: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rings cut at fixed vertices: seg_idx, pts (both ends included), canonical, forward.

    A ring without fixed vertices starts where least_rotation() says; equal chains have one canonical form."""
    v = R.vertices(rings).withColumn("kx", key_x(F.col("x")))
    marked = v.join(spread(fixed.select(F.col("x").alias("kx"), "y", F.lit(1).alias("is_fixed"))), ["kx", "y"], "left")
    grouped = marked.groupBy(*R.RING).agg(F.array_sort(F.collect_list(F.struct("pt_idx", "x", "y", F.coalesce("is_fixed", F.lit(0)).alias("f")))).alias("p"))
    return grouped.mapInPandas(_cut, "tz_idx int, poly_idx int, hole_idx int, seg_idx int, pts array<struct<x:bigint,y:bigint>>, canonical string, forward boolean")


def least_rotation(pts: list[tuple[int, int]]) -> int:
    """Where the least of all ways round the ring, in both directions, starts.

    It belongs to the ring's set of edges, not to one ring: a hole and the exterior that fills it start alike, even where
    they come to their least vertex more than once."""
    least, n = min(pts), len(pts)
    ways = []
    for i in (i for i, p in enumerate(pts) if p == least):
        ahead = pts[i:] + pts[:i]
        ways += [(ahead, i), ([ahead[0], *ahead[:0:-1]], i)]
    return min(ways)[1] % n


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a ring; what a ring gives is handed on before the next batch is read."""
    for rows in batches:
        yield _cut_rows(rows)


def _cut_rows(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for *key, p in rows[[*R.RING, "p"]].itertuples(index=False):
        pts, flags = [(int(q["x"]), int(q["y"])) for q in p], [q["f"] for q in p]
        marks = [i for i, f in enumerate(flags) if f]
        start = marks[0] if marks else least_rotation(pts)
        pts, flags = pts[start:] + pts[:start], flags[start:] + flags[:start]
        cuts = [i for i, f in enumerate(flags) if f] or [0]
        for k, i in enumerate(cuts):
            j = cuts[k + 1] if k + 1 < len(cuts) else len(pts)
            chain = pts[i:j] + [pts[j % len(pts)]]
            back = chain[::-1]
            out.append((*key, k, [{"x": x, "y": y} for x, y in chain], str(min(chain, back)), chain <= back))
    return pd.DataFrame(out, columns=["tz_idx", "poly_idx", "hole_idx", "seg_idx", "pts", "canonical", "forward"])


def _simplify_chain(pts: list[tuple[int, int]], epsilon: float) -> list[tuple[int, int]]:
    if len(pts) <= SHORT_PATH:
        return pts
    if pts[0] == pts[-1]:  # a closed ring: split at the vertex farthest from its start
        far = max(range(len(pts)), key=lambda i: ((pts[i][0] - pts[0][0]) ** 2 + (pts[i][1] - pts[0][1]) ** 2, -i))
        return douglas_peucker(pts[: far + 1], epsilon) + douglas_peucker(pts[far:], epsilon)[1:]
    return douglas_peucker(pts, epsilon)


@dataclass
class Baseline:
    """What simplification starts from: cleaned rings, the same with their neighbours' vertices snapped in, and the chains of these.

    It doesn't depend on an epsilon: stored once, it serves every one."""

    source: DataFrame
    ready: DataFrame
    cut: DataFrame

    TABLES = ("source", "ready", "cut")

    def store(self, folder: str) -> Baseline:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        return self.load(self.source.sparkSession, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Baseline:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in cls.TABLES))


def _cut_up(source: DataFrame, ready: DataFrame) -> Baseline:
    return Baseline(source, ready, settled(chains(ready, fixed_vertices(R.edges(ready)))))


def _snapped(source: DataFrame) -> DataFrame:
    return settled(R.normalise_windings(snap_vertices(source)))


def prepare_baseline(rings: DataFrame) -> Baseline:
    source = settled(R.normalise_windings(clean_rings(rings)))
    return _cut_up(source, _snapped(source))


def _meeting(rings: DataFrame, of: DataFrame) -> DataFrame:
    """The rings whose box meets that of one of the others (R.RING), by the degree cells that boxes reach."""

    def reached(part: DataFrame) -> DataFrame:
        box = R.bounds(R.edges(part), *R.RING)
        across = box.withColumn("cx", F.explode(F.sequence(G.cell(F.col("min_x")), G.cell(F.col("max_x")))))
        return across.withColumn("cy", F.explode(F.sequence(G.cell(F.col("min_y")), G.cell(F.col("max_y")))))

    cells = reached(of).select("cx", "cy").distinct()
    return reached(rings).join(cells, ["cx", "cy"], "left_semi").select(*R.RING).distinct()


def update_baseline(base: Baseline, rings: DataFrame) -> tuple[Baseline, DataFrame]:
    """The baseline of changed rings, and the rings (R.RING) that were snapped again.

    A ring depends on the rings that its box meets; where none of these has changed, come or gone, it stays as it is."""
    source = settled(R.normalise_windings(clean_rings(rings)))
    old, new = (part.select(*R.RING, F.xxhash64("pts").alias(name), F.col("pts").alias(f"{name}_pts")) for part, name in ((base.source, "a"), (source, "b")))
    differ = settled(old.join(new, R.RING, "full").where("not (a <=> b)"))
    moved = differ.select(*R.RING, F.explode(F.array_compact(F.array("a_pts", "b_pts"))).alias("pts"))
    again = settled(_meeting(source, moved)) if differ.count() else settled(source.select(*R.RING).where("false"))
    around = settled(source.join(_meeting(source, source.join(again, R.RING, "left_semi")), R.RING, "left_semi"))
    redone = _snapped(around).join(again, R.RING, "left_semi")
    kept = base.ready.join(again, R.RING, "left_anti").join(source.select(*R.RING), R.RING, "left_semi")
    return _cut_up(source, settled(kept.unionByName(redone.select(kept.columns)))), again


@dataclass
class Simplified:
    """rings; chains (canonical, n_in, n_out), each different one once; judged (the ring's key, back: it kept its own points)."""

    rings: DataFrame
    chains: DataFrame
    judged: DataFrame


def simplify_baseline(base: Baseline, epsilon: float = EPSILON) -> Simplified:
    """Topology-aware simplification: every different chain is simplified once, in its canonical direction.

    A ring keeps its own points if it would have under three different ones, an edge of no length, or, with up to
    CHECKED_POINTS points, edges that cross."""

    @F.pandas_udf("array<struct<x:bigint,y:bigint>>")
    def reduce(pts: pd.Series) -> pd.Series:
        return pts.map(lambda ps: [{"x": x, "y": y} for x, y in _simplify_chain([(int(q["x"]), int(q["y"])) for q in ps], epsilon * 100_000)])

    once = base.cut.groupBy("canonical").agg(F.first(F.when(F.col("forward"), F.col("pts")).otherwise(F.reverse("pts"))).alias("pts"))
    once = settled(once.select("canonical", F.size("pts").alias("n_in"), reduce("pts").alias("short")))
    back = base.cut.join(spread(once), "canonical").select(*R.RING, "seg_idx", F.when(F.col("forward"), F.col("short")).otherwise(F.reverse("short")).alias("s"))
    open_parts = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.slice("s", 1, F.size("s") - 1).alias("s")))), lambda q: q["s"])
    joined = settled(back.groupBy(*R.RING).agg(F.flatten(open_parts).alias("new")))
    n = F.size("new")
    standing = F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.get("new", i) == F.get("new", (i + 1) % n))
    degenerate = (n < 3) | (F.size(F.array_distinct("new")) < 3) | F.when(n > 0, standing).otherwise(F.lit(True))
    small = joined.where((n <= CHECKED_POINTS) & ~degenerate).select(*R.RING, F.col("new").alias("pts"))
    crossed = R.self_intersections(R.edges(small)).select(*R.RING).distinct().withColumn("crossed", F.lit(True))
    judged = settled(joined.join(spread(crossed), R.RING, "left").select(*R.RING, "new", (degenerate | F.coalesce("crossed", F.lit(False))).alias("back")))
    done = base.ready.join(spread(judged), R.RING).withColumn("pts", F.when(F.col("back"), F.col("pts")).otherwise(F.col("new")))
    rings = R.normalise_windings(done.select(base.ready.columns))
    return Simplified(rings, once.select("canonical", "n_in", F.size("short").alias("n_out")), judged.select(*R.RING, "back"))


def simplify(rings: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """simplify_baseline() of the rings' own baseline; columns as they came."""
    return simplify_baseline(prepare_baseline(rings), epsilon).rings.select(rings.columns)


def simplify_stats(base: Baseline, done: Simplified) -> DataFrame:
    """One row: rings by their fixed vertices, what was snapped in, chains by use and length, points, rings that kept their own.

    A shared chain is one of two rings; it is simplified for the first and found again (a hit) for the second."""
    one = F.lit(1).alias("one")
    count = lambda column, name: F.coalesce(F.sum(column), F.lit(0)).alias(name)
    sizes = base.source.select(*R.RING, F.size("pts").alias("before")).join(base.ready.select(*R.RING, F.size("pts").alias("after")), R.RING)
    inputs = sizes.agg(one, F.count(F.lit(1)).alias("input_rings"), count("before", "input_points"), F.count_if(F.col("after") > F.col("before")).alias("snapped_rings"), count(F.col("after") - F.col("before"), "snapped_vertices"))
    # A ring of several chains has a fixed vertex for each; one of a single chain starts at its only one, or has none.
    at = fixed_vertices(R.edges(base.ready)).withColumn("fixed", F.lit(1))
    held = R.vertices(base.ready).withColumn("x", key_x(F.col("x"))).join(at, ["x", "y"], "left").groupBy(*R.RING).agg(F.count("fixed").alias("fixed"))
    by_fixed = held.agg(one, count("fixed", "fixed_vertices"), F.count_if(F.col("fixed") == 0).alias("rings_no_fixed"), F.count_if(F.col("fixed") == 1).alias("rings_one_fixed"), F.count_if(F.col("fixed") > 1).alias("rings_multi_fixed"))
    uses = base.cut.groupBy("canonical").agg(F.count(F.lit(1)).alias("uses")).join(done.chains, "canonical")
    lengths = [(10, "le10"), (25, "le25"), (50, "le50"), (100, "le100"), (None, "gt100")]
    buckets, low = [], 0
    for top, name in lengths:
        inside = (F.col("n_in") > low) if top is None else F.col("n_in").between(low + 1, top)
        buckets.append(count(F.when(inside, F.col("uses")), f"segments_{name}"))
        low = top or low
    shared = F.col("uses") > 1
    by_use = uses.agg(one, count("uses", "segments"), count(F.when(shared, F.col("uses")), "segments_shared"), count(F.when(shared, F.col("uses") - 1), "shared_hits"), F.count_if(shared).alias("shared_misses"), F.count_if(F.col("n_in") <= SHORT_PATH).alias("segments_short"), count(F.col("uses") * F.col("n_in"), "segment_points_in"), count(F.col("uses") * F.col("n_out"), "segment_points_out"), *buckets)
    own = done.judged.join(sizes, R.RING).agg(one, F.count_if("back").alias("rings_fallback"), count(F.when(F.col("back"), F.col("before")), "fallback_points"))
    out = inputs
    for part in (by_fixed, by_use, own):  # one row each
        out = out.join(part, "one")
    return out.drop("one")


def reduce_classic(rings: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Each ring by itself; rings of up to 100 points stay."""

    @F.arrow_udf("array<struct<x:bigint,y:bigint>>")
    def reduce(pts: pa.Array) -> pa.Array:
        flat = pts.flatten()
        xy = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
        ends = np.concatenate([[0], np.cumsum(pts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        keep = np.ones(len(xy), bool)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a > SHORT_RING:
                keep[a:b] = kept_places(xy[a:b].astype(np.float64), epsilon * 100_000)
        lengths = np.concatenate([[0], np.cumsum(keep)])[ends]
        values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in xy[keep].T], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(lengths, pa.int32(), mask=np.r_[~pts.is_valid().to_numpy(zero_copy_only=False), False] if pts.null_count else None), values)

    return rings.withColumn("pts", reduce("pts"))


def deduplicate(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ring_segments, shared_edges): borders of two rings are stored once, in their first use's direction."""
    ready = settled(snap_vertices(settled(R.normalise_windings(clean_rings(rings)))))
    e = R.edges(ready)
    cut = settled(chains(ready, fixed_for_dedup(e)))
    sharing = cut.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*R.RING, "seg_idx")).alias("first"), F.min_by("forward", F.struct(*R.RING, "seg_idx")).alias("first_forward"), F.min_by("pts", F.struct(*R.RING, "seg_idx")).alias("stored"))
    both = settled(numbered(settled(sharing.where("n = 2")), [F.col("first")], "id").withColumn("id", F.col("id").cast("int")))
    library = both.select("id", F.col("stored").alias("pts"))
    joined = cut.join(spread(both.select("canonical", "id", "first_forward")), "canonical", "left")
    kind = F.when(F.col("id").isNull(), "inline").when(F.col("forward") == F.col("first_forward"), "edge_forward").otherwise("edge_reversed")
    segments = joined.select(*R.RING, "seg_idx", kind.alias("kind"), F.col("id").alias("edge_id"), F.when(F.col("id").isNull(), F.col("pts")).alias("pts"))
    return segments, library


def expand(segments: DataFrame, library: DataFrame) -> DataFrame:
    """Rings (open, junctions once) from segments and the edge library; bad ids give no points."""
    # An edge's id is null for what is stored inline: such rows are not gathered in one task.
    stored = library.select(F.col("id").alias("edge_id"), F.col("pts").alias("e"))
    full = segments.where("edge_id is not null").join(spread(stored), "edge_id", "left").unionByName(segments.where("edge_id is null").withColumn("e", F.lit(None).cast("array<struct<x:bigint,y:bigint>>")))
    pts = F.when(F.col("kind") == "inline", F.col("pts")).when(F.col("kind") == "edge_forward", F.col("e")).otherwise(F.reverse("e"))
    parts = full.select(*R.RING, "seg_idx", F.coalesce(pts, F.array().cast("array<struct<x:bigint,y:bigint>>")).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("p")))), lambda s: s["p"])
    return parts.groupBy(*R.RING).agg(F.flatten(ordered).alias("pts"))


def segment_counts(segments: DataFrame, library: DataFrame) -> DataFrame:
    """One row: segments by kind, points stored and points there would be without sharing."""
    kinds = segments.agg(F.lit(1).alias("one"), F.count_if(F.col("kind") == "inline").alias("inline"), F.count_if(F.col("kind") == "edge_forward").alias("edge_forward"), F.count_if(F.col("kind") == "edge_reversed").alias("edge_reversed"), F.coalesce(F.sum(F.size("pts")), F.lit(0)).alias("inline_points"))
    edges = library.agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(F.size("pts")), F.lit(0)).alias("edge_points"))
    return kinds.join(edges, "one").drop("one")  # one row each


def reduction_report(before: DataFrame, after: DataFrame) -> DataFrame:
    def count(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.lit(1).alias("one"), F.countDistinct("tz_idx").alias(f"zones_{tag}"), F.count_if(F.col("hole_idx") >= 0).alias(f"holes_{tag}"), F.coalesce(F.sum(F.size("pts")), F.lit(0)).alias(f"points_{tag}"))

    both = count(before, "before").join(count(after, "after"), "one").drop("one")  # one row each
    return both.withColumn("points_removed_percent", F.round(100 * (1 - F.col("points_after") / F.col("points_before")), 2))


def violations(rings: DataFrame) -> DataFrame:
    """tz_idx, poly_idx, hole_idx, rule: empty for a valid dataset.  Rings are given closed."""
    p = F.col("pts")
    shape = rings.select(*R.RING, F.explode(F.filter(F.array(F.when(F.size(p) < 4, F.lit("fewer than 4 points")), F.when((F.size(p) > 0) & (F.element_at(p, 1) != F.element_at(p, -1)), F.lit("not closed")), F.when(F.size(F.array_distinct(p)) < 3, F.lit("fewer than 3 different points"))), lambda r: r.isNotNull())).alias("rule"))
    e = R.edges(rings)
    area = R.area_perimeter(e)
    flat = area.where(F.abs("signed_area") <= 1e-12).select(*R.RING, F.lit("no area").alias("rule"))
    wrong = area.where(F.abs("signed_area") > 1e-12).where(F.when(F.col("hole_idx") < 0, F.col("signed_area") < 0).otherwise(F.col("signed_area") > 0))
    wound = wrong.select(*R.RING, F.when(F.col("hole_idx") < 0, "clockwise winding").otherwise("counterclockwise winding").alias("rule"))
    zero = e.where("xa = xb and ya = yb").select(*R.RING, F.lit("zero-length edge").alias("rule"))
    crossed = R.self_intersections(e).select(*R.RING, F.lit("self intersects").alias("rule"))
    uses = keyed(e)
    bad = uses.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("forward").cast("int")).alias("f")).where("n = 2 and f <> 1").select("lo", "hi")
    same = uses.join(bad, ["lo", "hi"], "left_semi").select(*R.RING, F.lit("same direction").alias("rule"))
    out = shape
    for part in (flat, wound, zero, crossed, same):
        out = out.unionByName(part)
    return out.distinct()
