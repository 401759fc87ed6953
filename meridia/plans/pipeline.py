"""The offline build: boundaries in, serving tables out; each step is Parquet that the next one reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.polyline import decode_points, encode_points, points_box
from ..operators import finder, tiles, topology
from ..operators import rings as R
from ..sources.geojson import load_zones
from ..stages import settled

POLYLINE = 1


def compress(rings: DataFrame) -> DataFrame:
    """Rings with their points as polyline bytes."""
    return rings.select(*R.RING, "name", F.lit(POLYLINE).alias("method"), encode_points("pts").alias("bytes"))


def decompress(rows: DataFrame) -> DataFrame:
    method = F.when(F.col("method") == POLYLINE, F.col("bytes")).otherwise(F.raise_error(F.lit("unknown compression method")).cast("binary"))
    return rows.select("tz_idx", "name", "poly_idx", "hole_idx", decode_points(method).alias("pts"))


def compress_topology(segments: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    packed = encode_points("pts")
    return segments.withColumn("bytes", packed).drop("pts"), library.withColumn("bytes", packed).drop("pts")


def decompress_topology(segments: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    points = decode_points("bytes")
    return segments.withColumn("pts", points).drop("bytes"), library.withColumn("pts", points).drop("bytes")


def compressed_bounds(segments: DataFrame, library: DataFrame, exteriors_only: bool = False) -> DataFrame:
    """tz_idx, min_x, min_y, max_x, max_y from compressed topology: a shared edge's bytes are read once, however many rings use it.

    No ring is put together; holes count unless exteriors_only.  An edge id that the library lacks adds nothing."""
    own = segments if not exteriors_only else segments.where("hole_idx < 0")
    boxed = library.select(F.col("id").alias("edge_id"), points_box("bytes").alias("b"))
    inline = own.where("bytes is not null").select("tz_idx", points_box("bytes").alias("b"))
    shared = own.where("edge_id is not null").select("tz_idx", "edge_id").distinct().join(boxed, "edge_id").select("tz_idx", "b")
    low, high = (lambda c: F.min(f"b.{c}").alias(c)), (lambda c: F.max(f"b.{c}").alias(c))
    return inline.unionByName(shared).where("b is not null").groupBy("tz_idx").agg(low("min_x"), low("min_y"), high("max_x"), high("max_y"))


def compressed_grid(segments: DataFrame, library: DataFrame) -> DataFrame:
    """The one-degree grid of a compressed topology (finder.build_grid() of its boxes), to be stored beside it."""
    return finder.grid_of(compressed_bounds(segments, library))


def finder_from_topology(segments: DataFrame, library: DataFrame, names: DataFrame, version: str = "", use_grid: bool = True) -> finder.ZoneFinder:
    """The finder of a compressed topology: segments and shared edges (bytes), and the zones' names (tz_idx, name)."""
    rings = settled(topology.expand(*decompress_topology(segments, library)))
    return finder.ZoneFinder.from_rings(rings.join(names.select("tz_idx", "name").distinct(), "tz_idx"), version, use_grid)


@dataclass
class ZonePipeline:
    spark: SparkSession
    folder: str
    version: str = ""

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def ingest(self, path: str, form: str | None = None) -> DataFrame:
        return self._store(load_zones(self.spark, path, form), "zones")

    def baseline(self) -> topology.Baseline:
        """The snapped rings and their chains, stored: further epsilons start here."""
        return topology.prepare_baseline(self.read("zones").drop("properties")).store(f"{self.folder}/baseline")

    def reduce(self, epsilon: float = topology.EPSILON, base: topology.Baseline | None = None) -> DataFrame:
        done = topology.simplify_baseline(base or self.baseline(), epsilon)
        out = self._store(done.rings, "reduced")
        if bad := topology.violations(out.withColumn("pts", G.close_ring(F.col("pts")))).limit(5).collect():
            raise ValueError(f"the simplified dataset is not valid: {bad}")
        return out

    def deduplicate(self, source: str = "reduced") -> tuple[DataFrame, DataFrame]:
        segments, library = topology.deduplicate(self.read(source))
        return self._store(segments, "segments"), self._store(library, "shared_edges")

    def compress_topology(self) -> tuple[DataFrame, DataFrame]:
        segments, library = compress_topology(self.read("segments"), self.read("shared_edges"))
        self._store(compressed_grid(segments, library), "grid_compressed")  # travels with the set
        return self._store(segments, "segments_compressed"), self._store(library, "shared_edges_compressed")

    def topology_finder(self, source: str = "reduced", use_grid: bool = True) -> finder.ZoneFinder:
        return finder_from_topology(self.read("segments_compressed"), self.read("shared_edges_compressed"), self.read(source), self.version, use_grid)

    def compress(self, source: str = "reduced") -> DataFrame:
        return self._store(compress(self.read(source)), "compressed")

    def grid(self, source: str = "reduced") -> DataFrame:
        return self._store(finder.build_grid(R.edges(self.read(source))), "grid")

    def preindex(self, source: str = "reduced", **settings) -> DataFrame:
        return self._store(tiles.preindex(self.read(source), **settings), "tiles")

    def finder(self, source: str = "reduced", use_grid: bool = True) -> finder.ZoneFinder:
        return finder.ZoneFinder.from_rings(self.read(source), self.version, use_grid)

    def default_finder(self, agg_zoom: int, idx_zoom: int, source: str = "reduced") -> finder.DefaultFinder:
        return finder.DefaultFinder(finder.FuzzyFinder(self.read("tiles"), agg_zoom, idx_zoom, self.version), self.finder(source))
