"""GeoJSON boundaries: files, zip archives and whole FeatureCollections to rings, and back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import EXTERIOR

_FEATURES = "array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>,coordinates:string>>"
_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def parse_features(collections: DataFrame, name_property: str = "tzid") -> DataFrame:
    """Column value (a FeatureCollection as text) to rings, file order kept in tz_idx.

    Polygon and MultiPolygon are read at feature or geometry level; another type raises."""
    features = collections.select(F.from_json("value", f"struct<type:string,features:{_FEATURES}>")["features"].alias("f"))
    each = features.select(F.posexplode("f").alias("tz_idx", "f"))
    kind = F.when(F.col("f.type").isin("Polygon", "MultiPolygon"), F.col("f.type")).otherwise(F.col("f.geometry.type"))
    raw = F.coalesce(F.col("f.geometry.coordinates"), F.col("f.coordinates"))
    polygons = F.when(kind == "MultiPolygon", F.from_json(raw, _MULTI)).when(kind == "Polygon", F.array(F.from_json(raw, _POLYGON))).otherwise(F.raise_error(F.concat(F.lit("unknown geometry type "), F.coalesce(kind, F.lit("null")))).cast(_MULTI))
    poly = each.select("tz_idx", F.col("f.properties").alias("properties"), polygons.alias("p")).select("tz_idx", "properties", F.posexplode("p").alias("poly_idx", "rings"))
    ring = poly.select("tz_idx", "properties", "poly_idx", F.posexplode("rings").alias("r", "pts"))
    points = F.transform("pts", lambda p: F.struct(G.scaled(p[0].cast("float")).alias("x"), G.scaled(p[1].cast("float")).alias("y")))
    return ring.select("tz_idx", F.col("properties")[name_property].alias("name"), "poly_idx", (F.col("r") + EXTERIOR).alias("hole_idx"), points.alias("pts"), "properties")


def read_geojson(spark: SparkSession, path: str, name_property: str = "tzid") -> DataFrame:
    return parse_features(spark.read.text(path, wholetext=True), name_property)


def read_geojson_zip(spark: SparkSession, path: str, name_property: str = "tzid") -> DataFrame:
    """A zip archive with exactly one .json or .geojson file inside."""

    def unzip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for data in part["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith((".json", ".geojson"))]
                    if len(names) != 1:
                        raise ValueError(f"the archive holds {len(names)} GeoJSON files, not one")
                    out.append(z.read(names[0]).decode())
            yield pd.DataFrame({"value": out})

    return parse_features(spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "value string"), name_property)


def load_zones(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Rings from Parquet, GeoJSON or a zipped GeoJSON, by suffix unless form says."""
    low = path.lower()
    form = form or ("zip" if low.endswith(".zip") else "geojson" if low.endswith((".json", ".geojson")) else "parquet")
    return {"zip": read_geojson_zip, "geojson": read_geojson, "parquet": lambda s, p: s.read.parquet(p)}[form](spark, path)


def features(rings: DataFrame) -> DataFrame:
    """tz_idx, name, feature (JSON text): a MultiPolygon for each zone."""
    degrees = F.transform(G.close_ring(F.col("pts")), lambda p: F.array(p["x"] / 100_000.0, p["y"] / 100_000.0))
    drawn = rings.where(F.size("pts") > 0).select("tz_idx", "name", "poly_idx", F.struct("hole_idx", degrees.alias("c")).alias("r"))
    polys = drawn.groupBy("tz_idx", "name", "poly_idx").agg(F.array_sort(F.collect_list("r")).alias("rs")).where(F.get("rs", F.lit(0))["hole_idx"] == EXTERIOR)
    zones = polys.groupBy("tz_idx", "name").agg(F.array_sort(F.collect_list(F.struct("poly_idx", F.transform("rs", lambda r: r["c"]).alias("c")))).alias("ps"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("ps", lambda p: p["c"]).alias("coordinates"))
    return zones.select("tz_idx", "name", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("name").alias("tzid")).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def feature_collection(rings: DataFrame, name: str | None = None) -> DataFrame:
    """One row: the FeatureCollection of the zones of a name (of all without one); raises if there is none."""
    chosen = features(rings if name is None else rings.where(F.col("name") == name))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tz_idx", "feature"))), lambda s: s["feature"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}"))
    return chosen.agg(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("no timezone found")).cast("string")).otherwise(text).alias("value"))


def parse_point_lines(lines: DataFrame, order: str = "lng-lat") -> DataFrame:
    """Column value, two numbers split by blanks, commas or semicolons, to lng and lat; other counts raise."""
    parts = F.filter(F.split("value", "[ \\t,;]+"), lambda s: s != "")
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("two numbers are wanted: "), F.col("value"))).cast("array<string>"))
    a, b = ("lng", "lat") if order == "lng-lat" else ("lat", "lng")
    return lines.withColumn("__p", checked).withColumns({a: F.get("__p", F.lit(0)).cast("double"), b: F.get("__p", F.lit(1)).cast("double")}).drop("__p")
