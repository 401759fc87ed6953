"""Synthetic points and zones: integer arithmetic only, the same in every engine."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RINGS
from ..stages import settled

D = 100_000  # a degree
Ring = tuple[int, str, int, int, list[tuple[int, int]]]


def box(x0: int, y0: int, x1: int, y1: int, clockwise: bool = False) -> list[tuple[int, int]]:
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return ring[::-1] if clockwise else ring


def nautical() -> list[Ring]:
    """25 strips of 15 degrees, named like the nautical zones."""
    out = []
    for k in range(-12, 13):
        name = "Etc/GMT" if k == 0 else f"Etc/GMT-{k}" if k > 0 else f"Etc/GMT+{-k}"
        x0, x1 = max(-180 * D, 15 * k * D - 15 * D // 2), min(180 * D, 15 * k * D + 15 * D // 2)
        out.append((k + 12, name, 0, -1, box(x0, -90 * D, x1, 90 * D)))
    return out


def nations() -> list[Ring]:
    """A 5 x 5 grid of boxes; each has a square hole that an enclave fills."""
    out = []
    for k in range(25):
        x, y = (k % 5) * 30 * D - 75 * D, (k // 5) * 20 * D - 50 * D
        hole = (x + 10 * D, y + 5 * D, x + 20 * D, y + 15 * D)
        out += [(2 * k, f"nation/{k:02d}", 0, -1, box(x, y, x + 30 * D, y + 20 * D)), (2 * k, f"nation/{k:02d}", 0, 0, box(*hole, clockwise=True)), (2 * k + 1, f"nation/{k:02d}/enclave", 0, -1, box(*hole))]
    return out


def overlap() -> list[Ring]:
    """Two zones over one box, and one elsewhere."""
    return [(0, "Zulu", 0, -1, box(-60 * D, -40 * D, 60 * D, 40 * D)), (1, "Alpha", 0, -1, box(-60 * D, -40 * D, 60 * D, 40 * D)), (2, "Mike", 0, -1, box(100 * D, -40 * D, 140 * D, 40 * D))]


def jagged(steps: int = 40) -> list[Ring]:
    """The strips with crooked meridians that neighbours share."""

    def meridian(k: int) -> list[tuple[int, int]]:
        x = max(-180 * D, min(180 * D, 15 * k * D - 15 * D // 2))
        ys = [-90 * D + i * 180 * D // steps for i in range(steps + 1)]
        inner = -12 < k < 13
        return [(x + (((k * 7919 + i * 104_729) % 60_001) - 30_000 if inner and 0 < i < steps else 0), y) for i, y in enumerate(ys)]

    return [(k + 12, f"Jag/{k + 12:02d}", 0, -1, meridian(k) + meridian(k + 1)[::-1]) for k in range(-12, 13)]


def rings(spark: SparkSession, rows: list[Ring]) -> DataFrame:
    return spark.createDataFrame([(t, n, p, h, [(x, y) for x, y in pts]) for t, n, p, h, pts in rows], RINGS)


def edge_rows(rows: list[Ring]) -> list[tuple]:
    return [(t, p, h, i, *pts[i], *pts[(i + 1) % len(pts)]) for t, _, p, h, pts in rows for i in range(len(pts))]


def edges_sql(rows: list[Ring]) -> str:
    """The edge table as a VALUES list, for an oracle."""
    return "(VALUES " + ",".join(str(tuple(r)) for r in edge_rows(rows)) + ") e(tz_idx, poly_idx, hole_idx, edge_idx, xa, ya, xb, yb)"


def zones_sql(rows: list[Ring]) -> str:
    return "(VALUES " + ",".join(f"({t}, '{n}')" for t, n in sorted({(t, n) for t, n, *_ in rows})) + ") z(tz_idx, name)"


def hashed_points(table: DataFrame, key: str) -> DataFrame:
    k = F.col(key).cast("long")
    return table.select(k.alias("pt_id"), ((k * 7919 * 13) % 36_000_001 - 18_000_000).alias("px"), ((k * 104_729) % 18_000_001 - 9_000_000).alias("py"))


def border_points(table: DataFrame, key: str) -> DataFrame:
    k = F.col(key).cast("long")
    return table.select(k.alias("pt_id"), (-17_250_000 + 1_500_000 * (k % 24)).alias("px"), ((k * 104_729) % 18_000_001 - 9_000_000).alias("py"))


def sweep_points(spark: SparkSession) -> DataFrame:
    return spark.range(360 * 180).select(F.col("id").alias("pt_id"), (-17_950_000 + D * (F.col("id") % 360)).alias("px"), (-8_950_000 + D * F.floor(F.col("id") / 360)).cast("long").alias("py"))


def points_sql(table: str, key: str) -> str:
    return f"(SELECT {key} AS pt_id, ({key} * 7919 * 13) % 36000001 - 18000000 AS px, ({key} * 104729) % 18000001 - 9000000 AS py FROM {table})"


def border_points_sql(table: str, key: str) -> str:
    return f"(SELECT {key} AS pt_id, -17250000 + 1500000 * ({key} % 24) AS px, ({key} * 104729) % 18000001 - 9000000 AS py FROM {table})"


# Zones drawn from the rows of a given table

PARTS = 8  # of a zone's side
CORNERS = 4 * PARTS


def _patch_steps(divide: str, south: int) -> list[list[str]]:
    """The steps, as SQL of k, w, sx, sy, kind and q, to the place x, y of a zone's q-th corner; kind 0: its rim, else the rim of its enclave.

    Rows k fill a lattice w wide, row by row.  Nodes and the parts of a side are moved by integers that the neighbours share."""

    def node(a: str, b: str, at: str) -> list[str]:
        return [
            f"CASE WHEN kind = 0 THEN {a} * sx + ({a} * 7919 + {b} * 104729) % (sx {divide} 8 + 1) ELSE i * sx + 3 * sx {divide} 8 * (1 + {a} - i) END AS x{at}",
            f"CASE WHEN kind = 0 THEN {b} * sy + ({a} * 15485863 + {b} * 7919 + 13) % (sy {divide} 8 + 1) ELSE j * sy + 3 * sy {divide} 8 * (1 + {b} - j) END AS y{at}",
        ]

    moved = "CASE WHEN along > 0 AND along < {p} AND {way} THEN (hi * 13 + hj * 37 + along * 7919 + kind * 101) % ({s} {d} 32 + 1) ELSE 0 END"
    return [
        ["k % w AS i", f"k {divide} w AS j", f"q {divide} {PARTS} AS side", f"q % {PARTS} AS t"],
        [f"CASE WHEN side < 2 THEN t ELSE {PARTS} - t END AS along", "i + CASE WHEN side = 1 THEN 1 ELSE 0 END AS hi", "j + CASE WHEN side = 2 THEN 1 ELSE 0 END AS hj"],
        ["hi + 1 - side % 2 AS ei", "hj + side % 2 AS ej"],
        [*node("hi", "hj", "a"), *node("ei", "ej", "b")],
        [
            f"(xa * ({PARTS} - along) + xb * along) {divide} {PARTS} + {moved.format(p=PARTS, way='side % 2 = 1', s='sx', d=divide)} - 17000000 AS x",
            f"(ya * ({PARTS} - along) + yb * along) {divide} {PARTS} + {moved.format(p=PARTS, way='side % 2 = 0', s='sy', d=divide)} + {south} AS y",
        ],
    ]


class Patches:
    """One zone for each row of a table (its key counts from 0): crooked sides shared with the neighbours, and in every third
    a hole that another zone fills.  tz_idx: twice the key, one more for the enclave."""

    def __init__(self, table: str = "supplier", key: str = "s_suppkey", most: int = 34_000_000, south: int = -8_000_000):
        """most: of a zone's width and height; they are less where all rows would not fit.  south: where the lattice begins."""
        self.table, self.key, self.most, self.south = table, key, most, south

    def rings(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").select(F.col(self.key).cast("long").alias("k"))
        w = math.ceil(math.sqrt(1 + (rows.agg(F.max("k")).first()[0] or 0)))
        sized = rows.withColumns({"w": F.lit(w).cast("long"), "sx": F.lit(min(34_000_000 // w, self.most)).cast("long"), "sy": F.lit(min((8_000_000 - self.south) // w, self.most)).cast("long")})
        at = sized.withColumn("kind", F.explode(F.expr("CASE WHEN k % 3 = 0 THEN array(0L, 1L, 2L) ELSE array(0L) END"))).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CORNERS - 1).cast("long"))))
        at = at.withColumn("q", F.when(F.col("kind") == 1, CORNERS - 1 - F.col("idx")).otherwise(F.col("idx")))
        for step in _patch_steps("div", self.south):
            at = at.selectExpr("*", *step)
        own = at.groupBy("k", "kind").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("c")).withColumn("pts", F.transform("c", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))))
        name = F.concat(F.lit("zone/"), F.col("k").cast("string"), F.when(F.col("kind") == 2, "/enclave").otherwise(""))
        return settled(own.select((2 * F.col("k") + F.when(F.col("kind") == 2, 1).otherwise(0)).cast("int").alias("tz_idx"), name.alias("name"), F.lit(0).alias("poly_idx"), F.when(F.col("kind") == 1, 0).otherwise(-1).alias("hole_idx"), "pts"))  # a dataset as if it were stored

    def points_sql(self) -> str:
        """tz_idx, poly_idx, hole_idx, idx, n, x, y of every corner."""
        w = f"cast(ceil(sqrt((SELECT max({self.key}) + 1 FROM {self.table}))) AS bigint)"
        rows = f"SELECT cast({self.key} AS bigint) AS k, {w} AS w, least(34000000 // {w}, {self.most}) AS sx, least({8_000_000 - self.south} // {w}, {self.most}) AS sy FROM {self.table}"
        each = f"SELECT *, CASE WHEN kind = 1 THEN {CORNERS - 1} - idx ELSE idx END AS q FROM (SELECT *, unnest(range({CORNERS})) AS idx FROM (SELECT *, unnest(CASE WHEN k % 3 = 0 THEN [0, 1, 2] ELSE [0] END) AS kind FROM ({rows})))"
        for step in _patch_steps("//", self.south):
            each = f"SELECT *, {', '.join(step)} FROM ({each})"
        return f"(SELECT 2 * k + CASE WHEN kind = 2 THEN 1 ELSE 0 END AS tz_idx, 0 AS poly_idx, CASE WHEN kind = 1 THEN 0 ELSE -1 END AS hole_idx, idx, {CORNERS} AS n, x, y FROM ({each}))"

    def edges_sql(self) -> str:
        points = self.points_sql()
        step = "OVER (PARTITION BY tz_idx, poly_idx, hole_idx ORDER BY idx)"
        whole = "OVER (PARTITION BY tz_idx, poly_idx, hole_idx ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"(SELECT tz_idx, poly_idx, hole_idx, idx AS edge_idx, x AS xa, y AS ya, coalesce(lead(x) {step}, first_value(x) {whole}) AS xb, coalesce(lead(y) {step}, first_value(y) {whole}) AS yb FROM {points}) e"

    def zones_sql(self) -> str:
        return f"(SELECT 2 * {self.key} AS tz_idx, 'zone/' || {self.key} AS name FROM {self.table} UNION ALL SELECT 2 * {self.key} + 1, 'zone/' || {self.key} || '/enclave' FROM {self.table} WHERE {self.key} % 3 = 0) z"


class Drawn:
    """Zones given as literal rings."""

    def __init__(self, rows: list[Ring]):
        self.rows = rows

    def rings(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rings(spark, self.rows)

    def edges_sql(self) -> str:
        return edges_sql(self.rows)

    def zones_sql(self) -> str:
        return zones_sql(self.rows)
