"""Table layouts of the engine (Spark DDL)."""

RINGS = "tz_idx int, name string, poly_idx int, hole_idx int, pts array<struct<x:bigint,y:bigint>>"
EDGES = "tz_idx int, poly_idx int, hole_idx int, edge_idx int, xa bigint, ya bigint, xb bigint, yb bigint"
GRID = "cell_lng int, cell_lat int, tz_idx int, n_cand bigint"
TILES = "name string, x bigint, y bigint, z int, key_ord bigint, packed bigint"
SHARED_EDGES = "id int, pts array<struct<x:bigint,y:bigint>>"
RING_SEGMENTS = "tz_idx int, poly_idx int, hole_idx int, seg_idx int, kind string, edge_id int, pts array<struct<x:bigint,y:bigint>>"
GEOJSON_FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>, coordinates string"
EXTERIOR = -1
