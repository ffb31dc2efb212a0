"""DuckDB SQL oracles for the registered queries.

Independent of Spark: the grids are re-derived from the parquet views, window
grids come from ``range``, and zonal membership is tested by brute-force
crossing parity instead of scanline runs.
"""

from __future__ import annotations

import json

from . import queries as q
from ..operators.sweep import REFERENCE_TILE_SIZES
from .sql_fixtures import with_ctes, with_grids

V, NEW, N, CH, MT = q.VALUE, q.NEW_VALUE, q.TILE, q.CHUNK, q.MAX_TILE
X0, Y0, DX, DY, SRID = -180.0, 90.0, 0.1, 0.1, 4326
TW, TH = N * DX, N * DY

SQL: dict[str, str] = {}


def _keys(src: str) -> str:
    return (f"SELECT CAST(floor(x / {N}) AS INTEGER) AS tc, CAST(floor(y / {N}) AS INTEGER) AS tr, x, y, v "
            f"FROM {src}")


def _metadata(name: str) -> str:
    src = name.lower()
    return f"""SELECT '{name}' AS raster, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax,
  CAST(max(x) + 1 AS INTEGER) AS cols, CAST(max(y) + 1 AS INTEGER) AS rows,
  count(*) AS cells, count(v) AS data_cells, {N} AS tile_size,
  CAST(ceil((max(x) + 1) / {N}) AS INTEGER) AS layout_cols,
  CAST(ceil((max(y) + 1) / {N}) AS INTEGER) AS layout_rows,
  round({X0}::DOUBLE + min(x) * {DX}::DOUBLE, 9) AS ext_xmin,
  round({Y0}::DOUBLE - (max(y) + 1) * {DY}::DOUBLE, 9) AS ext_ymin,
  round({X0}::DOUBLE + (max(x) + 1) * {DX}::DOUBLE, 9) AS ext_xmax,
  round({Y0}::DOUBLE - min(y) * {DY}::DOUBLE, 9) AS ext_ymax,
  {SRID} AS srid
FROM {src}"""


SQL["scan_cells"] = with_grids("SELECT x, y, v FROM a", "A")

SQL["layer_metadata"] = with_grids(
    "\nUNION ALL\n".join(_metadata(n) for n in ("A", "B", "C")), "A", "B", "C")

SQL["layer_metadata_stored"] = SQL["layer_metadata"]

SQL["tile_layout"] = with_grids(f"""SELECT tc, tr, CAST({N * N} AS BIGINT) AS tile_cells,
  count(v) AS data_cells,
  CAST(coalesce(sum(((y % {N}) * {N} + x % {N} + 1) * CAST(v AS BIGINT)), 0) AS BIGINT) AS checksum
FROM ({_keys('a')}) k GROUP BY tc, tr""", "A")

_EXTENT = f"""round({X0}::DOUBLE + tc * {TW!r}::DOUBLE, 9) AS xmin,
  round({Y0}::DOUBLE - (tr + 1) * {TH!r}::DOUBLE, 9) AS ymin,
  round({X0}::DOUBLE + (tc + 1) * {TW!r}::DOUBLE, 9) AS xmax,
  round({Y0}::DOUBLE - tr * {TH!r}::DOUBLE, 9) AS ymax"""

_TILES = f"SELECT DISTINCT tc, tr FROM ({_keys('a')}) k"

SQL["tile_extent"] = with_grids(f"SELECT tc, tr, {_EXTENT} FROM ({_TILES}) t", "A")

SQL["tile_extent_text"] = with_grids(f"""SELECT tc, tr,
  'Extent(' || concat_ws(',', CAST(xmin AS VARCHAR), CAST(ymin AS VARCHAR), CAST(xmax AS VARCHAR),
  CAST(ymax AS VARCHAR)) || '),' || CAST({N * N} AS VARCHAR) AS line
FROM (SELECT tc, tr, {_EXTENT} FROM ({_TILES}) t) e""", "A")

SQL["tile_dimensions"] = with_grids(f"""SELECT tc, tr, {N} AS cols, {N} AS rows,
  CAST({N * N} AS BIGINT) AS size, '{N},{N}' AS dims_text, '{N * N}' AS size_text
FROM ({_TILES}) t""", "A")


def _windows(name: str, size: int) -> str:
    src = name.lower()
    return f"""SELECT '{name}' AS raster, CAST(wc * {size} AS INTEGER) AS win_x, CAST(wr * {size} AS INTEGER) AS win_y,
  CAST(least({size}, cols - wc * {size}) AS INTEGER) AS cols,
  CAST(least({size}, rows - wr * {size}) AS INTEGER) AS rows,
  CAST(least({size}, cols - wc * {size}) * least({size}, rows - wr * {size}) AS BIGINT) AS size,
  CAST(least({size}, cols - wc * {size}) AS VARCHAR) || ',' || CAST(least({size}, rows - wr * {size}) AS VARCHAR) AS dims_text,
  CAST(least({size}, cols - wc * {size}) * least({size}, rows - wr * {size}) AS VARCHAR) AS size_text
FROM (SELECT cols, rows, wc, unnest(range(0, CAST(ceil(rows / {size}) AS BIGINT))) AS wr
      FROM (SELECT cols, rows, unnest(range(0, CAST(ceil(cols / {size}) AS BIGINT))) AS wc
            FROM (SELECT max(x) + 1 AS cols, max(y) + 1 AS rows FROM {src}) m) w1) w2"""


SQL["chunk_windows"] = with_grids(_windows("A", CH), "A")
SQL["max_tile_windows"] = with_grids(
    "\nUNION ALL\n".join(_windows(n, MT) for n in ("A", "B", "C")), "A", "B", "C")

SQL["count_tiles"] = with_grids("\nUNION ALL\n".join(
    f"SELECT '{n}' AS raster, count(*) AS n_tiles FROM "
    f"(SELECT DISTINCT floor(x / {N}), floor(y / {N}) FROM {n.lower()}) t" for n in ("A", "B", "C")),
    "A", "B", "C")

# ------------------------------------------------------------------ local

SQL["count_value"] = with_grids(f"SELECT count(*) AS n FROM a WHERE v = {V}", "A")
SQL["count_value_tiles"] = SQL["count_value"]

SQL["count_value_by_tile"] = with_grids(f"""SELECT tc, tr,
  CAST(sum(CASE WHEN v = {V} THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM ({_keys('a')}) k GROUP BY tc, tr""", "A")
SQL["count_value_by_tile_tiles"] = SQL["count_value_by_tile"]

_RECLASS = f"CASE WHEN v = {V} THEN {NEW} ELSE -999 END"

SQL["reclassify"] = with_grids(f"SELECT x, y, {_RECLASS} AS v FROM a", "A")

SQL["reclassify_count"] = with_grids(f"""SELECT count(*) FILTER (WHERE r = {NEW}) AS n_new,
  count(*) FILTER (WHERE r = -999) AS n_other
FROM (SELECT {_RECLASS} AS r FROM a) t""", "A")
SQL["reclassify_count_tiles"] = SQL["reclassify_count"]

SQL["reclassify_roundtrip"] = with_grids(f"""SELECT v, count(*) AS n FROM (
  SELECT CASE WHEN ({_RECLASS}) = {NEW} THEN {V} ELSE -999 END AS v FROM a) t GROUP BY v""", "A")

SQL["raster_add"] = with_grids("SELECT a.x, a.y, CAST(a.v + b.v AS BIGINT) AS v FROM a JOIN b ON a.x = b.x AND a.y = b.y",
                               "A", "B")

SQL["raster_add_count"] = with_grids(
    f"SELECT count(*) AS n FROM a JOIN b ON a.x = b.x AND a.y = b.y WHERE a.v + b.v = {2 * V}", "A", "B")
SQL["raster_add_count_tiles"] = SQL["raster_add_count"]

SQL["raster_self_add_count"] = with_grids(
    f"SELECT count(*) AS n FROM a JOIN a AS a2 ON a.x = a2.x AND a.y = a2.y WHERE a.v + a2.v = {2 * V}", "A")

SQL["raster_add_n"] = with_grids("""SELECT a.x, a.y, CAST(a.v + b.v + a2.v AS BIGINT) AS v
FROM a JOIN b ON a.x = b.x AND a.y = b.y JOIN a AS a2 ON a.x = a2.x AND a.y = a2.y""", "A", "B")

# ------------------------------------------------------------------ focal


def _focal(same_tile: bool, r: int = 1) -> str:
    tile = (f" AND floor(q.x / {N}) = floor(p.x / {N}) AND floor(q.y / {N}) = floor(p.y / {N})"
            if same_tile else "")
    return f"""SELECT p.x, p.y, CAST(sum(q.v) AS DOUBLE) / CAST(nullif(count(q.v), 0) AS DOUBLE) AS v
FROM a p JOIN a q ON q.x BETWEEN p.x - {r} AND p.x + {r} AND q.y BETWEEN p.y - {r} AND p.y + {r}{tile}
GROUP BY p.x, p.y"""


SQL["focal_mean_tile"] = with_grids(_focal(True), "A")
SQL["focal_mean_halo"] = with_grids(_focal(False), "A")
SQL["focal_mean_radius"] = with_grids(_focal(False, q.RADIUS), "A")
SQL["focal_mean_count"] = with_grids(f"SELECT count(*) AS n FROM ({_focal(True)}) f WHERE trunc(v) = {V}", "A")
SQL["focal_mean_count_halo"] = with_grids(
    f"SELECT count(*) AS n FROM ({_focal(False)}) f WHERE trunc(v) = {V}", "A")
SQL["corner_sample"] = with_grids(f"""SELECT CAST(x // {N} AS INTEGER) AS tc, CAST(y // {N} AS INTEGER) AS tr, v
FROM ({_focal(True)}) f WHERE x % {N} = 0 AND y % {N} = 0 ORDER BY tr, tc LIMIT 5""", "A")

# ------------------------------------------------------------------ zonal


def _zone_values() -> tuple[str, str]:
    """Zone keys and ring edges of the fixture as SQL VALUES lists."""
    with open(q.ZONES_PATH) as f:
        fc = json.load(f)
    keys, edges = [], []
    for feat in fc["features"]:
        g = feat["geometry"]
        parts = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
        p = feat["properties"]
        keys.append(f"('{feat['id']}', '{p['NAME']}', {int(p['ID'])}, '{g['type']}')")
        for number, part in enumerate(parts):
            for ring in part:
                if ring[0] != ring[-1]:
                    ring = ring + [ring[0]]
                for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
                    edges.append(f"('{feat['id']}', {number}, {float(x1)!r}::DOUBLE, {float(y1)!r}::DOUBLE, "
                                 f"{float(x2)!r}::DOUBLE, {float(y2)!r}::DOUBLE)")
    return ",\n  ".join(keys), ",\n  ".join(edges)


_KEYS, _EDGES = _zone_values()

# Brute-force parity: a cell is inside a zone when an odd number of the edges of
# one of the zone's parts cross its row centre at or left of its centre.
_INSIDE = """SELECT DISTINCT zone_id, x, y, v FROM (SELECT e.zone_id, e.part, c.x, c.y, c.v
FROM {grid} c JOIN edges e
  ON (e.y1 > c.y + 0.5::DOUBLE) <> (e.y2 > c.y + 0.5::DOUBLE)
 AND c.x + 0.5::DOUBLE >= e.x1 + (c.y + 0.5::DOUBLE - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
GROUP BY e.zone_id, e.part, c.x, c.y, c.v HAVING count(*) % 2 = 1) p"""

_HIST = "SELECT zone_id, v, count(*) AS n FROM inside WHERE v IS NOT NULL GROUP BY zone_id, v"

_STATS = """SELECT k.zone_id, k.name, k.zid, coalesce(s.n, 0) AS n, s.min, s.max, s.mean, md.median, s.mode,
  sqrt(CAST(s.s2 - (s.s1 // s.n) * (s.s1 // s.n) * s.n - 2 * (s.s1 // s.n) * (s.s1 % s.n) AS DOUBLE) / CAST(s.n AS DOUBLE)
    - (CAST(s.s1 % s.n AS DOUBLE) / CAST(s.n AS DOUBLE)) * (CAST(s.s1 % s.n AS DOUBLE) / CAST(s.n AS DOUBLE))) AS stddev
FROM zkeys k LEFT JOIN (
  SELECT h.zone_id, CAST(sum(n) AS BIGINT) AS n, min(v) AS min, max(v) AS max,
    CAST(sum(CAST(v AS BIGINT) * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mean,
    CAST(sum(CAST(v AS HUGEINT) * v * n) AS HUGEINT) AS s2, CAST(sum(CAST(v AS BIGINT) * n) AS HUGEINT) AS s1,
    arg_min(v, (-n, v)) AS mode
  FROM hist h GROUP BY h.zone_id) s ON k.zone_id = s.zone_id
LEFT JOIN (
  SELECT zone_id, CAST(quantile_cont(v, 0.5) AS DOUBLE) AS median
  FROM inside WHERE v IS NOT NULL GROUP BY zone_id) md ON k.zone_id = md.zone_id{where}"""


def _zonal(body: str, types: tuple[str, ...] = ("Polygon", "MultiPolygon"), grid: str = "A") -> str:
    tlist = ", ".join(f"'{t}'" for t in types)
    return with_ctes(body, (grid,), [
        ("zkeys", f"SELECT * FROM (VALUES\n  {_KEYS}) t(zone_id, name, zid, geom_type) WHERE geom_type IN ({tlist})"),
        ("edges", f"SELECT e.* FROM (VALUES\n  {_EDGES}) e(zone_id, part, x1, y1, x2, y2) "
                  f"JOIN zkeys USING (zone_id)"),
        ("inside", _INSIDE.format(grid=grid.lower())),
        ("hist", _HIST),
    ])


def _stats_sql(types=("Polygon", "MultiPolygon"), cols: str | None = None) -> str:
    body = _STATS.format(where="")
    if cols:
        body = f"SELECT {cols} FROM ({body}) st"
    else:
        body = f"SELECT 'zones' AS zone_set, st.* FROM ({body}) st"
    return _zonal(body, types)


SQL["zonal_histogram"] = _zonal("SELECT 'zones' AS zone_set, zone_id, v, n FROM hist")
SQL["zonal_statistics"] = _stats_sql()
SQL["zonal_statistics_polygons"] = _stats_sql(("Polygon",))
SQL["zonal_statistics_multipolygons"] = _stats_sql(("MultiPolygon",))
SQL["zonal_min_max_mean"] = _stats_sql(cols="'zones' AS zone_set, zone_id, min, max, mean")
SQL["zonal_cells"] = _zonal("SELECT 'zones' AS zone_set, zone_id, x, y, v FROM inside")

# ------------------------------------------------------------------ sweep

_SIZES = ", ".join(f"({s})" for s in REFERENCE_TILE_SIZES)
SQL["tile_size_sweep"] = with_grids(f"""SELECT tile_size, count(*) AS n_tiles,
  CAST(sum(nv) AS BIGINT) AS n_value, CAST(sum(nd) AS BIGINT) AS data_cells
FROM (SELECT s.tile_size, floor(x / s.tile_size) AS tc, floor(y / s.tile_size) AS tr,
        count(*) FILTER (WHERE v = {V}) AS nv, count(v) AS nd
      FROM a, (VALUES {_SIZES}) s(tile_size) GROUP BY 1, 2, 3) t
GROUP BY tile_size""", "A")
SQL["zonal_histogram_tiles"] = SQL["zonal_histogram"]
SQL["zonal_statistics_tiles"] = SQL["zonal_statistics"]
SQL["focal_mean_count_tiles"] = SQL["focal_mean_count"]
SQL["focal_mean_tiles"] = with_grids(f"SELECT * FROM ({_focal(True)}) f", "A")
SQL["focal_mean_tiles_halo"] = with_grids(f"SELECT * FROM ({_focal(False)}) f", "A")
SQL["focal_mean_count_tiles_halo"] = SQL["focal_mean_count_halo"]
SQL["zonal_min_max_mean_float"] = _zonal("""SELECT 'zones' AS zone_set, k.zone_id,
  s.min, s.max, round(s.mean, 6) AS mean
FROM zkeys k LEFT JOIN (SELECT zone_id, count(*) AS n, min(v) AS min, max(v) AS max, avg(v) AS mean
  FROM inside WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY zone_id) s ON k.zone_id = s.zone_id""", grid="C")
SQL["raster_add_n_tiles"] = with_grids("""SELECT a.x, a.y, CAST(a.v + b.v + a.v AS BIGINT) AS v
FROM a JOIN b ON a.x = b.x AND a.y = b.y""", "A", "B")
SQL["raster_add_offset"] = with_grids("""SELECT a.x, a.y, CAST(a.v + b.v AS BIGINT) AS v
FROM a JOIN b ON a.x = b.x + 25 AND a.y = b.y + 25""", "A", "B")
SQL["raster_add_mixed"] = with_grids("""SELECT a.x, a.y, CAST(a.v AS DOUBLE) + c.v AS v
FROM a JOIN c ON a.x = c.x AND a.y = c.y""", "A", "C")
SQL["tiles_round_trip"] = SQL["scan_cells"]
SQL["corner_sample_tiles"] = SQL["corner_sample"]
SQL["focal_count_sweep"] = with_grids(f"""SELECT tile_size, count(*) FILTER (WHERE trunc(m) = {V}) AS n
FROM (SELECT s.tile_size, nb.x, nb.y,
        CAST(sum(nb.qv) AS DOUBLE) / CAST(nullif(count(nb.qv), 0) AS DOUBLE) AS m
      FROM (SELECT p.x, p.y, q.x AS qx, q.y AS qy, q.v AS qv
            FROM a p JOIN a q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1) nb
      JOIN (VALUES {_SIZES}) s(tile_size)
        ON floor(nb.qx / s.tile_size) = floor(nb.x / s.tile_size)
       AND floor(nb.qy / s.tile_size) = floor(nb.y / s.tile_size)
      GROUP BY s.tile_size, nb.x, nb.y) t
GROUP BY tile_size""", "A")

SQL["zonal_statistics_float"] = _zonal("""SELECT 'zones' AS zone_set, k.zone_id, k.name, k.zid, coalesce(s.n, 0) AS n,
  s.min, s.max, round(s.mean, 6) AS mean, s.median, s.mode, round(s.stddev, 6) AS stddev
FROM zkeys k LEFT JOIN (
  SELECT zone_id, CAST(sum(n) AS BIGINT) AS n, min(v) AS min, max(v) AS max, sum(v * n) / sum(n) AS mean,
    arg_min(v, (-n, v)) AS mode, any_value(median) AS median, any_value(stddev) AS stddev
  FROM hist JOIN (SELECT zone_id, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS stddev
    FROM inside WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY zone_id) m USING (zone_id)
  WHERE NOT isnan(v) GROUP BY zone_id) s ON k.zone_id = s.zone_id""", grid="C")

SQL["zonal_histogram_shifted"] = SQL["zonal_histogram"].replace("FROM a c JOIN edges", "FROM (SELECT x - 50 AS x, y - 40 AS y, v FROM a) c JOIN edges")

# Zones by formula: cells of a two-box zone, each cell once.
_W = q.WIDE
SQL["zonal_histogram_many"] = f"""WITH g AS (SELECT o_orderkey % {_W} AS x, o_orderkey // {_W} AS y,
  CAST(nullif(floor(o_totalprice) % 22, 0) AS INTEGER) AS v FROM orders),
z AS (SELECT s_suppkey AS k, (s_suppkey * 37) % {_W - 60} AS x, (s_suppkey * 11) % 60 AS y, s_suppkey % 47 + 6 AS w, s_suppkey % 23 + 4 AS h FROM supplier)
SELECT 'suppliers' AS zone_set, CAST(k AS VARCHAR) AS zone_id, v, count(*) AS n FROM g JOIN z
  ON (g.x >= z.x AND g.x < z.x + w AND g.y >= z.y AND g.y < z.y + h)
  OR (g.x >= z.x + 2 AND g.x < z.x + w + 7 AND g.y >= z.y + 1 AND g.y < z.y + 1 + h)
WHERE v IS NOT NULL GROUP BY k, v"""
SQL["zonal_histogram_shuffle"] = SQL["zonal_histogram_many"]
SQL["zonal_histogram_tiles_shuffle"] = SQL["zonal_histogram_many"]

# Any numeric type: sums and ranks in 128-bit integers.
_WIDE = """SELECT 'zones' AS zone_set, k.zone_id, k.name, k.zid, coalesce(s.n, 0) AS n, {values},
  round(s.mean / 1e12, 6) AS mean, round(s.stddev / 1e12, 6) AS stddev, {median} AS median
FROM zkeys k LEFT JOIN (
  SELECT zone_id, CAST(sum(n) AS BIGINT) AS n, min(v) AS min, max(v) AS max, arg_min(v, (-n, v)) AS mode,
    CAST(sum(CAST(v AS HUGEINT) * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mean, any_value(stddev) AS stddev, any_value(median) AS median
  FROM hist JOIN (
    SELECT zone_id, stddev_pop(CAST(v AS DOUBLE)) AS stddev, CAST(max(CASE WHEN i = (c + 1) // 2 THEN CAST(v AS HUGEINT) END)
      + max(CASE WHEN i = c // 2 + 1 THEN CAST(v AS HUGEINT) END) AS DOUBLE) / 2 AS median
    FROM (SELECT zone_id, v, row_number() OVER (PARTITION BY zone_id ORDER BY v) AS i, count(*) OVER (PARTITION BY zone_id) AS c
          FROM inside WHERE v IS NOT NULL) r GROUP BY zone_id) m USING (zone_id)
  GROUP BY zone_id) s ON k.zone_id = s.zone_id"""
SQL["zonal_statistics_wide"] = _zonal(_WIDE.format(values="s.min, s.max, s.mode", median="s.median"), grid="W")
SQL["zonal_statistics_unsigned"] = _zonal(_WIDE.format(
    values=", ".join(f"CAST(s.{c} AS VARCHAR) AS {c}" for c in ("min", "max", "mode")), median="round(s.median / 1e12, 6)"), grid="U")
SQL["zonal_histogram_blocks"] = SQL["zonal_histogram"]
SQL["zonal_histogram_dense"] = f"""WITH g AS (SELECT event_id % {q.DENSE} AS x, event_id // {q.DENSE} AS y,
  CAST(nullif(floor(value) % 22, 0) AS INTEGER) AS v FROM events),
z AS (SELECT o_orderkey AS k, (o_orderkey * 37) % {q.DENSE - 30} AS x, (o_orderkey * 7) % {q.DENSE_ROWS} AS y,
  o_orderkey % 23 + 3 AS w, o_orderkey % 4 + 1 AS h FROM orders)
SELECT 'orders' AS zone_set, CAST(k AS VARCHAR) AS zone_id, v, count(*) AS n
FROM g JOIN z ON g.x >= z.x AND g.x < z.x + w AND g.y >= z.y AND g.y < z.y + h
WHERE v IS NOT NULL GROUP BY k, v"""
