"""Registered queries: one per operator of the inventory.

Every query takes ``(spark, sf_dir)``, reads the driver's tables (through the
fixture grids of ``tessera.sources.grids``) and returns a DataFrame; it never
collects. ``tessera.plans.oracle`` holds the matching DuckDB SQL.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..layer import Georef, Layer
from ..operators import focal, layout, local, sweep, zonal
from ..session import ensure_checkpoint_dir
from ..sources.footers import stored_metadata
from ..sources.geojson import ZoneSet, read_zones
from ..sources.grids import GEOREF_A, grid_a, grid_b, grid_c, grid_unsigned, grid_wide

# The class value searched for and its replacement (the glc
# dataset of the reference: pixel value 16, new value 1), the tile size of the
# reference's local benchmarks, and the window sizes of our fixtures.
VALUE = 16
NEW_VALUE = 1
TILE = 25
CHUNK = 40
MAX_TILE = 120
# Tiles small enough for some to lie wholly in the fixture zones.
BLOCK = 8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


EXTENT = ("xmin", "ymin", "xmax", "ymax")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Map coordinates to 9 places, so that both engines' last bits agree."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


# ------------------------------------------------------------ scan, layout

@query("scan_cells")
def scan_cells(spark, sf):
    return grid_a(spark, sf).df


@query("layer_metadata")
def layer_metadata(spark, sf):
    return _rounded(_union([layout.layer_metadata(g(spark, sf), TILE) for g in (grid_a, grid_b, grid_c)]),
                    "ext_xmin", "ext_ymin", "ext_xmax", "ext_ymax")


@query("layer_metadata_stored")
def layer_metadata_stored(spark, sf):
    """The grids stored as cell tables in the shared folder, told from their footers."""
    folder = f"{ensure_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    found = []
    for g in (grid_a, grid_b, grid_c):
        layer = g(spark, sf)
        sinks.save_cells(layer, f"{folder}/{layer.name}")
        found.append(layout.layer_metadata(layer, TILE, stored_metadata(spark, f"{folder}/{layer.name}")))
    return _rounded(_union(found), "ext_xmin", "ext_ymin", "ext_xmax", "ext_ymax")


@query("tile_layout")
def tile_layout(spark, sf):
    return layout.tile_layout(grid_a(spark, sf).to_tiles(TILE))


@query("tile_extent")
def tile_extent(spark, sf):
    return _rounded(layout.tile_extent(grid_a(spark, sf).to_tiles(TILE)), *EXTENT)


@query("tile_extent_text")
def tile_extent_text(spark, sf):
    return layout.extent_lines(_rounded(layout.tile_extent(grid_a(spark, sf).to_tiles(TILE)), *EXTENT), TILE)


@query("tile_dimensions")
def tile_dimensions(spark, sf):
    return layout.tile_dimensions(grid_a(spark, sf).to_tiles(TILE))


@query("chunk_windows")
def chunk_windows(spark, sf):
    return layout.windows(grid_a(spark, sf), CHUNK, "chunk")


@query("max_tile_windows")
def max_tile_windows(spark, sf):
    return _union([layout.windows(g(spark, sf), MAX_TILE, "max_tile") for g in (grid_a, grid_b, grid_c)])


@query("count_tiles")
def count_tiles(spark, sf):
    return _union([layout.count_tiles(g(spark, sf), TILE).select(F.lit(n).alias("raster"), "n_tiles")
                   for n, g in (("A", grid_a), ("B", grid_b), ("C", grid_c))])


# ------------------------------------------------------------ local

@query("count_value")
def count_value(spark, sf):
    return local.count_value(grid_a(spark, sf), VALUE)


@query("count_value_tiles")
def count_value_tiles(spark, sf):
    return local.count_value_tiles(grid_a(spark, sf).to_tiles(TILE), VALUE)


@query("count_value_by_tile")
def count_value_by_tile(spark, sf):
    return local.count_value_by_tile(grid_a(spark, sf), VALUE, TILE)


@query("count_value_by_tile_tiles")
def count_value_by_tile_tiles(spark, sf):
    return local.count_value_by_tile_tiles(grid_a(spark, sf).to_tiles(TILE), VALUE)


@query("reclassify")
def reclassify(spark, sf):
    return local.reclassify(grid_a(spark, sf), VALUE, NEW_VALUE).df


@query("reclassify_count")
def reclassify_count(spark, sf):
    return local.reclassify_count(grid_a(spark, sf), VALUE, NEW_VALUE)


@query("reclassify_count_tiles")
def reclassify_count_tiles(spark, sf):
    a = grid_a(spark, sf)
    return local.reclassify_count_tiles(a.to_tiles(TILE), a.meta(), VALUE, NEW_VALUE)


@query("reclassify_roundtrip")
def reclassify_roundtrip(spark, sf):
    r = local.reclassify(local.reclassify(grid_a(spark, sf), VALUE, NEW_VALUE), NEW_VALUE, VALUE)
    return r.df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("raster_add")
def raster_add(spark, sf):
    return local.add(grid_a(spark, sf), grid_b(spark, sf)).df


@query("raster_add_count")
def raster_add_count(spark, sf):
    return local.count_value(local.add(grid_a(spark, sf), grid_b(spark, sf)), 2 * VALUE)


@query("raster_add_count_tiles")
def raster_add_count_tiles(spark, sf):
    s = local.add_tiles(grid_a(spark, sf).to_tiles(TILE), grid_b(spark, sf).to_tiles(TILE))
    return local.count_value_tiles(s, 2 * VALUE)


@query("raster_self_add_count")
def raster_self_add_count(spark, sf):
    a = grid_a(spark, sf)
    return local.count_value(local.add(a, a), 2 * VALUE)


@query("raster_add_n")
def raster_add_n(spark, sf):
    return local.add_n([grid_a(spark, sf), grid_b(spark, sf), grid_a(spark, sf)]).df


@query("raster_add_n_tiles")
def raster_add_n_tiles(spark, sf):
    a, b = grid_a(spark, sf), grid_b(spark, sf)
    s = local.add_n_tiles([a.to_tiles(TILE), b.to_tiles(TILE), a.to_tiles(TILE)])
    return s.to_cells().df


@query("raster_add_offset")
def raster_add_offset(spark, sf):
    """Grid B laid 25 cells right and down of grid A's origin."""
    b = grid_b(spark, sf)
    g = b.georef
    moved = Georef(g.x0 + 25 * g.dx, g.y0 - 25 * g.dy, g.dx, g.dy, g.srid)
    return local.add(grid_a(spark, sf), Layer(b.df, b.name, moved)).df


@query("raster_add_mixed")
def raster_add_mixed(spark, sf):
    """Integer classes plus floating-point values."""
    return local.add_n([grid_a(spark, sf), grid_c(spark, sf)]).df


@query("tiles_round_trip")
def tiles_round_trip(spark, sf):
    """Every cell of grid A, NoData included, through the tile form and back."""
    return grid_a(spark, sf).to_tiles(TILE).to_cells().df


# ------------------------------------------------------------ focal

# Block size of the seamless (halo) plan; a partitioning device only, chosen
# unlike the tile size so the halo exchange is exercised at test scale.
HALO_BLOCK = 32
RADIUS = 50


@query("focal_mean_tile")
def focal_mean_tile(spark, sf):
    return focal.focal_mean(grid_a(spark, sf), 1, "tile", tile_size=TILE).df


@query("focal_mean_halo")
def focal_mean_halo(spark, sf):
    return focal.focal_mean(grid_a(spark, sf), 1, "halo", block=HALO_BLOCK).df


@query("focal_mean_radius")
def focal_mean_radius(spark, sf):
    """A radius of 50: half of the grid's width."""
    return focal.focal_mean(grid_a(spark, sf), RADIUS, "halo").df


@query("focal_mean_count")
def focal_mean_count(spark, sf):
    return focal.count_truncated(focal.focal_mean(grid_a(spark, sf), 1, "tile", tile_size=TILE), VALUE)


@query("focal_mean_count_halo")
def focal_mean_count_halo(spark, sf):
    return focal.count_truncated(focal.focal_mean(grid_a(spark, sf), 1, "halo", block=HALO_BLOCK), VALUE)


@query("focal_mean_count_tiles")
def focal_mean_count_tiles(spark, sf):
    a = grid_a(spark, sf)
    return focal.count_truncated_tiles(focal.focal_mean_tiles(a.to_tiles(TILE), a.meta(), 1), VALUE)


@query("focal_mean_tiles")
def focal_mean_tiles(spark, sf):
    a = grid_a(spark, sf)
    return focal.focal_mean_tiles(a.to_tiles(TILE), a.meta(), 1).to_cells().df


@query("focal_mean_tiles_halo")
def focal_mean_tiles_halo(spark, sf):
    a = grid_a(spark, sf)
    return focal.focal_mean_tiles_halo(a.to_tiles(TILE), a.meta(), 1).to_cells().df


@query("focal_mean_count_tiles_halo")
def focal_mean_count_tiles_halo(spark, sf):
    a = grid_a(spark, sf)
    return focal.count_truncated_tiles(focal.focal_mean_tiles_halo(a.to_tiles(TILE), a.meta(), 1), VALUE)


@query("focal_count_sweep")
def focal_count_sweep(spark, sf):
    return focal.focal_count_sweep(grid_a(spark, sf), VALUE, sweep.REFERENCE_TILE_SIZES, 1, block=HALO_BLOCK)


@query("corner_sample_tiles")
def corner_sample_tiles(spark, sf):
    a = grid_a(spark, sf)
    return focal.corner_sample_tiles(focal.focal_mean_tiles(a.to_tiles(TILE), a.meta(), 1), 5)


@query("corner_sample")
def corner_sample(spark, sf):
    return focal.corner_sample(focal.focal_mean(grid_a(spark, sf), 1, "tile", tile_size=TILE), TILE, 5)


# ------------------------------------------------------------ zonal

ZONES_PATH = os.path.join(os.path.dirname(os.path.abspath(__file__)), "zones.geojson")


def fixture_zones(spark) -> ZoneSet:
    """The zone fixture; coordinates are in grid A's cell units."""
    return read_zones(spark, ZONES_PATH, "zones", srid=GEOREF_A.srid)


def zonal_grid(spark, sf) -> Layer:
    """Grid A georeferenced in cell units (the zones' coordinate system)."""
    a = grid_a(spark, sf)
    return Layer(a.df, a.name, Georef.pixel(GEOREF_A.srid))


@query("zonal_histogram")
def zonal_histogram(spark, sf):
    return zonal.histogram(zonal_grid(spark, sf), fixture_zones(spark))


@query("zonal_statistics")
def zonal_statistics(spark, sf):
    return zonal.statistics(zonal_grid(spark, sf), fixture_zones(spark))


@query("zonal_statistics_polygons")
def zonal_statistics_polygons(spark, sf):
    return zonal.statistics(zonal_grid(spark, sf), fixture_zones(spark).polygons())


@query("zonal_statistics_multipolygons")
def zonal_statistics_multipolygons(spark, sf):
    return zonal.statistics(zonal_grid(spark, sf), fixture_zones(spark).multipolygons())


@query("zonal_min_max_mean")
def zonal_min_max_mean(spark, sf):
    return zonal.min_max_mean(zonal_grid(spark, sf), fixture_zones(spark))


@query("zonal_histogram_tiles")
def zonal_histogram_tiles(spark, sf):
    return zonal.histogram_tiles(zonal_grid(spark, sf).to_tiles(TILE), fixture_zones(spark))


@query("zonal_statistics_tiles")
def zonal_statistics_tiles(spark, sf):
    return zonal.statistics_tiles(zonal_grid(spark, sf).to_tiles(TILE), fixture_zones(spark))


@query("zonal_min_max_mean_float")
def zonal_min_max_mean_float(spark, sf):
    c = grid_c(spark, sf)
    st = zonal.min_max_mean(Layer(c.df, c.name, Georef.pixel(GEOREF_A.srid)), fixture_zones(spark))
    return st.withColumn("mean", F.round("mean", 6))


@query("zonal_statistics_float")
def zonal_statistics_float(spark, sf):
    """All columns over a floating-point raster; sums depend on their order, so
    mean and stddev are compared to 6 places."""
    c = grid_c(spark, sf)
    st = zonal.statistics(Layer(c.df, c.name, Georef.pixel(GEOREF_A.srid)), fixture_zones(spark))
    return st.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


UNIT = 1e12


def _in_units(df: DataFrame, *columns: str) -> DataFrame:
    """Columns in units of 10^12, to 6 places: 18 digits and more differ in their
    last bits from engine to engine."""
    return df.withColumns({c: F.round(F.col(c) / UNIT, 6) for c in columns})


@query("zonal_statistics_wide")
def zonal_statistics_wide(spark, sf):
    """64-bit integers beyond 2^53 of either sign; the median as it is."""
    st = zonal.statistics(Layer(grid_wide(spark, sf).df, "wide", Georef.pixel(GEOREF_A.srid)), fixture_zones(spark))
    return _in_units(st, "mean", "stddev")


@query("zonal_statistics_unsigned")
def zonal_statistics_unsigned(spark, sf):
    """Unsigned 64-bit integers beyond 2^63, held as decimals; exact values as text."""
    st = zonal.statistics(Layer(grid_unsigned(spark, sf).df, "unsigned", Georef.pixel(GEOREF_A.srid)), fixture_zones(spark))
    st = st.withColumns({c: F.col(c).cast("string") for c in ("min", "max", "mode")})
    return _in_units(st, "mean", "median", "stddev")


@query("zonal_histogram_shifted")
def zonal_histogram_shifted(spark, sf):
    """Grid A moved by (-50, -40): columns and rows below zero count like others."""
    a = zonal_grid(spark, sf)
    moved = a.df.select((F.col("x") - 50).alias("x"), (F.col("y") - 40).alias("y"), "v")
    return zonal.histogram(Layer(moved, a.name, a.georef), fixture_zones(spark))


# Zones that grow with the data: a two-part zone per supplier, by formula.
# The parts overlap, and cells in both belong to the zone once.
WIDE = 4000


def table_zones(spark, sf) -> ZoneSet:
    k = F.col("s_suppkey")

    def box(x, y, w, h):
        x, y, w, h = (c.cast("double") for c in (x, y, w, h))
        corner = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        return F.array(F.array(*[F.array(p, q) for p, q in corner]))

    x, y, w, h = (k * 37) % (WIDE - 60), (k * 11) % 60, k % 47 + 6, k % 23 + 4
    zones = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.lit("suppliers").alias("zone_set"), k.cast("string").alias("zone_id"), F.col("s_name").alias("name"),
        k.cast("int").alias("zid"), F.lit("MultiPolygon").alias("geom_type"),
        F.array(box(x, y, w, h), box(x + 2, y + 1, w + 5, h)).alias("geom"))
    zones = zones.withColumn("zk", F.xxhash64("zone_set", "zone_id"))
    return ZoneSet(zones, "suppliers", GEOREF_A.srid)


def wide_grid(spark, sf) -> Layer:
    """Order classes on rows of WIDE cells (more than one x-bin of the zone join)."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    cells = o.select((F.col("o_orderkey") % WIDE).cast("int").alias("x"), F.floor(F.col("o_orderkey") / WIDE).cast("int").alias("y"),
                     F.nullif(F.floor("o_totalprice") % 22, F.lit(0)).cast("int").alias("v"))
    return Layer(cells, "wide", Georef.pixel(GEOREF_A.srid))


@query("zonal_histogram_many")
def zonal_histogram_many(spark, sf):
    return zonal.histogram(wide_grid(spark, sf), table_zones(spark, sf))


@query("zonal_histogram_shuffle")
def zonal_histogram_shuffle(spark, sf):
    """The plan beyond the broadcast bound: both sides dealt by (row, bin)."""
    return zonal.histogram(wide_grid(spark, sf), table_zones(spark, sf), broadcast_max_runs=0)


@query("zonal_histogram_tiles_shuffle")
def zonal_histogram_tiles_shuffle(spark, sf):
    return zonal.histogram_tiles(wide_grid(spark, sf).to_tiles(TILE), table_zones(spark, sf), broadcast_max_runs=0)


@query("zonal_cells")
def zonal_cells(spark, sf):
    return zonal.zone_cells(zonal_grid(spark, sf), fixture_zones(spark))


@query("zonal_histogram_blocks")
def zonal_histogram_blocks(spark, sf):
    """Tiles inside a zone answered from their histograms, border tiles read."""
    tiles = zonal_grid(spark, sf).to_tiles(BLOCK)
    return zonal.histogram_tiles(replace(tiles, blocks=zonal.tile_histograms(tiles)), fixture_zones(spark))


# A small zone per order, all in the first DENSE columns: thousands share an x-bin.
DENSE = 1000
DENSE_ROWS = 60


def dense_zones(spark, sf) -> ZoneSet:
    k = F.col("o_orderkey")
    x, y, w, h = ((k * 37) % (DENSE - 30)).cast("double"), ((k * 7) % DENSE_ROWS).cast("double"), k % 23 + 3, k % 4 + 1
    corner = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    zones = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.lit("orders").alias("zone_set"), k.cast("string").alias("zone_id"), k.cast("string").alias("name"),
        (k % 1000).cast("int").alias("zid"), F.lit("Polygon").alias("geom_type"),
        F.array(F.array(F.array(*[F.array(p, q) for p, q in corner]))).alias("geom"))
    return ZoneSet(zones.withColumn("zk", F.xxhash64("zone_set", "zone_id")), "orders", GEOREF_A.srid)


def dense_grid(spark, sf) -> Layer:
    """Event classes on rows of DENSE cells."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    cells = e.select((F.col("event_id") % DENSE).cast("int").alias("x"), F.floor(F.col("event_id") / DENSE).cast("int").alias("y"),
                     F.nullif(F.floor("value") % 22, F.lit(0)).cast("int").alias("v"))
    return Layer(cells, "dense", Georef.pixel(GEOREF_A.srid))


@query("zonal_histogram_dense")
def zonal_histogram_dense(spark, sf):
    """Many small zones in one bin: cells meet only runs of their own width class."""
    return zonal.histogram(dense_grid(spark, sf), dense_zones(spark, sf))


# ------------------------------------------------------------ sweep

@query("tile_size_sweep")
def tile_size_sweep(spark, sf):
    return sweep.tile_size_sweep(grid_a(spark, sf), VALUE)
