"""Catalog-driven jobs: the reference's six programs as Spark plans.

Each job takes catalog records (``RasterRecord`` / ``VectorRecord``) and
returns result DataFrames (or writes reports); loops over datasets only build
plans (a union), so every job is one Spark plan over all its inputs. Timing
runs of the reference are left to ``bench.py``.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import tiles as tf
from ..layer import Georef, Layer
from ..operators import focal, layout, local, sweep, zonal
from ..sources.catalog import RasterRecord, VectorRecord, vector_path
from ..sources.geojson import ZoneSet, read_zones
from ..sources.geotiff import read_geotiff
from ..sources.grids import read_cells, stored_georef


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def _is_tiff(path: str) -> bool:
    return path.lower().rstrip("/").endswith((".tif", ".tiff"))


def load_raster(spark: SparkSession, rec: RasterRecord, **kw) -> Layer:
    """A catalog raster as a cell layer: GeoTIFF (windowed scan) or a parquet
    cell table. The catalog srid is authoritative (it picks the vector copy)."""
    if _is_tiff(rec.path):
        lay = read_geotiff(spark, rec.path, rec.name, **kw)
        g = lay.georef
        return Layer(lay.df, rec.name, Georef(g.x0, g.y0, g.dx, g.dy, rec.srid), lay.known_dims)
    lay = read_cells(spark, rec.path, rec.name)
    g = stored_georef(spark.read.parquet(rec.path))
    return Layer(lay.df, rec.name, replace(g or Georef(), srid=rec.srid), placed=g is not None)


def count_pixels_job(spark, rasters: list[RasterRecord],
                     tile_sizes=sweep.REFERENCE_TILE_SIZES) -> DataFrame:
    """Cells equal to each raster's pixel value, for every tile size."""
    return _union([sweep.tile_size_sweep(load_raster(spark, r), r.pixel_value, tile_sizes)
                   .select(F.lit(r.name).alias("dataset"), "*") for r in rasters])


def reclassify_job(spark, rasters: list[RasterRecord]) -> DataFrame:
    """Reclassify pixel_value -> new_pixel (else -999) and back again; counts
    of the new value after the first pass and of pixel_value after the
    second. Both passes are projections of one scan, counted in one aggregate."""
    out = []
    for r in rasters:
        lay = load_raster(spark, r)
        v1 = tf.reclass_expr(F.col("v"), r.pixel_value, r.new_pixel)
        v2 = tf.reclass_expr(v1, r.new_pixel, r.pixel_value)
        out.append(lay.df.agg(F.count(F.when(v1 == r.new_pixel, 1)).alias("n_new"),
                              F.count(F.when(v2 == r.pixel_value, 1)).alias("n_back"))
                   .select(F.lit(r.name).alias("dataset"), "n_new", "n_back"))
    return _union(out)


def raster_add_job(spark, rasters: list[RasterRecord]) -> DataFrame:
    """Each raster added to itself; cells equal to twice the pixel value."""
    out = []
    for r in rasters:
        lay = load_raster(spark, r)
        out.append(local.count_value(local.add(lay, lay), 2 * r.pixel_value)
                   .select(F.lit(r.name).alias("dataset"), "n"))
    return _union(out)


def focal_job(spark, rasters: list[RasterRecord], tile_sizes=sweep.REFERENCE_TILE_SIZES,
              edge: str = "tile", radius: int = 1) -> DataFrame:
    """3x3 focal mean per tile size, then cells whose truncated mean equals
    the pixel value. With ``edge='tile'`` the answer depends on the tile size;
    all sizes of a raster come from one exchange (``focal_count_sweep``)."""
    out = []
    for r in rasters:
        lay = load_raster(spark, r)
        if edge == "tile":
            c = focal.focal_count_sweep(lay, r.pixel_value, tile_sizes, radius)
        else:
            m = focal.focal_mean(lay, radius, edge)
            c = focal.count_truncated(m, r.pixel_value).select(F.lit(None).cast("int").alias("tile_size"), "n")
        out.append(c.select(F.lit(r.name).alias("dataset"), F.col("tile_size").cast("int").alias("tile_size"), "n"))
    return _union(out)


def load_zones(spark, vectors: list[VectorRecord], raster: RasterRecord, lines: bool = False) -> ZoneSet:
    """All vector sets for one raster, each from its copy for the raster's
    srid (``base/<srid>/file``), as one zone table."""
    sets = [read_zones(spark, vector_path(v, raster), v.name, srid=raster.srid, lines=lines) for v in vectors]
    known = all(z.max_zones is not None and z.max_bytes is not None for z in sets)
    bound = (sum(z.max_zones for z in sets), sum(z.max_bytes for z in sets)) if known else (None, None)
    return ZoneSet(_union([z.df for z in sets]), "+".join(v.name for v in vectors), raster.srid, *bound)


def zonal_job(spark, rasters: list[RasterRecord], vectors: list[VectorRecord], lines: bool = False) -> DataFrame:
    """Statistics of every raster over every feature of every vector set; ``lines``:
    the vector files hold one Feature per line (they split across tasks)."""
    out = []
    for r in rasters:
        lay = load_raster(spark, r)
        if not lay.placed:
            raise ValueError(f"{r.path}: the cell table has no georeference, so zones can't be laid over it; write it with sinks.save_cells")
        st = zonal.statistics(lay, load_zones(spark, vectors, r, lines))
        out.append(st.select(F.lit(r.name).alias("dataset"), "*"))
    return _union(out)


def tiling_report_job(spark, raster: RasterRecord, out_dir: str, tile_size: int = 300) -> dict[str, int]:
    """The three tilings of a raster (layout, chunked read, max-tile-size read)
    written as text reports; returns the tile/window counts."""
    lay = load_raster(spark, raster)
    tiles = lay.to_tiles(tile_size)
    reports = {"layout_extent_size": layout.tile_extent_size_text(tiles).select("line")}
    if _is_tiff(raster.path):
        for mode in ("chunk", "max_tile"):
            w = read_geotiff(spark, raster.path, form="grid", **{mode: tile_size})
            dims = F.concat_ws(",", F.col("cols").cast("string"), F.col("rows").cast("string"))
            reports[f"{mode}_dims"] = w.select(dims.alias("line"))
            reports[f"{mode}_size"] = w.select((F.col("cols") * F.col("rows")).cast("string").alias("line"))
    else:
        for mode in ("chunk", "max_tile"):
            w = layout.windows(lay, tile_size, mode)
            reports[f"{mode}_dims"] = w.select(F.col("dims_text").alias("line"))
            reports[f"{mode}_size"] = w.select(F.col("size_text").alias("line"))
    counts = {}
    for name, df in reports.items():
        counts[name] = sinks.write_counted(df, f"{out_dir}/{name}")
    return counts
