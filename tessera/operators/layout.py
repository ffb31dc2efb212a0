"""Layout, tiling and window reports.

* layout keys of a floating N x N layout and per-tile cell counts,
* tile extents in map units, tile dimensions and sizes, their text forms,
* the window grid a chunked (or max-tile-size) raster read produces,
* tile counts.

Window grids are generated on the executors from the one-row metadata
aggregate (``sequence`` x ``sequence``), so nothing is looped on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as tf
from ..layer import Georef, Layer, TileLayer
from ..session import default_parallelism


def layer_metadata(layer: Layer, tile_size: int, facts: DataFrame | None = None) -> DataFrame:
    """Metadata of a layer from its data: bounds, size, layout, map extent. ``facts``
    of a stored layer (``footers.stored_metadata``) spare the scan."""
    g = layer.georef
    m = layer.metadata() if facts is None else facts
    cols = F.col("xmax") + 1
    rows = F.col("ymax") + 1
    return m.select(
        F.lit(layer.name).alias("raster"),
        "xmin", "xmax", "ymin", "ymax",
        cols.cast("int").alias("cols"), rows.cast("int").alias("rows"),
        "cells", "data_cells",
        F.lit(tile_size).alias("tile_size"),
        F.ceil(cols / F.lit(tile_size)).cast("int").alias("layout_cols"),
        F.ceil(rows / F.lit(tile_size)).cast("int").alias("layout_rows"),
        (F.lit(g.x0) + F.col("xmin") * F.lit(g.dx)).alias("ext_xmin"),
        (F.lit(g.y0) - rows * F.lit(g.dy)).alias("ext_ymin"),
        (F.lit(g.x0) + cols * F.lit(g.dx)).alias("ext_xmax"),
        (F.lit(g.y0) - F.col("ymin") * F.lit(g.dy)).alias("ext_ymax"),
        F.lit(g.srid).alias("srid"),
    )


def tile_layout(tl: TileLayer) -> DataFrame:
    """Per tile of the layout: cell count, data cells and an order checksum."""
    t = F.col("t")
    return tl.df.select(
        "tc", "tr",
        F.size(t).cast("bigint").alias("tile_cells"),
        tf.tile_count_valid(t).cast("bigint").alias("data_cells"),
        tf.tile_checksum(t).alias("checksum"),
    )


def tile_extent_cols(tc: Column, tr: Column, n: int, g: Georef) -> list[Column]:
    w = n * g.dx
    h = n * g.dy
    return [
        (F.lit(g.x0) + tc * F.lit(w)).alias("xmin"),
        (F.lit(g.y0) - (tr + 1) * F.lit(h)).alias("ymin"),
        (F.lit(g.x0) + (tc + 1) * F.lit(w)).alias("xmax"),
        (F.lit(g.y0) - tr * F.lit(h)).alias("ymax"),
    ]


def tile_extent(tl: TileLayer) -> DataFrame:
    """Map extent of every tile key of the layout."""
    return tl.keys().select("tc", "tr", *tile_extent_cols(F.col("tc"), F.col("tr"), tl.tile_size, tl.georef))


def tile_extent_size_text(tl: TileLayer) -> DataFrame:
    """``Extent(xmin,ymin,xmax,ymax),size`` per tile (one text line per tile);
    every tile holds n x n cells, so only the tile keys are read."""
    return extent_lines(tile_extent(tl), tl.tile_size)


def extent_lines(extents: DataFrame, n: int) -> DataFrame:
    """The text line of each tile of ``(tc, tr, xmin, ymin, xmax, ymax)``."""
    return extents.select("tc", "tr", F.concat(
        F.lit("Extent("), F.concat_ws(",", *[F.col(c).cast("string") for c in ("xmin", "ymin", "xmax", "ymax")]),
        F.lit(f"),{n * n}")).alias("line"))


def tile_dimensions(tl: TileLayer) -> DataFrame:
    """Dimensions (cols, rows), size in cells, and their text forms; from the
    tile keys alone."""
    n = tl.tile_size
    return tl.keys().select(
        "tc", "tr",
        F.lit(n).alias("cols"), F.lit(n).alias("rows"),
        F.lit(n * n).cast("bigint").alias("size"),
        F.lit(f"{n},{n}").alias("dims_text"),
        F.lit(str(n * n)).alias("size_text"),
    )


def windows(layer: Layer, size: int, mode: str = "chunk") -> DataFrame:
    """Window grid of a chunked read: windows of at most size x size, clipped
    to the raster. ``mode='max_tile'`` keeps a raster whose sides are both
    within ``size`` whole, which the clipped grid already does. The grid starts
    at cell (0, 0), or at the first cell where that is negative.
    """
    if mode not in ("chunk", "max_tile"):
        raise ValueError(f"unknown window mode {mode!r}")
    m = layer.metadata().select((F.col("xmax") - F.least("xmin", F.lit(0)) + 1).alias("cols"), (F.col("ymax") - F.least("ymin", F.lit(0)) + 1).alias("rows"),
                                F.least("xmin", F.lit(0)).alias("ox"), F.least("ymin", F.lit(0)).alias("oy"))
    s = F.lit(size)
    w = m.select("cols", "rows", "ox", "oy",
                 F.explode(F.sequence(F.lit(0), F.ceil(F.col("cols") / s).cast("int") - 1)).alias("wc"))
    # spread the window columns over tasks before the second explode, so no
    # single task generates the whole window grid of a large raster
    parts = max(1, default_parallelism(layer.df.sparkSession))
    w = w.repartition(parts, "wc")
    w = w.select("cols", "rows", "ox", "oy", "wc",
                 F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows") / s).cast("int") - 1)).alias("wr"))
    win_x = F.col("wc") * size
    win_y = F.col("wr") * size
    ww = F.least(s, F.col("cols") - win_x)
    wh = F.least(s, F.col("rows") - win_y)
    return w.select(
        F.lit(layer.name).alias("raster"),
        (win_x + F.col("ox")).cast("int").alias("win_x"), (win_y + F.col("oy")).cast("int").alias("win_y"),
        ww.cast("int").alias("cols"), wh.cast("int").alias("rows"),
        (ww * wh).cast("bigint").alias("size"),
        F.concat_ws(",", ww.cast("string"), wh.cast("string")).alias("dims_text"),
        (ww * wh).cast("string").alias("size_text"),
    )


def count_tiles(layer: Layer, n: int) -> DataFrame:
    """Number of tiles of the layout that hold at least one cell."""
    k = layer.df.select(tf.tile_col(F.col("x"), n).alias("tc"), tf.tile_col(F.col("y"), n).alias("tr"))
    return k.distinct().agg(F.count(F.lit(1)).alias("n_tiles"))
