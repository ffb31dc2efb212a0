"""Sinks: text lines per tile, CSV result tables, console display.

All writers are distributed DataFrame writes (one file per partition, written
by the executors); nothing is gathered on the driver.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .layer import Layer, TileLayer
from .operators import layout


def write_text(df: DataFrame, path: str, column: str | None = None, mode: str = "overwrite") -> None:
    """One text line per row; ``column`` names the string column (default:
    the only column)."""
    col = column or df.columns[0]
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    """Result rows as CSV with a header and the DataFrame's fixed schema."""
    df.write.mode(mode).option("header", header).csv(path)


def tile_reports(layer: Layer, tiles: TileLayer, window_size: int) -> dict[str, DataFrame]:
    """The five tiling reports as line DataFrames (one ``line`` column):

    * ``layout_extent_size``: ``Extent(...),size`` per layout tile,
    * ``chunk_dims`` / ``chunk_size``: ``cols,rows`` and cell count per window
      of a chunked read,
    * ``max_tile_dims`` / ``max_tile_size``: the same for a max-tile-size read.
    """
    chunk = layout.windows(layer, window_size, "chunk")
    maxt = layout.windows(layer, window_size, "max_tile")
    return {
        "layout_extent_size": layout.tile_extent_size_text(tiles).select("line"),
        "chunk_dims": chunk.select(F.col("dims_text").alias("line")),
        "chunk_size": chunk.select(F.col("size_text").alias("line")),
        "max_tile_dims": maxt.select(F.col("dims_text").alias("line")),
        "max_tile_size": maxt.select(F.col("size_text").alias("line")),
    }


def write_tile_reports(layer: Layer, tiles: TileLayer, window_size: int, base: str) -> dict[str, int]:
    """Write the five reports under ``base/<name>`` and return line counts."""
    counts = {}
    for name, df in tile_reports(layer, tiles, window_size).items():
        counts[name] = write_counted(df, f"{base}/{name}")
    return counts


def write_counted(df: DataFrame, path: str) -> int:
    """Write text lines and return their number, counted by the write itself."""
    seen = Observation()
    write_text(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def show(df: DataFrame, n: int = 20) -> None:
    """Print the first rows (display only)."""
    df.show(n, truncate=False)


def save_tiles(tl: TileLayer, table: str, buckets: int, path: str | None = None,
               mode: str = "overwrite", histograms: bool = False) -> None:
    """Store a tile layer as a table bucketed and sorted on the tile key.

    Two rasters saved with the same layout and bucket count join on
    ``(tc, tr)`` without any exchange (co-located buckets), which is what a
    tile-wise add of two stored rasters needs at scale. ``histograms`` also stores
    each tile's histogram, as the table ``<table>_blocks``, for zonal queries.
    """
    _save_bucketed(tl.df.select("tc", "tr", "t"), table, buckets, path, mode)
    if histograms:
        from .operators.zonal import tile_histograms
        stored = TileLayer(tl.df.sparkSession.table(table), tl.tile_size)
        _save_bucketed(tile_histograms(stored), f"{table}_blocks", buckets, f"{path}_blocks" if path else None, mode)


def _save_bucketed(df: DataFrame, table: str, buckets: int, path: str | None, mode: str) -> None:
    w = df.write.mode(mode).bucketBy(buckets, "tc", "tr").sortBy("tc", "tr")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def load_tiles(spark, table: str, tile_size: int, name: str | None = None, georef=None, extent=None) -> TileLayer:
    """Read a tile table written by ``save_tiles`` (bucketing is kept); ``extent`` is
    the raster's (xmin, xmax, ymin, ymax), needed to tell padding from NoData. The
    tiles' histograms come along where they are stored."""
    from .layer import Georef
    blocks = spark.table(f"{table}_blocks") if spark.catalog.tableExists(f"{table}_blocks") else None
    return TileLayer(spark.table(table), tile_size, name or table, georef or Georef(), extent, blocks=blocks)


def save_cells(layer: Layer, path: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Store a cell table range-partitioned and sorted by (y, x).

    Each file then covers a band of rows and each parquet row group a narrow
    y range, so filters on y (a zonal query's bounding box, a window) skip
    files and row groups from their min/max statistics. The georeference is
    kept in the metadata of the column v.
    """
    df = layer.df.select("x", "y", F.col("v").alias("v", metadata={"georef": asdict(layer.georef)}))
    if partitions:
        df = df.repartitionByRange(partitions, "y", "x")
    else:
        df = df.repartitionByRange("y", "x")
    df.sortWithinPartitions("y", "x").write.mode(mode).parquet(path)
