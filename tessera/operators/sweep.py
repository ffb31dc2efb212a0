"""Tile-size sweep: one job for a whole list of layout tile sizes.

Instead of re-reading the raster once per tile size, cells are aggregated
once to the layout of the greatest common divisor of all sizes (every layout
in the sweep is a coarsening of it), and only that small per-tile table is
fanned out over the sizes. The raster is scanned and shuffled once.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layer import Layer

# The tile sizes swept by the reference's focal and zonal
# benchmarks.
REFERENCE_TILE_SIZES = (25, 50, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000)


def tile_size_sweep(layer: Layer, value, sizes=REFERENCE_TILE_SIZES) -> DataFrame:
    """Per tile size: tiles of the layout, cells equal to ``value``, data cells.

    The value count does not depend on the tile size (an invariant the tests
    check); tile counts do.
    """
    sizes = sorted({int(s) for s in sizes})
    if not sizes or sizes[0] <= 0:
        raise ValueError("tile sizes must be positive")
    g = reduce(gcd, sizes)
    base = layer.df.groupBy(
        F.floor(F.col("x") / g).cast("int").alias("bc"), F.floor(F.col("y") / g).cast("int").alias("br")
    ).agg(F.count(F.when(F.col("v") == F.lit(value), 1)).alias("nv"),
          F.count("v").alias("nd"))
    fan = base.select("bc", "br", "nv", "nd",
                      F.explode(F.array(*[F.lit(s) for s in sizes])).alias("tile_size"))
    k = F.col("tile_size") / F.lit(g)
    per_tile = fan.groupBy("tile_size", F.floor(F.col("bc") / k).alias("tc"), F.floor(F.col("br") / k).alias("tr")) \
        .agg(F.sum("nv").alias("nv"), F.sum("nd").alias("nd"))
    return per_tile.groupBy("tile_size").agg(
        F.count(F.lit(1)).alias("n_tiles"),
        F.sum("nv").cast("bigint").alias("n_value"),
        F.sum("nd").cast("bigint").alias("data_cells"),
    )


def parse_sizes(text: str | None) -> tuple[int, ...]:
    """``"25,50,100"`` -> (25, 50, 100); empty -> the reference's sweep."""
    if not text:
        return REFERENCE_TILE_SIZES
    sizes = tuple(int(s) for s in text.split(",") if s.strip())
    if not sizes or min(sizes) <= 0:
        raise ValueError(f"invalid tile sizes: {text!r}")
    return sizes
