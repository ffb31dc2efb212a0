"""Column expressions on cells and tile arrays (all JVM-side built-ins).

Tile arrays are row-major: in-tile index ``i = (y mod n) * n + (x mod n)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# NoData stand-in written by the reclassify operator for cells that fail the
# predicate (a plain value, not NoData).
RECLASS_OTHER = -999


def tile_col(x: Column, n: int) -> Column:
    """Layout column (or row) of a cell coordinate: floor(x / n)."""
    return F.floor(x / F.lit(n)).cast("int")


def tile_index(x: Column, y: Column, n: int) -> Column:
    """Row-major index of a cell inside its n x n tile."""
    return (F.pmod(y, F.lit(n)) * n + F.pmod(x, F.lit(n))).cast("int")


def tile_count_eq(t: Column, a) -> Column:
    """Number of cells of a tile equal to ``a`` (NULLs never match)."""
    return F.size(F.filter(t, lambda v: v == F.lit(a)))


def tile_count_valid(t: Column) -> Column:
    return F.size(F.filter(t, lambda v: v.isNotNull()))


def reclass_expr(v: Column, old, new, other=RECLASS_OTHER, keep_nodata: bool = False) -> Column:
    """``if v == old then new else other``; NoData goes to ``other`` unless kept."""
    e = F.when(v == F.lit(old), F.lit(new)).otherwise(F.lit(other))
    if keep_nodata:
        e = F.when(v.isNull(), F.lit(None)).otherwise(e)
    return e


def tile_inside_cells(tc: Column, tr: Column, n: int, bounds) -> Column:
    """Number of cells of tile (tc, tr) inside the raster bounds."""
    xmin, xmax, ymin, ymax = bounds
    w = F.least(F.lit(xmax), tc * n + (n - 1)) - F.greatest(F.lit(xmin), tc * n) + 1
    h = F.least(F.lit(ymax), tr * n + (n - 1)) - F.greatest(F.lit(ymin), tr * n) + 1
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def tile_reclass(t: Column, tc: Column, tr: Column, n: int, bounds,
                 old, new, other=RECLASS_OTHER, keep_nodata: bool = False) -> Column:
    """Reclassify every cell of a tile; padding outside the raster stays NULL.
    Tiles wholly inside the raster (nearly all) skip the per-cell mask."""
    xmin, xmax, ymin, ymax = bounds

    def masked(v, i):
        gx, gy = tc * n + i % n, tr * n + F.floor(i / n)
        outside = (gx < xmin) | (gx > xmax) | (gy < ymin) | (gy > ymax)
        return F.when(outside, F.lit(None)).otherwise(reclass_expr(v, old, new, other, keep_nodata))

    whole = tile_inside_cells(tc, tr, n, bounds) == n * n
    return F.when(whole, F.transform(t, lambda v: reclass_expr(v, old, new, other, keep_nodata))) \
        .otherwise(F.transform(t, masked))


def tile_add(ta: Column, tb: Column) -> Column:
    """Cell-wise sum of two aligned tiles; NoData on either side gives NoData."""
    return F.zip_with(ta, tb, lambda p, q: p + q)


def tile_checksum(t: Column) -> Column:
    """sum((i+1) * v) over the cells of a tile: verifies cell order."""
    return F.aggregate(
        F.transform(t, lambda v, i: F.coalesce((i + 1).cast("bigint") * v.cast("bigint"), F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda acc, z: acc + z)
