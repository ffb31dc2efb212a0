"""Polygon geometry as column expressions: edges and scanline crossings.

Cell ownership rule (fixed for the whole engine): a cell (x, y) belongs to a
polygon when its centre (x + .5, y + .5) is inside by the even-odd rule with
half-open edges, i.e. an edge (x1,y1)-(x2,y2) counts for the centre when

    (y1 > yc) <> (y2 > yc)   and   xc >= x1 + (yc - y1) * (x2 - x1) / (y2 - y1)

The holes of a polygon feed the same parity count. A MultiPolygon holds what any
of its parts holds: parity is counted per part and the parts' runs are merged,
so overlapping parts never cancel each other.

Scanline form of the same rule: for raster row y, the crossings of all edges
of a zone with the line yc = y + .5, sorted, pair up into runs [c1, c2),
[c3, c4), ...; cell x is inside when c_odd <= x + .5 < c_even, i.e.
``ceil(c_odd - .5) <= x <= ceil(c_even - .5) - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF = 0.5


def closed(ring: Column) -> Column:
    """Append the first vertex when a ring is not closed."""
    return F.when(ring[0] == ring[F.size(ring) - 1], ring).otherwise(F.concat(ring, F.array(ring[0])))


ZONE_KEYS = ("zone_set", "zone_id")


def zone_edges(zones: DataFrame, col_of, row_of, keys=ZONE_KEYS) -> DataFrame:
    """One row per ring edge in cell space: zone keys + (part, x1, y1, x2, y2).

    ``col_of`` / ``row_of`` map map-X / map-Y columns to fractional cell
    column / row (the layer's inverse georeference).
    """
    keys = list(keys)
    parts = zones.select(*keys, F.posexplode("geom").alias("part", "polygon"))
    keys = [*keys, "part"]
    rings = parts.select(*keys, F.explode("polygon").alias("ring"))
    rings = rings.select(*keys, closed(F.col("ring")).alias("ring"))
    segs = rings.select(*keys, F.explode(F.transform(
        F.sequence(F.lit(0), F.size("ring") - 2),
        lambda i: F.struct(F.col("ring")[i][0].alias("X1"), F.col("ring")[i][1].alias("Y1"),
                           F.col("ring")[i + 1][0].alias("X2"), F.col("ring")[i + 1][1].alias("Y2")))).alias("s"))
    return segs.select(*keys,
                       col_of(F.col("s.X1")).alias("x1"), row_of(F.col("s.Y1")).alias("y1"),
                       col_of(F.col("s.X2")).alias("x2"), row_of(F.col("s.Y2")).alias("y2"))


def edge_rows(rows: tuple[int, int] | None = None) -> tuple[Column, Column]:
    """First and last row whose centre an edge may cross, of ``rows`` where given."""
    lo = F.ceil(F.least("y1", "y2") - HALF)
    hi = F.ceil(F.greatest("y1", "y2") - HALF) - 1
    if rows is not None:
        lo, hi = F.greatest(lo, F.lit(rows[0])), F.least(hi, F.lit(rows[1]))
    return lo, hi


def crossings(edges: DataFrame, rows: tuple[int, int] | None = None, keys=ZONE_KEYS) -> DataFrame:
    """(zone, part, y, xc): where each non-horizontal edge crosses row centre y+.5.

    Rows are limited to ``rows`` = (first, last) of the raster when given, so
    the expansion is bounded by the raster, not by the polygon.
    """
    e = edges.where(F.col("y1") != F.col("y2"))
    lo, hi = edge_rows(rows)
    e = e.select("*", lo.cast("int").alias("ylo"), hi.cast("int").alias("yhi")).where(F.col("ylo") <= F.col("yhi"))
    keys = [*keys, "part"]
    c = e.select(*keys, "x1", "y1", "x2", "y2", F.explode(F.sequence("ylo", "yhi")).alias("y"))
    yc = F.col("y") + F.lit(HALF)
    c = c.where((F.col("y1") > yc) != (F.col("y2") > yc))
    xc = F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return c.select(*keys, "y", xc.alias("xc"))


def runs(cross: DataFrame, cols: tuple[int, int] | None = None, keys=ZONE_KEYS) -> DataFrame:
    """Pair sorted crossings per (zone, part, row) into inclusive cell runs [xa, xb],
    limited to ``cols`` = (first, last), and merge the runs of a zone's row that
    overlap or touch. One exchange by (zone, row) serves all three steps."""
    keys = list(keys)
    cross = cross.repartition(*keys, "y")
    w = Window.partitionBy(*keys, "y", "part").orderBy("xc")
    p = cross.select(*keys, "y", "xc",
                     F.row_number().over(w).alias("k"), F.lead("xc").over(w).alias("xn"))
    p = p.where((F.col("k") % 2 == 1) & F.col("xn").isNotNull())
    xa = F.ceil(F.col("xc") - HALF)
    xb = F.ceil(F.col("xn") - HALF) - 1
    if cols is not None:
        xa, xb = F.greatest(xa, F.lit(cols[0])), F.least(xb, F.lit(cols[1]))
    r = p.select(*keys, "y", xa.cast("int").alias("xa"), xb.cast("int").alias("xb"))
    r = r.where(F.col("xa") <= F.col("xb"))
    row = Window.partitionBy(*keys, "y").orderBy("xa", "xb")
    before = F.max("xb").over(row.rowsBetween(Window.unboundedPreceding, -1))
    r = r.select(*keys, "y", "xa", "xb", (before.isNull() | (F.col("xa") > before + 1)).cast("int").alias("new"))
    r = r.select(*keys, "y", "xa", "xb", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)).alias("g"))
    return r.groupBy(*keys, "y", "g").agg(F.min("xa").alias("xa"), F.max("xb").alias("xb")).drop("g")


def parity_inside(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Brute-force form of the rule (tests and cross-checks only): join every
    cell with every edge of its row span and keep odd crossing counts."""
    yc = F.col("y") + F.lit(HALF)
    xc = F.col("x") + F.lit(HALF)
    cond = ((F.col("y1") > yc) != (F.col("y2") > yc)) & (
        xc >= F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    j = cells.join(edges, cond)
    return (j.groupBy("zone_set", "zone_id", "part", "x", "y", "v").agg(F.count(F.lit(1)).alias("k"))
            .where(F.col("k") % 2 == 1).drop("k", "part").distinct())
