"""Zonal map algebra: per-polygon histograms and statistics for all zones at once.

Plan (one job for every zone of every zone set):

1. zones -> ring edges in cell space -> crossings with row centres ->
   runs ``(zk, y, xa, xb)`` (scanline form of the even-odd rule, see
   ``tessera.functions.geometry``); this side is derived from the polygons,
   not from the raster. ``zk`` is a 64-bit key per zone, so the raster-sized
   side carries one long instead of two strings;
2. runs are cut at x-bins as wide as about half of their length, so the join
   key is ``(y, width, xbin)`` and a cell meets at most twice as many runs as
   it lies in; the run side is broadcast only after counting it (a proven
   bound); beyond, cells are packed into row segments, hash-partitioned, and
   runs take slices of them; the raster scan is pruned to the runs' bounding box;
3. histogram = ``groupBy(zk, v).count()`` (map-side partial aggregation,
   so a zone holding a third of the raster is pre-aggregated per task);
4. statistics are a few rounds of grouped counts over the histogram; zone
   names are attached to per-zone results only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import tiles as tf
from ..layer import Georef, Layer, TileLayer
from ..sources.geojson import ZoneSet
from .statistics import Numbers, grouped_statistics

# Widest x-bin of the run/cell join, cells of a packed row segment, the largest run
# table that is broadcast (rows of fixed width, about 40 bytes each), the largest
# table of numbers per zone that is (one row of a few hundred bytes per zone), and
# the largest table of zone ids and names (bytes).
BIN_WIDTH = 1024
SEGMENT = 1024
BROADCAST_MAX_RUNS = 1_000_000
BROADCAST_MAX_ZONES = 500_000
BROADCAST_MAX_NAMES = 32 << 20
KEY = ("zk",)


def _check_srid(srid: int, zones: ZoneSet) -> None:
    if srid != zones.srid:
        raise ValueError(f"srid mismatch: raster {srid}, zones {zones.srid}")


def _runs(g: Georef, bounds, zones: ZoneSet) -> DataFrame:
    """Runs of all zones, always clipped to the raster's (xmin, xmax, ymin, ymax)."""
    _check_srid(g.srid, zones)
    edges = geo.zone_edges(zones.df, g.col_of, g.row_of, KEY)
    cross = geo.crossings(edges, tuple(bounds[2:]), KEY)
    return geo.runs(cross, tuple(bounds[:2]), KEY)


def _run_bound(g: Georef, bounds, zones: ZoneSet):
    """``(most, box)`` from the zones' edges alone, without an exchange: at least as many
    as there are runs, and a box (x0, y0, x1, y1) in the raster that holds them all."""
    _check_srid(g.srid, zones)
    xmin, xmax, ymin, ymax = bounds
    e = geo.zone_edges(zones.df, g.col_of, g.row_of, KEY).where(F.col("y1") != F.col("y2"))
    ylo, yhi = (c.cast("int") for c in geo.edge_rows((ymin, ymax)))
    e = e.select("x1", "x2", ylo.alias("ylo"), yhi.alias("yhi")).where("ylo <= yhi")
    r = e.agg(F.sum(F.col("yhi").cast("bigint") - F.col("ylo") + 1).alias("crossings"), F.min("ylo").alias("y0"), F.max("yhi").alias("y1"),
              F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"),
              F.count(F.when(F.col("x1").isNull() | F.col("x2").isNull(), 1)).alias("unknown")).first()
    most = (r.crossings or 0) // 2  # two crossings to a run
    if not most or r.unknown or r.x0 is None:
        return most, (xmin, r.y0, xmax, r.y1)
    # a cell more on either side: crossings are rounded
    return most, (int(max(xmin, min(r.x0 - 2, xmax))), r.y0, int(min(xmax, max(r.x1 + 2, xmin))), r.y1)


def zone_runs(layer: Layer, zones: ZoneSet) -> DataFrame:
    """Inclusive cell runs ``(zone_set, zone_id, y, xa, xb)`` of every zone."""
    return _with_names(_runs(layer.georef, layer.bounds, zones), zones)


def _widths(widest: int) -> list[int]:
    """Widths of the x-bins: powers of four up to the widest."""
    return [w for w in (4**k for k in range(16)) if w < widest] + [widest]


def _width_of(length: Column, widths: list[int]) -> Column:
    """Bin width of a run: the widest with 2 w - 2 <= length. The bins that a run
    touches then hold at most twice its cells, and a run below the widest class
    touches at most ten of them."""
    out = F.lit(widths[0])
    for w in widths[1:]:
        out = F.when(length >= 2 * w - 2, F.lit(w)).otherwise(out)
    return out


def _size_and_bounds(runs: DataFrame, y: str, xa: str, xb: str, widths: list[int] | None = None):
    """One small job over the run table: its row count after cutting runs at
    x-bins (computed arithmetically, nothing is exploded), the bounding box
    of all runs (used to prune the raster scan), and the bin widths in use."""
    k, used = F.count(F.lit(1)), F.lit(0)
    if widths:
        w = _width_of(F.col(xb) - F.col(xa) + 1, widths)
        k = F.coalesce(F.sum(F.floor(F.col(xb) / w) - F.floor(F.col(xa) / w) + 1), F.lit(0)).cast("bigint")
        used = F.array_sort(F.collect_set(w))  # one of a few widths each
    r = runs.agg(k.alias("k"), F.min(y).alias("y0"), F.max(y).alias("y1"),
                 F.min(xa).alias("x0"), F.max(xb).alias("x1"), F.any_value(used).alias("w") if not widths else used.alias("w")).first()
    return r.k, (r.x0, r.y0, r.x1, r.y1), r.w


def _names(zones: ZoneSet) -> DataFrame:
    """zk -> (zone_set, zone_id, name, zid); broadcast when its bytes allow."""
    k = zones.df.select("zk", "zone_set", "zone_id", "name", "zid")
    return F.broadcast(k) if zones.names_bound() <= BROADCAST_MAX_NAMES else k


def _with_names(df: DataFrame, zones: ZoneSet, extra=()) -> DataFrame:
    cols = [c for c in df.columns if c != "zk"]
    j = df.join(_names(zones), "zk")
    return j.select("zone_set", "zone_id", *extra, *cols)


def _bins(xa: Column, xb: Column, w: Column) -> Column:
    return F.explode(F.sequence(F.floor(xa / w).cast("int"), F.floor(xb / w).cast("int")))


def _zone_cells_keyed(layer: Layer, zones: ZoneSet, bin_width: int = BIN_WIDTH,
                      broadcast_max_runs: int = BROADCAST_MAX_RUNS) -> DataFrame | None:
    """Cells of every zone keyed by zone hash: ``(zk, x, y, v)``; None when no
    zone touches the raster rows.

    Runs are binned by their length (see ``_width_of``), so that a cell is compared
    with at most twice as many runs as it lies in, however many short runs share
    a row; a cell looks into one bin per width in use. Beyond the broadcast bound,
    cells are packed into row segments instead (see ``_segment_cells``); where the
    edges already may give more runs than that, the runs are made once and not counted.
    """
    widths = _widths(bin_width)
    r = _runs(layer.georef, layer.bounds, zones)
    most, (x0, y0, x1, y1) = _run_bound(layer.georef, layer.bounds, zones)
    if not most:
        return None
    if most > broadcast_max_runs:
        cells = layer.df.where(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
        return _segment_cells(cells, r, min(bin_width, SEGMENT))
    n_runs, (x0, y0, x1, y1), used = _size_and_bounds(r, "y", "xa", "xb", widths)
    if n_runs == 0:
        return None
    # prune to the zones' bounding box (reaches parquet row-group statistics)
    cells = layer.df.where(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
    if n_runs > broadcast_max_runs:
        return _segment_cells(cells, r, min(bin_width, SEGMENT))
    r = r.withColumn("w", _width_of(F.col("xb") - F.col("xa") + 1, widths))
    side = F.broadcast(r.select("zk", F.col("y").alias("ry"), "xa", "xb", F.col("w").alias("rw"),
                                _bins(F.col("xa"), F.col("xb"), F.col("w")).alias("rbin")))
    probes = [F.struct(F.lit(w).alias("w"), F.floor(F.col("x") / w).cast("int").alias("bin")) for w in used]
    cells = cells.select("x", "y", "v", probes[0].alias("p") if len(used) == 1 else F.explode(F.array(*probes)).alias("p"))
    cells = cells.select("x", "y", "v", F.col("p.w").alias("w"), F.col("p.bin").alias("bin"))
    cond = ((cells["y"] == side["ry"]) & (cells["w"] == side["rw"]) & (cells["bin"] == side["rbin"])
            & (cells["x"] >= side["xa"]) & (cells["x"] <= side["xb"]))
    return cells.join(side, cond).select("zk", "x", "y", "v")


def _segment_cells(cells: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """``(zk, x, y, v)`` by row segments of ``width`` cells: cells are packed before
    the exchange, and a run takes its stretch of the segment as a slice, so no cell
    is compared with a run at all. Segments with gaps are filtered instead."""
    seg = F.floor(F.col("x") / width).cast("int").alias("seg")
    packed = cells.groupBy("y", seg).agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("c"))
    pieces = runs.select("zk", F.col("y").alias("ry"), "xa", "xb", _bins(F.col("xa"), F.col("xb"), F.lit(width)).alias("rseg"))
    j = packed.join(pieces, (packed["y"] == pieces["ry"]) & (packed["seg"] == pieces["rseg"]))
    c, xa, xb = F.col("c"), F.col("xa"), F.col("xb")
    first, last = c[0]["x"], c[F.size(c) - 1]["x"]
    a, b = F.greatest(xa, first), F.least(xb, last)
    whole = F.size(c) == last - first + 1
    part = F.when(whole, F.slice(c, a - first + 1, F.greatest(b - a + 1, F.lit(0)))).otherwise(
        F.filter(c, lambda e: e["x"].between(xa, xb)))
    return j.select("zk", "y", F.explode(part).alias("e")).select("zk", "e.x", "y", "e.v")


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def zone_cells(layer: Layer, zones: ZoneSet, **kw) -> DataFrame:
    """Cells of every zone: ``(zone_set, zone_id, x, y, v)``."""
    z = _zone_cells_keyed(layer, zones, **kw)
    if z is None:
        vt = layer.df.schema["v"].dataType.simpleString()
        return _empty(layer.df.sparkSession, f"zone_set string, zone_id string, x int, y int, v {vt}")
    return _with_names(z, zones)


def _histogram_keyed(layer: Layer, zones: ZoneSet, **kw) -> DataFrame:
    z = _zone_cells_keyed(layer, zones, **kw)
    if z is None:
        vt = layer.df.schema["v"].dataType.simpleString()
        return _empty(layer.df.sparkSession, f"zk bigint, v {vt}, n bigint")
    z = z.where(F.col("v").isNotNull())
    return z.groupBy("zk", "v").agg(F.count(F.lit(1)).alias("n"))


def histogram(layer: Layer, zones: ZoneSet, **kw) -> DataFrame:
    """Per zone and value: number of data cells ``n`` (NoData not counted)."""
    return _with_names(_histogram_keyed(layer, zones, **kw), zones)


def _statistics_keyed(hist: DataFrame, zones: ZoneSet) -> DataFrame:
    """Per zone (keyed) statistics from a keyed histogram ``(zk, v, n)``.
    Zones with no data cell are kept with n = 0 and NULL statistics."""
    v = F.col("v")
    hist = hist.where(v.isNotNull() & ~F.isnan(v)) if hist.schema["v"].dataType.typeName() in ("double", "float") else hist.where(v.isNotNull())
    small = zones.zone_count_bound() <= BROADCAST_MAX_ZONES
    s = grouped_statistics(hist, small)
    named = zones.df.select("zk", "zone_set", "zone_id", "name", "zid").join(F.broadcast(s) if small else s, "zk", "left")
    return named.select("zone_set", "zone_id", "name", "zid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                        "min", "max", "mean", "median", "mode", "stddev")


def statistics_from_histogram(hist: DataFrame, zones: ZoneSet) -> DataFrame:
    """Per zone: n, min, max, mean, median, mode, stddev (population), from a
    histogram ``(zone_set, zone_id, v, n)``.

    * median: interpolated (mean of the two middle values for even n), exact;
    * mode: most frequent value, the smallest on ties;
    * stddev about the mean, from exact sums where the values are integers.

    See :mod:`tessera.operators.statistics` for how, for values of any type.
    """
    keyed = hist.select(F.xxhash64("zone_set", "zone_id").alias("zk"), "v", "n")
    return _statistics_keyed(keyed, zones)


def statistics(layer: Layer, zones: ZoneSet, **kw) -> DataFrame:
    """Zone statistics of a raster of any numeric type, from its histogram (one
    scan); NaN is NoData."""
    return _statistics_keyed(_histogram_keyed(layer, zones, **kw), zones)


def min_max_mean(layer: Layer, zones: ZoneSet, **kw) -> DataFrame:
    """The (min, max, mean) triple per feature id: one aggregate over the
    histogram (integers, decimals) or the cells (floating point), no median."""
    if layer.df.schema["v"].dataType.typeName() in ("double", "float"):
        return _min_max_mean_float(layer, zones, **kw)
    hist = _histogram_keyed(layer, zones, **kw)
    num = Numbers(hist.schema["v"].dataType)
    h = hist.select("zk", F.lit(None).cast("string").alias("zone_set"), F.lit(None).cast("string").alias("zone_id"),
                    "v", F.col("n").cast("bigint").alias("n"))
    keys = zones.df.select("zk", "zone_set", "zone_id", F.lit(None).cast(hist.schema["v"].dataType).alias("v"),
                           F.lit(0).cast("bigint").alias("n"))
    s = h.unionByName(keys).groupBy("zk").agg(
        F.max("zone_set").alias("zone_set"), F.max("zone_id").alias("zone_id"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        num.sum(F.col("v"), F.col("n")).alias("s1"), F.sum("n").alias("n"))
    mean = F.when(F.col("n") > 0, num.average(F.col("s1"), F.col("n")))
    return s.select("zone_set", "zone_id", "min", "max", mean.alias("mean"))


def _min_max_mean_float(layer: Layer, zones: ZoneSet, **kw) -> DataFrame:
    """(min, max, mean) of a floating-point raster: one aggregate over the
    zone cells (one raster scan), zone keys merged by union."""
    keys = zones.df.select("zk", "zone_set", "zone_id", *[F.lit(None).cast("double").alias(c)
                                                            for c in ("v", "w")])
    z = _zone_cells_keyed(layer, zones, **kw)
    u = keys
    if z is not None:
        z = z.where(F.col("v").isNotNull() & ~F.isnan("v"))
        u = u.unionByName(z.select("zk", F.lit(None).cast("string").alias("zone_set"),
                                   F.lit(None).cast("string").alias("zone_id"),
                                   F.col("v").cast("double").alias("v"), F.lit(1.0).alias("w")))
    s = u.groupBy("zk").agg(F.max("zone_set").alias("zone_set"), F.max("zone_id").alias("zone_id"),
                            F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    return s.select("zone_set", "zone_id", "min", "max", "mean")


# ---------------------------------------------------------------- tile form

def zone_tile_pieces(tl: TileLayer, zones: ZoneSet) -> DataFrame:
    """Runs cut at tile borders: ``(zk, tc, tr, y, pa, pb)``."""
    return _pieces(_runs(tl.georef, _tile_bounds(tl), zones), tl.tile_size)


def _tile_bounds(tl: TileLayer) -> tuple[int, int, int, int]:
    """The raster's bounds; where the layer doesn't know them, those of its tiles
    (their padding is NULL and never counted)."""
    if tl.extent is not None or tl.source is not None:
        return tl.bounds
    n = tl.tile_size
    e = tl.df.agg(F.min("tc").alias("c0"), F.max("tc").alias("c1"), F.min("tr").alias("r0"), F.max("tr").alias("r1")).first()
    return (0, -1, 0, -1) if e.c0 is None else (e.c0 * n, (e.c1 + 1) * n - 1, e.r0 * n, (e.r1 + 1) * n - 1)


def _pieces(r: DataFrame, n: int) -> DataFrame:
    p = r.select("zk", "y", "xa", "xb",
                 F.floor(F.col("y") / n).cast("int").alias("tr"),
                 F.explode(F.sequence(F.floor(F.col("xa") / n).cast("int"),
                                      F.floor(F.col("xb") / n).cast("int"))).alias("tc"))
    return p.select("zk", "tc", "tr", "y",
                    F.greatest(F.col("xa"), F.col("tc") * n).alias("pa"),
                    F.least(F.col("xb"), F.col("tc") * n + (n - 1)).alias("pb"))


def tile_histograms(tl: TileLayer) -> DataFrame:
    """Histogram of every tile: ``(tc, tr, v, n)``, data cells only. Stored beside the
    tiles (``sinks.save_tiles``), it answers for tiles that lie wholly in a zone."""
    cells = tl.df.select("tc", "tr", F.explode("t").alias("v")).where(F.col("v").isNotNull())
    return cells.groupBy("tc", "tr", "v").agg(F.count(F.lit(1)).alias("n"))


def _histogram_tiles_keyed(tl: TileLayer, zones: ZoneSet,
                           broadcast_max_runs: int = BROADCAST_MAX_RUNS) -> DataFrame:
    pieces = zone_tile_pieces(tl, zones)
    vt = tl.df.schema["t"].dataType.elementType.simpleString()
    empty = _empty(tl.df.sparkSession, f"zk bigint, v {vt}, n bigint")
    if tl.blocks is None:
        k, box, _ = _size_and_bounds(pieces, "tr", "tc", "tc")
        c = _piece_cells(tl, pieces, k, box, broadcast_max_runs) if k else None
        return empty if c is None else c.groupBy("zk", "v").agg(F.count(F.lit(1)).alias("n"))
    # Tiles of which a zone has all cells are read from their histograms; only the
    # tiles on its border are read themselves.
    inside = tf.tile_inside_cells(F.col("tc"), F.col("tr"), tl.tile_size, _tile_bounds(tl))
    covered = F.sum(F.col("pb") - F.col("pa") + 1).over(Window.partitionBy("zk", "tc", "tr"))
    pieces = pieces.withColumn("whole", covered == inside)
    whole, border = pieces.where("whole"), pieces.where("NOT whole")
    n_border, box, _ = _size_and_bounds(border, "tr", "tc", "tc")
    whole = whole.select("zk", "tc", "tr").distinct()
    n_whole, (tc0, tr0, tc1, tr1), _ = _size_and_bounds(whole, "tr", "tc", "tc")
    parts = [empty]
    if n_whole:
        blocks = tl.blocks.where(F.col("tr").between(tr0, tr1) & F.col("tc").between(tc0, tc1))
        side = F.broadcast(whole) if n_whole <= broadcast_max_runs else whole
        parts.append(blocks.join(side, ["tc", "tr"]).select("zk", "v", "n"))
    if n_border:
        parts.append(_piece_cells(tl, border, n_border, box, broadcast_max_runs).select("zk", "v", F.lit(1).cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("zk", "v").agg(F.sum("n").alias("n"))


def _piece_cells(tl: TileLayer, pieces: DataFrame, k: int, box, broadcast_max_runs: int) -> DataFrame:
    """``(zk, v)`` of the data cells of k run pieces, sliced out of the tiles."""
    n = tl.tile_size
    tc0, tr0, tc1, tr1 = box
    tiles = tl.df.where(F.col("tr").between(tr0, tr1) & F.col("tc").between(tc0, tc1))
    side = F.broadcast(pieces) if k <= broadcast_max_runs else pieces
    j = tiles.join(side, ["tc", "tr"])
    start = (F.col("y") - F.col("tr") * n) * n + (F.col("pa") - F.col("tc") * n) + 1
    vals = F.slice(F.col("t"), start, F.col("pb") - F.col("pa") + 1)
    return j.select("zk", F.explode(vals).alias("v")).where(F.col("v").isNotNull())


def histogram_tiles(tl: TileLayer, zones: ZoneSet, **kw) -> DataFrame:
    """Zonal histogram on the tile form: join run pieces to tiles on the tile
    key, slice each piece's cells out of its tile row, count per value.

    The large side is probed once per tile instead of once per cell. Where the
    layer has its tiles' histograms (``blocks``), tiles wholly inside a zone are
    answered from them, and a zone without border tiles reads no cell.
    """
    return _with_names(_histogram_tiles_keyed(tl, zones, **kw), zones)


def statistics_tiles(tl: TileLayer, zones: ZoneSet, **kw) -> DataFrame:
    return _statistics_keyed(_histogram_tiles_keyed(tl, zones, **kw), zones)
