"""Local (cell-wise) map algebra: count, reclassify, add.

Every operator exists for both raster forms. Counts are partial + final
aggregates on the executors (one row reaches the driver); reclassify is a
projection (no shuffle); adding rasters joins on the cell or tile key.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import tiles as tf
from ..layer import Layer, LayerMeta, TileLayer, cell_offset, intersection

# Cells of a row segment that add packs before its exchange.
SEGMENT = 1024


# ---------------------------------------------------------------- cell form

def count_value(layer: Layer, a) -> DataFrame:
    """Number of cells equal to ``a`` (one row ``n``)."""
    return layer.df.where(F.col("v") == F.lit(a)).agg(F.count(F.lit(1)).alias("n"))


def count_value_by_tile(layer: Layer, a, n: int) -> DataFrame:
    """Per layout tile: cells equal to ``a`` (tiles with none give 0)."""
    k = layer.keyed(n)
    return k.groupBy("tc", "tr").agg(
        F.sum(F.when(F.col("v") == F.lit(a), 1).otherwise(0)).cast("bigint").alias("n"))


def reclassify(layer: Layer, old, new, other=tf.RECLASS_OTHER, keep_nodata: bool = False) -> Layer:
    """``localIf(v == old, new, other)``; a projection, fused by codegen."""
    e = tf.reclass_expr(F.col("v"), old, new, other, keep_nodata)
    return layer.with_df(layer.df.select("x", "y", e.alias("v")))


def reclassify_count(layer: Layer, old, new, other=tf.RECLASS_OTHER) -> DataFrame:
    """Reclassify, then count the new value and the fallback value (one pass)."""
    r = reclassify(layer, old, new, other)
    return r.df.agg(
        F.count(F.when(F.col("v") == F.lit(new), 1)).alias("n_new"),
        F.count(F.when(F.col("v") == F.lit(other), 1)).alias("n_other"),
    )


def add(a: Layer, b: Layer, name: str | None = None) -> Layer:
    """Cell-wise sum of two rasters on a common grid; inner join on (x, y).

    Cells present on one side only are dropped (like unmatched tiles of a
    tiled add); NoData on either side gives NoData. b's cells are shifted by
    whole cells to a's grid; grids that do not line up raise. The sum has the
    wider of both types, and integer sums one size more (int + int is bigint),
    so it cannot overflow where the inputs are ints. Both sides grow with the
    rasters, so neither is broadcast: cells are packed into row segments before
    the exchange and the segments joined. A repeated cell of either raster raises
    where the other has the cell.
    """
    vt = _sum_type([a, b])
    j = _segments(a.df, "a").join(_segments(_shifted(a, b), "b").hint("merge"), ["y", "seg"])
    met = j.select("y", "seg", F.explode(F.when(F.col("dense_a") & F.col("dense_b"), _met_by_place(vt)).otherwise(_met_by_order(vt))).alias("e"))
    return a.with_df(met.select((F.col("seg") * SEGMENT + F.col("e.s")).cast("int").alias("x"), "y", F.col("e.v").alias("v")), name)


def _segments(cells: DataFrame, side: str) -> DataFrame:
    """``(y, seg, s, m, v, dense)``, all but the key named by ``side``: cells by row segment
    as three arrays in the same order (place in the segment, whether NoData, value), and
    whether they are a gapless run of places in ascending order. Arrays of plain values are
    collected before the exchange, so a cell travels in 3 bytes and its value."""
    s, m, v = (f"{c}_{side}" for c in "smv")
    zero = F.lit(0).cast(cells.schema["v"].dataType)
    packed = cells.groupBy("y", F.floor(F.col("x") / SEGMENT).cast("int").alias("seg")).agg(
        F.collect_list(F.pmod(F.col("x"), F.lit(SEGMENT)).cast("short")).alias(s), F.collect_list(F.col("v").isNull()).alias(m),
        F.collect_list(F.coalesce("v", zero)).alias(v))
    first = F.get(s, F.lit(0)).cast("int")
    return packed.withColumn(f"dense_{side}", F.col(s).cast("array<int>") == F.sequence(first, first + F.size(s) - 1))


def _met_by_place(vt: str):
    """``(s, v)`` of the cells of two gapless segments: both values are found by place."""
    a, b = (F.get(f"s_{side}", F.lit(0)).cast("int") for side in "ab")
    low, high = F.greatest(a, b), F.least(a + F.size("s_a"), b + F.size("s_b")) - 1

    def cell(k):
        both = ~F.get("m_a", k - a) & ~F.get("m_b", k - b)
        return F.struct(k.alias("s"), F.when(both, F.get("v_a", k - a).cast(vt) + F.get("v_b", k - b).cast(vt)).alias("v"))

    return F.when(low <= high, F.transform(F.sequence(low, high), cell))


def _met_by_order(vt: str):
    """``(s, v)`` of the cells of any two segments: both sides sorted together by place,
    where a cell of a comes right before b's. Others there are repeated cells."""
    def side(k):
        return F.transform(F.sequence(F.lit(0), F.size(f"s_{k}") - 1), lambda i: F.struct(
            F.get(f"s_{k}", i).cast("int").alias("s"), F.lit(k).alias("side"), F.when(~F.get(f"m_{k}", i), F.get(f"v_{k}", i).cast(vt)).alias("v")))

    def pairs(cells):
        def cell(e, i):
            after = F.get(cells, i + 1)
            again = F.coalesce(F.get(cells, i - 1)["s"] == e["s"], F.lit(False)) | F.coalesce(F.get(cells, i + 2)["s"] == e["s"], F.lit(False))
            met = F.coalesce((e["side"] == "a") & (after["side"] == "b") & (after["s"] == e["s"]), F.lit(False))
            once = F.when(met & again, F.raise_error(F.lit("a cell (x, y) appears more than once in a raster")).cast("boolean")).otherwise(met)
            return F.when(once, F.struct(e["s"].alias("s"), (e["v"] + after["v"]).alias("v")))

        return F.array_compact(F.transform(cells, cell))

    return F.flatten(F.transform(F.array(F.array_sort(F.concat(side("a"), side("b")))), pairs))  # a lambda, so that cells are sorted once


def _met_once(joined: DataFrame, key: list[str], what: str) -> DataFrame:
    """Rows of a merge join, which must not hold a key twice: counted over the order
    that the join leaves, so without another exchange or sort."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    once = F.when(F.col("met") == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"{what} appears more than once in a raster")).cast("boolean"))
    return joined.withColumn("met", n).where(once).drop("met")


def _shifted(a: Layer, b: Layer) -> DataFrame:
    """b's cells on a's grid."""
    dx, dy = cell_offset(a.georef, b.georef)
    return b.df.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "v") if dx or dy else b.df.select("x", "y", "v")


def _sum_type(layers: list[Layer]) -> str:
    """Type of a sum of the layers' values: bigint for integers, else double;
    decimals keep their own addition rules through their common type."""
    return _common_sum([l.df.schema["v"].dataType for l in layers])


def _common_sum(types) -> str:
    names = {t.typeName() for t in types}
    if names <= {"byte", "short", "integer", "long"}:
        return "bigint"
    if names & {"float", "double"} or len({t.simpleString() for t in types}) > 1:
        return "double"
    return types[0].simpleString()


def add_n(layers: list[Layer], name: str | None = None) -> Layer:
    """Sum of n rasters in one shuffle: union all, group by cell.

    A cell is kept only where every raster has it; any NoData gives NoData.
    Rasters are tagged, so a repeated cell of one cannot stand in for a cell
    that another lacks; repeated cells raise. Grids and types as in :func:`add`.
    """
    if not layers:
        raise ValueError("add_n needs at least one layer")
    k = len(layers)
    vt = _sum_type(layers)
    u = reduce(DataFrame.unionByName, [_shifted(layers[0], l).select("x", "y", F.col("v").cast(vt).alias("v"), F.lit(i).alias("raster"))
                                       for i, l in enumerate(layers)])
    g = u.groupBy("x", "y").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("raster") == 0).alias("k0"),
                                *[F.count_if(F.col("raster") == i).alias(f"k{i}") for i in range(1, k)],
                                F.count("v").alias("kv"), F.sum("v").alias("s"))
    each = reduce(lambda p, q: p & q, [F.col(f"k{i}") > 0 for i in range(k)])
    once = F.when(F.col("rows") == k, F.lit(True)).otherwise(
        F.raise_error(F.lit("a cell (x, y) appears more than once in a raster")).cast("boolean"))
    out = g.where(each).where(once).select(
        "x", "y", F.when(F.col("kv") == k, F.col("s")).cast(vt).alias("v"))
    return layers[0].with_df(out, name)


# ---------------------------------------------------------------- tile form

def count_value_tiles(tl: TileLayer, a) -> DataFrame:
    """Sum over tiles of the per-tile count; no shuffle before the final agg."""
    return tl.df.agg(F.coalesce(F.sum(tf.tile_count_eq(F.col("t"), a)), F.lit(0))
                     .cast("bigint").alias("n"))


def count_value_by_tile_tiles(tl: TileLayer, a) -> DataFrame:
    return tl.df.select("tc", "tr", tf.tile_count_eq(F.col("t"), a).cast("bigint").alias("n"))


def reclassify_tiles(tl: TileLayer, meta: LayerMeta, old, new,
                     other=tf.RECLASS_OTHER, keep_nodata: bool = False) -> TileLayer:
    e = tf.tile_reclass(F.col("t"), F.col("tc"), F.col("tr"), tl.tile_size,
                        meta.bounds, old, new, other, keep_nodata)
    return tl.with_df(tl.df.select("tc", "tr", e.alias("t")))


def reclassify_count_tiles(tl: TileLayer, meta: LayerMeta, old, new,
                           other=tf.RECLASS_OTHER) -> DataFrame:
    """Counts of ``new`` and ``other`` after reclassifying, without building
    the reclassified tiles: per tile, the matches of ``old`` (one filter) and
    the number of in-raster cells (arithmetic on the tile key)."""
    n = tl.tile_size
    hits = tf.tile_count_eq(F.col("t"), old).cast("bigint")
    inside = tf.tile_inside_cells(F.col("tc"), F.col("tr"), n, meta.bounds).cast("bigint")
    s = tl.df.agg(F.coalesce(F.sum(hits), F.lit(0)).alias("h"), F.coalesce(F.sum(inside), F.lit(0)).alias("c"))
    if new == other:
        return s.select(F.col("c").alias("n_new"), F.col("c").alias("n_other"))
    return s.select(F.col("h").alias("n_new"), (F.col("c") - F.col("h")).alias("n_other"))


def add_tiles(a: TileLayer, b: TileLayer) -> TileLayer:
    """Tile-wise sum; tiles whose keys do not match are dropped, and the sum's
    extent is what both rasters cover. Layouts that differ by whole tiles are
    shifted; others raise. Types and repeated tiles as in :func:`add`."""
    vt = _tile_sum_type([a, b])
    l = a.df.select("tc", "tr", F.col("t").cast(vt).alias("ta"))
    r = _shifted_tiles(a, b).select("tc", "tr", F.col("t").cast(vt).alias("tb"))
    j = _met_once(l.join(r.hint("merge"), ["tc", "tr"], "inner"), ["tc", "tr"], "a tile")
    out = a.with_df(j.select("tc", "tr", tf.tile_add(F.col("ta"), F.col("tb")).alias("t")))
    return _covered(out, [a, b])


def _tile_sum_type(layers: list[TileLayer]) -> str:
    return f"array<{_common_sum([l.df.schema['t'].dataType.elementType for l in layers])}>"


def _tile_shift(a: TileLayer, b: TileLayer) -> tuple[int, int]:
    if a.tile_size != b.tile_size:
        raise ValueError("tile layouts differ")
    dx, dy = cell_offset(a.georef, b.georef)
    if dx % a.tile_size or dy % a.tile_size:
        raise ValueError(f"tile layouts are not aligned: origins differ by ({dx}, {dy}) cells")
    return dx, dy


def _shifted_tiles(a: TileLayer, b: TileLayer) -> DataFrame:
    dx, dy = _tile_shift(a, b)
    n = a.tile_size
    return b.df.select((F.col("tc") + dx // n).alias("tc"), (F.col("tr") + dy // n).alias("tr"), "t") if dx or dy else b.df.select("tc", "tr", "t")


def _covered(out: TileLayer, layers: list[TileLayer]) -> TileLayer:
    """``out`` with the extent that all layers cover, where it is known or can be found."""
    if any(l.extent is None and l.source is None for l in layers):
        return replace(out, extent=None, source=None)
    bounds = []
    for l in layers:
        dx, dy = cell_offset(layers[0].georef, l.georef)
        x0, x1, y0, y1 = l.bounds
        bounds.append((x0 + dx, x1 + dx, y0 + dy, y1 + dy))
    return replace(out, extent=intersection(bounds), source=None)


def add_n_tiles(layers: list[TileLayer]) -> TileLayer:
    """Tile-wise sum of n rasters in one shuffle: union, exchange by tile key, and the
    sorted tiles of a key added up as they stream by, so a task holds a running sum
    and never the n tiles of a key. Tiles missing from any raster are dropped."""
    if not layers:
        raise ValueError("add_n_tiles needs at least one layer")
    vt = _tile_sum_type(layers)
    u = reduce(DataFrame.unionByName, [_shifted_tiles(layers[0], l).select("tc", "tr", F.lit(i).alias("raster"), F.col("t").cast(vt).alias("t"))
                                       for i, l in enumerate(layers)])
    cells = layers[0].tile_size ** 2
    by_key = u.repartition("tc", "tr").sortWithinPartitions("tc", "tr", "raster")
    summed = by_key.mapInArrow(kernels.summed_tiles(len(layers), cells), f"tc int, tr int, t {vt}")
    return _covered(layers[0].with_df(summed), layers)
