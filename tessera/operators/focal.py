"""Focal (neighbourhood) map algebra: square-neighbourhood mean.

Plan: cells are hash-partitioned once on a block key ``(bc, br)``. The 3x3 (or
(2r+1)^2) box sum is separable, so two window passes follow inside that same
partitioning, with no further exchange:

1. row pass   ``partitionBy(bc, br, y).orderBy(x)``, sums over x-r .. x+r,
2. column pass ``partitionBy(bc, br, x).orderBy(y)``, sums over y-r .. y+r
   of the row sums.

A sum over x-r .. x+r is the running sum up to x+r less the one up to x-r-1.
Both are frames that only grow, so a cell costs the same for any radius (a
sliding frame would add up 2r+1 cells for each).

``edge='tile'`` uses the layout tiles as blocks and nothing crosses a tile
border (what applying the operator tile by tile gives). ``edge='halo'`` is
seamless: a cell within ``r`` of its block border is also sent to the
neighbouring block(s) as a halo row and only core cells are kept, so the
exchange carries about ``1 + 4r/n`` times the cells. Every window partition
is one row or column of one block, so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import kernels
from ..layer import Layer, LayerMeta, TileLayer

DEFAULT_BLOCK = 256


def _targets(x: Column, y: Column, n: int, r: int) -> Column:
    """Blocks a cell must reach: its own (core) and neighbours within r.

    Interior cells (the large majority when r << n) produce their core target
    only; the 9 candidates are evaluated for border cells alone.
    """
    lx, ly = F.pmod(x, F.lit(n)), F.pmod(y, F.lit(n))
    near = {-1: (lx < r, ly < r), 0: (F.lit(True), F.lit(True)), 1: (lx >= n - r, ly >= n - r)}

    def target(ox, oy):
        return F.struct(F.lit(ox).alias("ox"), F.lit(oy).alias("oy"))

    cands = []
    for ox in (-1, 0, 1):
        for oy in (-1, 0, 1):
            cond = near[ox][0] & near[oy][1]
            cands.append(F.when(cond, target(ox, oy)))
    border = (lx < r) | (ly < r) | (lx >= n - r) | (ly >= n - r)
    return F.explode(F.when(border, F.array(*cands)).otherwise(F.array(target(0, 0))))


def _blocked(layer: Layer, n: int, radius: int, halo: bool) -> DataFrame:
    """Cells hash-partitioned on their n x n block, with halo copies of the
    cells within ``radius`` of a block border when ``halo`` (one exchange)."""
    x, y = F.col("x"), F.col("y")
    bc = F.floor(x / F.lit(n)).cast("int")
    br = F.floor(y / F.lit(n)).cast("int")
    if not halo:
        src = layer.df.select("x", "y", "v", bc.alias("bc"), br.alias("br"), F.lit(True).alias("core"))
    else:
        src = (layer.df.select("x", "y", "v", bc.alias("bc0"), br.alias("br0"), _targets(x, y, n, radius).alias("o"))
               .where(F.col("o").isNotNull())
               .select("x", "y", "v",
                       (F.col("bc0") + F.col("o.ox")).alias("bc"), (F.col("br0") + F.col("o.oy")).alias("br"),
                       ((F.col("o.ox") == 0) & (F.col("o.oy") == 0)).alias("core")))
    return src.repartition("bc", "br")


#: Radii up to this use sliding frames on floating-point values, whose sums then
#: have no rounding but that of adding the neighbours up.
SLIDING_RADIUS = 4


def _box(c: Column, w: WindowSpec, r: int, real: bool) -> Column:
    """Sum of ``c`` over the window's neighbours within r; NULL where there are none."""
    if real and r <= SLIDING_RADIUS:
        return F.sum(c).over(w.rangeBetween(-r, r))

    def between(x):
        upto = x.over(w.rangeBetween(Window.unboundedPreceding, r))
        return upto - F.coalesce(x.over(w.rangeBetween(Window.unboundedPreceding, -r - 1)), F.lit(0))

    n = between(F.count(c))
    if not real:
        return F.when(n > 0, between(F.sum(c)))
    # infinite values would stay in all later differences: counted apart
    inf = float("inf")
    finite = F.coalesce(between(F.sum(F.when(F.abs(c) < inf, c))), F.lit(0.0))
    up, down = between(F.count(F.when(c == inf, 1))), between(F.count(F.when(c == -inf, 1)))
    return F.when(n > 0, finite + F.when(up > 0, inf).otherwise(0.0) - F.when(down > 0, inf).otherwise(0.0))


def _block_size(edge: str, radius: int, tile_size: int | None, block: int | None) -> int:
    if radius < 0:
        raise ValueError("radius must be >= 0")
    if edge == "tile":
        if not tile_size:
            raise ValueError("edge='tile' needs the layout tile_size")
        return tile_size
    if edge == "halo":
        # wide enough for the halo to stay a small share of a block
        return max(block or max(DEFAULT_BLOCK, 16 * radius), radius + 1)
    raise ValueError(f"unknown edge mode {edge!r}")


def focal_sums(layer: Layer, radius: int = 1, edge: str = "halo",
               tile_size: int | None = None, block: int | None = None) -> DataFrame:
    """Neighbourhood sum ``ss`` and count ``cc`` of non-null values per cell. The cost
    of a cell doesn't depend on the radius."""
    n = _block_size(edge, radius, tile_size, block)
    src = _blocked(layer, n, radius, edge == "halo")
    real = layer.df.schema["v"].dataType.typeName() in ("float", "double")
    w_row = Window.partitionBy("bc", "br", "y").orderBy("x")
    w_col = Window.partitionBy("bc", "br", "x").orderBy("y")
    has = F.when(F.col("v").isNotNull(), F.lit(1).cast("bigint")).otherwise(0)
    h = src.select("bc", "br", "x", "y", "v", "core",
                   _box(F.col("v"), w_row, radius, real).alias("hs"), _box(has, w_row, radius, False).alias("hc"))
    s = h.select("x", "y", "v", "core",
                 _box(F.col("hs"), w_col, radius, real).alias("ss"), _box(F.col("hc"), w_col, radius, False).alias("cc"))
    return s.where(F.col("core")).drop("core")


def _ranges(r: int) -> list[tuple[int, int]]:
    """Offset ranges [a, b] with -r <= a <= 0 <= b <= r, indexed by the clip
    amounts (lo clip = a + r, hi clip = r - b)."""
    return [(-r + lo, r - hi) for lo in range(r + 1) for hi in range(r + 1)]


def clipped_sums(layer: Layer, radius: int = 1, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Every cell with the sum and count of non-null values over each of the
    (r+1)^4 rectangles [a, b] x [c, d] (-r <= a, c <= 0 <= b, d <= r) around
    it: the neighbourhood clipped at any tile edge. One exchange (halo'd
    blocks); the row pass has one range frame per x-range, the column pass
    one per y-range, so no large per-row expression is built."""
    n = max(block, radius + 1)
    src = _blocked(layer, n, radius, True)
    rng = _ranges(radius)
    w_row = Window.partitionBy("bc", "br", "y").orderBy("x")
    h = src.select("bc", "br", "x", "y", "core", *[
        f for i, (a, b) in enumerate(rng)
        for f in (F.sum("v").over(w_row.rangeBetween(a, b)).alias(f"hs{i}"),
                  F.count("v").over(w_row.rangeBetween(a, b)).alias(f"hc{i}"))])
    w_col = Window.partitionBy("bc", "br", "x").orderBy("y")
    out = []
    for i in range(len(rng)):              # x-range
        for j, (c, d) in enumerate(rng):   # y-range
            out += [F.sum(f"hs{i}").over(w_col.rangeBetween(c, d)).alias(f"s{i}_{j}"),
                    F.sum(f"hc{i}").over(w_col.rangeBetween(c, d)).alias(f"c{i}_{j}")]
    return h.select("x", "y", "core", *out).where(F.col("core")).drop("core")


def _clip_index(n: int, r: int) -> Column:
    """Index (x-range, y-range) of the in-tile rectangle of a cell in n x n
    tiles, into the row-major list of ``clipped_sums`` rectangles."""
    lx, ly = F.pmod(F.col("x"), F.lit(n)), F.pmod(F.col("y"), F.lit(n))
    z = F.lit(0)
    cl, cr = F.greatest(z, r - lx), F.greatest(z, r - (n - 1 - lx))
    ct, cb = F.greatest(z, r - ly), F.greatest(z, r - (n - 1 - ly))
    k = r + 1
    return (cl * k + cr) * (k * k) + (ct * k + cb)


def focal_count_sweep(layer: Layer, a: int, sizes, radius: int = 1, block: int = DEFAULT_BLOCK) -> DataFrame:
    """For every tile size: cells whose per-tile focal mean truncates to ``a``.

    One exchange for all sizes (instead of one per size): the sums over every
    neighbourhood rectangle a tile edge can leave are computed once per cell
    by window frames (they do not depend on the tile size); each size only
    picks one rectangle by index, and all counts are one aggregate.
    """
    sizes = sorted({int(z) for z in sizes})
    k = (radius + 1) ** 2
    cs = clipped_sums(layer, radius, block)
    means = F.array(*[F.when(F.col(f"c{i}_{j}") > 0,
                             F.col(f"s{i}_{j}").cast("double") / F.col(f"c{i}_{j}").cast("double"))
                      for i in range(k) for j in range(k)])
    m = cs.select("x", "y", means.alias("means"))
    mean = {z: F.element_at("means", _clip_index(z, radius) + 1) for z in sizes}
    counts = m.agg(*[F.count(F.when(truncates_to(mean[z], a), 1)).alias(f"c{z}") for z in sizes])
    rows = F.array(*[F.struct(F.lit(z).alias("tile_size"), F.col(f"c{z}").alias("n")) for z in sizes])
    return counts.select(F.explode(rows).alias("r")).select("r.tile_size", "r.n")


def truncates_to(v: Column, a: int) -> Column:
    """``v`` truncated toward zero equals ``a``; a comparison of doubles, so values
    beyond any integer type simply differ."""
    if a == 0:
        return (v > -1.0) & (v < 1.0)
    return (v >= float(a)) & (v < float(a + 1)) if a > 0 else (v <= float(a)) & (v > float(a - 1))


def focal_mean(layer: Layer, radius: int = 1, edge: str = "halo",
               tile_size: int | None = None, block: int | None = None) -> Layer:
    """Mean of the non-null cells of the (2r+1)^2 square around each cell.

    Includes the centre; NULL when the neighbourhood holds no data; a NoData
    centre still gets a value.
    """
    s = focal_sums(layer, radius, edge, tile_size, block)
    m = F.when(F.col("cc") > 0, F.col("ss").cast("double") / F.col("cc").cast("double"))
    return layer.with_df(s.select("x", "y", m.alias("v")), f"{layer.name}_focal_mean")


def count_truncated(layer: Layer, a: int) -> DataFrame:
    """Count cells whose value truncated toward zero equals ``a``."""
    return layer.df.where(truncates_to(F.col("v"), a)).agg(F.count(F.lit(1)).alias("n"))


def corner_sample(layer: Layer, tile_size: int, k: int = 5) -> DataFrame:
    """Value of the upper-left cell of each tile; first k tiles by (tr, tc).

    The limit is the feature here (a top-k sample); Spark plans it as
    TakeOrderedAndProject, so no global sort runs.
    """
    n = tile_size
    c = layer.df.where((F.pmod("x", F.lit(n)) == 0) & (F.pmod("y", F.lit(n)) == 0))
    c = c.select(F.floor(F.col("x") / n).cast("int").alias("tc"),
                 F.floor(F.col("y") / n).cast("int").alias("tr"), "v")
    return c.orderBy("tr", "tc").limit(k)


# ---------------------------------------------------------------- tile form

def focal_mean_tiles(tl: TileLayer, meta: LayerMeta, radius: int = 1) -> TileLayer:
    """Per-tile focal mean on the tile form (``edge='tile'`` semantics).

    Narrow: every tile is transformed on its own (no exchange once a raster is
    stored tiled). The box sums are a numpy kernel over Arrow batches of
    tiles (``mapInArrow``), vectorised across all tiles of a batch; integer
    sums are exact, so results equal the cell form bit for bit. Cells outside
    the raster (padding) stay NULL.
    """
    n = tl.tile_size
    schema = "tc int, tr int, t array<double>"
    fn = kernels.focal_mean_batches(n, radius, meta.bounds)
    return tl.with_df(tl.df.select("tc", "tr", "t").mapInArrow(fn, schema))


def focal_mean_tiles_halo(tl: TileLayer, meta: LayerMeta, radius: int = 1) -> TileLayer:
    """Seamless focal mean on the tile form.

    Each tile sends only its r-wide border strips to its 8 neighbours (about
    4r/n of the data); strips are grouped per target tile (at most 8 each)
    and joined to the tiles on the tile key; a numpy kernel then works on the
    padded (n+2r)^2 block. Equals the cell-form ``edge='halo'`` result.
    """
    n = tl.tile_size
    if radius >= n:
        raise ValueError("radius must be smaller than the tile size")
    vt = tl.df.schema["t"].dataType.elementType.simpleString()
    strips = tl.df.select("tc", "tr", "t").mapInArrow(
        kernels.halo_strips(n, radius), f"tc int, tr int, ox int, oy int, s array<{vt}>")
    halo = strips.groupBy("tc", "tr").agg(F.collect_list(F.struct("ox", "oy", "s")).alias("halo"))
    j = tl.df.select("tc", "tr", "t").join(halo, ["tc", "tr"], "left")
    fn = kernels.focal_mean_halo_batches(n, radius, meta.bounds)
    return tl.with_df(j.mapInArrow(fn, "tc int, tr int, t array<double>"))


def count_truncated_tiles(tl: TileLayer, a: int) -> DataFrame:
    """Cells of a double tile layer whose truncated value equals ``a``."""
    per_tile = F.size(F.filter(F.col("t"), lambda m: truncates_to(m, a)))
    return tl.df.agg(F.coalesce(F.sum(per_tile), F.lit(0)).cast("bigint").alias("n"))


def corner_sample_tiles(tl: TileLayer, k: int = 5) -> DataFrame:
    """Upper-left cell of each tile (``t[0]``), first k tiles by (tr, tc)."""
    return tl.df.select("tc", "tr", F.element_at("t", 1).alias("v")).orderBy("tr", "tc").limit(k)
