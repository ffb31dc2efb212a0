"""Raster layers held as DataFrames.

Two physical forms of one raster, convertible both ways:

* **cell form** ``(x int, y int, v)``: one row per cell, ``x`` = column,
  ``y`` = row counted downwards from the top-left corner; ``v`` NULL = NoData.
  A cell table is expected to be dense over its extent (NoData as NULL).
* **tile form** ``(tc int, tr int, t array<v>)``: one row per N x N block of a
  regular layout, cells row-major inside the block; cells outside the raster
  (padding of edge tiles) and NoData cells are NULL.

``Layer`` wraps the cell form with its georeference, ``TileLayer`` the tile
form with the tile size. Layer metadata (extent, size) is computed from the
data by one global aggregate, like a layer-metadata pass over a raster RDD.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import kernels
from .functions import tiles as tf


@dataclass(frozen=True)
class Georef:
    """Affine georeference: map X = x0 + col*dx, map Y = y0 - row*dy.

    ``pixel()`` is the identity (map units are cell units, Y downwards).
    """

    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    srid: int = 4326

    @staticmethod
    def pixel(srid: int = 0) -> "Georef":
        return Georef(0.0, 0.0, 1.0, -1.0, srid)

    def col_of(self, X: Column) -> Column:
        """Map X -> fractional column (cell units)."""
        return (X - F.lit(float(self.x0))) / F.lit(float(self.dx))

    def row_of(self, Y: Column) -> Column:
        """Map Y -> fractional row (cell units, downwards)."""
        return (F.lit(float(self.y0)) - Y) / F.lit(float(self.dy))


@dataclass(frozen=True)
class LayerMeta:
    """Facts computed from the data (one row, a few numbers)."""

    xmin: int
    xmax: int
    ymin: int
    ymax: int
    cells: int
    data_cells: int

    @staticmethod
    def from_dims(cols: int, rows: int) -> "LayerMeta":
        """Metadata known from a file header (data cells not counted: -1)."""
        return LayerMeta(0, cols - 1, 0, rows - 1, cols * rows, -1)

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        """(xmin, xmax, ymin, ymax) of the cells."""
        return (self.xmin, self.xmax, self.ymin, self.ymax)

    @property
    def cols(self) -> int:
        return self.xmax + 1

    @property
    def rows(self) -> int:
        return self.ymax + 1


def cell_offset(a: Georef, b: Georef) -> tuple[int, int]:
    """Whole-cell shift (columns, rows) that takes b's cell indices to a's grid.

    Raises on another srid or cell size, or where the grids do not line up.
    """
    if a.srid != b.srid:
        raise ValueError(f"srid mismatch: {a.srid} vs {b.srid}")
    if not (math.isclose(a.dx, b.dx, rel_tol=1e-9) and math.isclose(a.dy, b.dy, rel_tol=1e-9)):
        raise ValueError(f"cell sizes differ: ({a.dx}, {a.dy}) vs ({b.dx}, {b.dy})")
    shift = (b.x0 - a.x0) / a.dx, (a.y0 - b.y0) / a.dy
    whole = tuple(round(s) for s in shift)
    if any(abs(s - w) > 1e-6 * max(1.0, abs(s)) for s, w in zip(shift, whole)):
        raise ValueError(f"grids are not aligned: origins differ by {shift} cells")
    return whole


def metadata_df(df: DataFrame) -> DataFrame:
    """Layer metadata as a one-row DataFrame (partial + final aggregate)."""
    return df.agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"),
        F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        F.count(F.lit(1)).alias("cells"), F.count("v").alias("data_cells"),
    )


@dataclass
class Layer:
    """A raster in cell form plus its georeference."""

    df: DataFrame
    name: str = "raster"
    georef: Georef = field(default_factory=Georef)
    known_dims: tuple[int, int] | None = None
    placed: bool = True  # False where the georeference is a guess
    _meta: LayerMeta | None = field(default=None, repr=False)

    @property
    def value_type(self) -> str:
        return self.df.schema["v"].dataType.simpleString()

    @property
    def dims(self) -> tuple[int, int] | None:
        """(cols, rows) when known without a job (from a source header or a
        metadata pass already run), else None."""
        if self.known_dims is not None:
            return self.known_dims
        if self._meta is not None:
            return (self._meta.cols, self._meta.rows)
        return None

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        """(xmin, xmax, ymin, ymax) of the cells, from a source header or else a
        metadata pass (run once)."""
        if self.known_dims is not None:
            return (0, self.known_dims[0] - 1, 0, self.known_dims[1] - 1)
        return self.meta().bounds

    def with_df(self, df: DataFrame, name: str | None = None) -> "Layer":
        return Layer(df, name or self.name, self.georef, self.known_dims, self.placed)

    def metadata(self) -> DataFrame:
        return metadata_df(self.df)

    def meta(self) -> LayerMeta:
        """Driver-side metadata; one small aggregate job, memoised."""
        if self._meta is None:
            r = self.metadata().first()
            if not r.cells:  # empty raster: zero size (xmax = ymax = -1)
                self._meta = LayerMeta(0, -1, 0, -1, 0, 0)
            else:
                self._meta = LayerMeta(r.xmin, r.xmax, r.ymin, r.ymax, r.cells, r.data_cells)
        return self._meta

    def keyed(self, n: int) -> DataFrame:
        """Cells with their layout key ``(tc, tr)`` and in-tile index ``i``."""
        return self.df.select(
            tf.tile_col(F.col("x"), n).alias("tc"),
            tf.tile_col(F.col("y"), n).alias("tr"),
            tf.tile_index(F.col("x"), F.col("y"), n).alias("i"),
            "x", "y", "v",
        )

    def to_tiles(self, n: int) -> "TileLayer":
        """Retile to a floating layout of n x n tiles (one shuffle by tile key).

        Cells are sorted by tile within their partition and tiles assembled from
        that stream one at a time, so a task holds one tile, however large.
        Places without a cell are NULL, so every tile holds n*n cells; a repeated
        cell raises.
        """
        vt = self.df.schema["v"].dataType.simpleString()
        cells = self.keyed(n).select("tc", "tr", "i", "v").repartition("tc", "tr").sortWithinPartitions("tc", "tr")
        return TileLayer(cells.mapInArrow(kernels.assembled_tiles(n), f"tc int, tr int, t array<{vt}>"), n, self.name, self.georef, source=self)

    def cache(self) -> "Layer":
        self.df = self.df.persist()
        return self

    def uncache(self) -> "Layer":
        self.df.unpersist()
        return self

    def checkpoint(self, eager: bool = True) -> "Layer":
        """Cut the lineage of a long operator chain: a reliable checkpoint in
        the session's shared ``spark.checkpoint.dir`` (set only if unset)."""
        return self.with_df(_checkpoint(self.df, eager))


def intersection(bounds: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int]:
    """Cells that lie in all of several extents (xmin, xmax, ymin, ymax)."""
    lo_x, hi_x, lo_y, hi_y = zip(*bounds)
    return max(lo_x), min(hi_x), max(lo_y), min(hi_y)


def _checkpoint(df: DataFrame, eager: bool) -> DataFrame:
    from .session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


@dataclass
class TileLayer:
    """A raster in tile form (``tc, tr, t``) on an n x n layout.

    ``extent`` is (xmin, xmax, ymin, ymax) of the raster's cells, which tells
    padding from NoData. Layers made by ``Layer.to_tiles`` take it from their
    ``source`` when it is first asked for (one small aggregate). ``blocks`` are the
    tiles' histograms ``(tc, tr, v, n)``, where they are stored.
    """

    df: DataFrame
    tile_size: int
    name: str = "raster"
    georef: Georef = field(default_factory=Georef)
    extent: tuple[int, int, int, int] | None = None
    source: Layer | None = field(default=None, repr=False)
    blocks: DataFrame | None = field(default=None, repr=False)

    def with_df(self, df: DataFrame) -> "TileLayer":
        """Other tiles on the same layout; the histograms are not theirs."""
        return replace(self, df=df, blocks=None)

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        """(xmin, xmax, ymin, ymax) of the cells; raises where nothing tells it."""
        if self.extent is None:
            if self.source is None:
                raise ValueError(f"{self.name}: the tile layer's extent is not known; pass extent=(xmin, xmax, ymin, ymax)")
            self.extent = self.source.bounds
        return self.extent

    def keys(self) -> DataFrame:
        """The layout's tile keys, without assembling tiles."""
        if self.source is not None:
            n = self.tile_size
            return self.source.df.select(tf.tile_col(F.col("x"), n).alias("tc"), tf.tile_col(F.col("y"), n).alias("tr")).distinct()
        return self.df.select("tc", "tr")

    def to_cells(self, keep_null: bool = True) -> Layer:
        """Explode tiles back to cells: the inverse of ``Layer.to_tiles``.

        Padding beyond the raster is dropped, NoData cells come back as NULL
        (``keep_null=False`` drops them too).
        """
        n = self.tile_size
        xmin, xmax, ymin, ymax = self.bounds
        c = self.df.select("tc", "tr", F.posexplode("t").alias("i", "v"))
        c = c.select(
            (F.col("tc") * n + F.col("i") % n).cast("int").alias("x"),
            (F.col("tr") * n + F.floor(F.col("i") / n)).cast("int").alias("y"),
            "v",
        ).where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))
        if not keep_null:
            c = c.where(F.col("v").isNotNull())
        return Layer(c, self.name, self.georef)

    def cache(self) -> "TileLayer":
        self.df = self.df.persist()
        return self

    def uncache(self) -> "TileLayer":
        self.df.unpersist()
        return self

    def checkpoint(self, eager: bool = True) -> "TileLayer":
        """Reliable checkpoint in the shared checkpoint folder (see Layer)."""
        return self.with_df(_checkpoint(self.df, eager))
