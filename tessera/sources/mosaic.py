"""Folders of GeoTIFF files, planned in the executors.

The files are listed by Spark; their headers are read where they are, as rows; the
mosaic (origin, size, cell size, srid) is one aggregate over those rows, and the
checks that files line up and don't overlap are joins on them. Each header row is
cut into groups of windows in the executors too, the groups are dealt out, and each
task reads its groups' byte ranges. So the driver holds one row, whatever the
number of files, segments and windows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layer import Georef, Layer, LayerMeta, TileLayer
from ..session import default_parallelism
from . import geotiff as gt

HEADERS = ("path string, x0 double, y0 double, dx double, dy double, srid int, width int, height int, kind string, header binary")
MAX_TASKS = 100_000


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of the .tif and .tiff files of a folder; no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*").load(path).select("path")
    return files.where(F.lower("path").rlike(r"\.tiff?$"))


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def read_headers(files: DataFrame, band: int = 0) -> DataFrame:
    """HEADERS' columns of each file, read by the executors."""

    def kernel(batches):
        import pyarrow as pa
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                h = gt._with_band(gt.read_header(_local(p)), band)
                rows.append((h.path, h.x0, h.y0, h.dx, h.dy, h.srid, h.width, h.height, h.spark_type().simpleString(), pickle.dumps(h.__dict__)))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    import pyarrow as pa
    names = [c.split()[0] for c in HEADERS.split(", ")]
    of = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
    types = [of[c.split()[1]] for c in HEADERS.split(", ")]
    return files.mapInArrow(kernel, HEADERS)


def mosaic(headers: DataFrame, path: str):
    """One row of facts about all files: x0, y0, dx, dy, srid, cols, rows, kind, cells,
    files. Files of another cell size, srid or type raise, and files whose origins are
    not whole cells apart; ``headers`` come back with the offsets ox, oy."""
    f = headers.agg(
        F.min("x0").alias("x0"), F.max("y0").alias("y0"), F.min("dx").alias("dx"), F.min("dy").alias("dy"), F.min("srid").alias("srid"), F.min("kind").alias("kind"),
        F.count_distinct("dx", "dy", "srid").alias("grids"), F.count_distinct("kind").alias("kinds"), F.count(F.lit(1)).alias("files"),
        F.sum(F.col("width").cast("bigint") * F.col("height")).alias("cells")).first()
    if not f.files:
        raise ValueError(f"no GeoTIFF files at {path}")
    if f.grids > 1 or f.kinds > 1:
        raise ValueError(f"{path}: cell size, srid or cell type differs between files")
    sx, sy = (F.col("x0") - f.x0) / f.dx, (f.y0 - F.col("y0")) / f.dy
    placed = headers.select("*", sx.alias("sx"), sy.alias("sy"), F.round(sx).cast("int").alias("ox"), F.round(sy).cast("int").alias("oy"))
    size = placed.agg(F.max(F.col("ox") + F.col("width")).alias("cols"), F.max(F.col("oy") + F.col("height")).alias("rows"),
                      F.max(F.greatest(F.abs(F.col("sx") - F.col("ox")), F.abs(F.col("sy") - F.col("oy")))).alias("off"),
                      F.max_by("path", F.greatest(F.abs(F.col("sx") - F.col("ox")), F.abs(F.col("sy") - F.col("oy")))).alias("path")).first()
    if size.off > 1e-3:
        raise ValueError(f"{size.path}: its origin is not a whole number of cells from the mosaic's")
    _check_overlap(placed, max(1, math.isqrt(f.cells // f.files)))
    return {**f.asDict(), "cols": size.cols, "rows": size.rows}, placed.drop("sx", "sy")


def _check_overlap(placed: DataFrame, cell: int) -> None:
    """Files must not share cells: rectangles that meet in a square of a coarse grid, as
    wide as a file is on average, are compared."""
    last = {"gx": F.col("ox") + F.col("width") - 1, "gy": F.col("oy") + F.col("height") - 1}
    r = placed.select("path", "ox", "oy", "width", "height", last["gx"].alias("x1"), last["gy"].alias("y1"))
    for g, lo, hi in (("gx", "ox", "x1"), ("gy", "oy", "y1")):
        r = r.withColumn(g, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    a, b = r, r.select([F.col(c).alias(c if c in ("gx", "gy") else f"b_{c}") for c in r.columns])
    meet = a.join(b, ["gx", "gy"]).where("path < b_path AND ox <= b_x1 AND b_ox <= x1 AND oy <= b_y1 AND b_oy <= y1")
    for m in meet.select("path", "b_path").take(1):
        raise ValueError(f"{m.path} and {m.b_path} overlap")


def _groups(placed: DataFrame, form: str, chunk: int | None, max_tile: int | None, target: int, box) -> DataFrame:
    """``(path, grp, plan)``: groups of about ``target`` cells of each file's windows."""

    def kernel(batches) -> Iterator:
        import pyarrow as pa
        reader = gt.WindowFilter(form, chunk, box)
        for b in batches:
            for header, ox, oy in zip(b.column("header").to_pylist(), b.column("ox").to_pylist(), b.column("oy").to_pylist()):
                h = gt.TiffHeader(**pickle.loads(header))
                for k, group in enumerate(gt.window_groups(h, chunk, max_tile, target, lambda w: reader.keep(w, ox, oy))):
                    plan = pickle.dumps((gt._slim(h, group).__dict__, group, ox, oy))
                    yield pa.RecordBatch.from_arrays([pa.array([h.path]), pa.array([k], pa.int64()), pa.array([plan], pa.binary())],
                                                     names=["path", "grp", "plan"])

    return placed.select("header", "ox", "oy").mapInArrow(kernel, "path string, grp long, plan binary")


def read_mosaic(spark: SparkSession, path: str, name: str | None = None, chunk: int | None = None, max_tile: int | None = None,
                form: str = "cells", band: int = 0, tile_size: int | None = None, box=None, target: int = gt.TARGET_CELLS_PER_PARTITION):
    """A folder of GeoTIFF files as a ``Layer``, a windows DataFrame (``form`` 'windows'
    or 'grid'), or a ``(TileLayer, LayerMeta)`` (``form`` 'tiles').

    ``box`` = (xmin, xmax, ymin, ymax) skips windows outside those cells.
    """
    headers = read_headers(list_files(spark, path), band)
    facts, placed = mosaic(headers, path)
    cut = tile_size if form == "tiles" else chunk
    if form == "tiles":
        n = tile_size
        off = placed.where((F.col("ox") % n != 0) | (F.col("oy") % n != 0)
                           | ((F.col("width") % n != 0) & (F.col("ox") + F.col("width") != facts["cols"]))
                           | ((F.col("height") % n != 0) & (F.col("oy") + F.col("height") != facts["rows"]))).select("path").take(1)
        if off:
            raise ValueError(f"{off[0].path}: its origin or size splits a {n}-cell tile")
    tasks = min(MAX_TASKS, max(default_parallelism(spark), -(-facts["cells"] // target)))
    target = max(1, min(target, -(-facts["cells"] // tasks)))
    plans = _groups(placed, form, cut, max_tile, target, box).repartition(int(tasks), "path", "grp")

    def kernel(batches):
        for b in batches:
            for plan in b.column("plan").to_pylist():
                header, *rest = pickle.loads(plan)
                yield from gt.read_group(gt.WindowGroup(header["path"], gt.TiffHeader(**header), *rest), form, cut)

    v = facts["kind"]
    schema = {"cells": f"x int, y int, v {v}", "tiles": f"tc int, tr int, t array<{v}>", "grid": "path string, win_x int, win_y int, cols int, rows int",
              "windows": f"path string, win_x int, win_y int, cols int, rows int, t array<{v}>"}[form]
    df = plans.select("plan").mapInArrow(kernel, schema)
    if form in ("windows", "grid"):
        return df
    name = name or path.rstrip("/").split("/")[-1]
    georef = Georef(*(facts[k] for k in ("x0", "y0", "dx", "dy", "srid")))
    cols, rows = facts["cols"], facts["rows"]
    if form == "tiles":
        return TileLayer(df, tile_size, name, georef, extent=(0, cols - 1, 0, rows - 1)), LayerMeta.from_dims(cols, rows)
    return Layer(df, name, georef, (cols, rows))
