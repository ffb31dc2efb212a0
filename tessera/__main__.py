"""Command line: run one of the catalog-driven jobs and write its result.

    python -m tessera count    --raster glc=/data/glc.tif:16:1 --out /out/count
    python -m tessera reclass  --raster glc=/data/glc.tif:16:1 --out /out/reclass
    python -m tessera add      --raster glc=/data/glc.tif:16:1 --out /out/add
    python -m tessera focal    --raster glc=/data/glc.tif:16:1 --tile-sizes 25,50 --out /out/focal
    python -m tessera zonal    --raster nlcd=/data/nlcd.tif:21:1:5070 \\
                               --vector states=/shapes:states_2.geojson --out /out/zonal
    python -m tessera tiling   --raster glc=/data/glc.tif:16:1 --tile-size 300 --out /out/tiles

Rasters are ``name=path:pixel_value:new_pixel[:srid]`` (GeoTIFF or parquet
cell table), vectors ``name=base_path:file[:srid]``. Results are CSV with a
header (tiling writes its text reports). Under ``spark-submit`` the submitted
session is taken as it is (master, partitions, memory); else a local one is
started.
"""

from __future__ import annotations

import argparse
import sys

from .sources.catalog import RasterRecord, VectorRecord
from .operators.sweep import parse_sizes


def _trailing_ints(parts: list[str], most: int) -> int:
    """How many of the last fields (at most ``most``) are integers."""
    k = 0
    while k < most and k < len(parts) - 1 and parts[-1 - k].lstrip("-").isdigit():
        k += 1
    return k


def _raster(spec: str) -> RasterRecord:
    """``name=path:pixel_value:new_pixel[:srid]``; the path may contain ':'."""
    name, rest = spec.split("=", 1)
    parts = rest.split(":")
    k = _trailing_ints(parts, 3)
    if k < 2:
        raise argparse.ArgumentTypeError(f"raster spec needs path:pixel:new[:srid]: {spec!r}")
    nums = [int(x) for x in parts[len(parts) - k:]]
    path = ":".join(parts[:len(parts) - k])
    return RasterRecord(name, path, nums[0], nums[1], nums[2] if k == 3 else 4326)


def _vector(spec: str) -> VectorRecord:
    """``name=base_path:file[:srid]``; the base path may contain ':'."""
    name, rest = spec.split("=", 1)
    parts = rest.split(":")
    srid = 4326
    if _trailing_ints(parts, 1) == 1 and len(parts) >= 3:
        srid = int(parts.pop())
    if len(parts) < 2:
        raise argparse.ArgumentTypeError(f"vector spec needs base_path:file[:srid]: {spec!r}")
    return VectorRecord(name, ":".join(parts[:-1]), parts[-1], srid)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="tessera", description=__doc__.split("\n\n")[0])
    ap.add_argument("job", choices=["count", "reclass", "add", "focal", "zonal", "tiling"])
    ap.add_argument("--raster", action="append", required=True, type=_raster,
                    help="name=path:pixel_value:new_pixel[:srid] (GeoTIFF or parquet cells); repeatable")
    ap.add_argument("--vector", action="append", default=[], type=_vector,
                    help="name=base_path:file[:srid]; the file is read from base_path/<raster srid>/file")
    ap.add_argument("--tile-sizes", default=None, help="comma-separated layout tile sizes")
    ap.add_argument("--tile-size", type=int, default=300, help="tile size of the tiling report")
    ap.add_argument("--edge", choices=["tile", "halo"], default="tile")
    ap.add_argument("--lines", action="store_true", help="vector files hold one GeoJSON Feature per line")
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)

    from . import sinks
    from .plans import jobs
    from .session import get_spark

    spark = get_spark()
    sizes = parse_sizes(a.tile_sizes)
    if a.job == "tiling":
        counts = jobs.tiling_report_job(spark, a.raster[0], a.out, a.tile_size)
        print(counts)
        return 0
    if a.job == "count":
        df = jobs.count_pixels_job(spark, a.raster, sizes)
    elif a.job == "reclass":
        df = jobs.reclassify_job(spark, a.raster)
    elif a.job == "add":
        df = jobs.raster_add_job(spark, a.raster)
    elif a.job == "focal":
        df = jobs.focal_job(spark, a.raster, sizes, edge=a.edge)
    else:
        if not a.vector:
            ap.error("zonal needs at least one --vector")
        df = jobs.zonal_job(spark, a.raster, a.vector, a.lines)
    sinks.write_csv(df, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
