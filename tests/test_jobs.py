"""Catalog-driven jobs on GeoTIFF and parquet inputs written by the test."""

import json
import os

import numpy as np

from paths import SF0001
from tessera.operators import focal, local, zonal
from tessera.plans import jobs
from tessera.plans.queries import ZONES_PATH, fixture_zones, zonal_grid
from tessera.sources.catalog import RasterRecord, VectorRecord
from tessera.sources.grids import grid_a
from tiff_writer import write_tiff


def _grid_a_tiff(spark, path):
    pdf = grid_a(spark, SF0001).df.toPandas()
    g = np.full((15, 100), -1, dtype=np.int32)
    g[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["v"].fillna(-1).astype(np.int32).to_numpy()
    # pixel georeference so the fixture zones (cell units) apply unchanged
    return write_tiff(path, g, tile=16, deflate=True, nodata=-1, georef=(0.0, 0.0, 1.0, -1.0))


def test_jobs_on_geotiff_and_parquet(spark, scratch):
    tif = _grid_a_tiff(spark, f"{scratch}/glc.tif")
    grid_a(spark, SF0001).df.write.parquet(f"{scratch}/glc_cells")
    rasters = [RasterRecord("glc", tif, 16, 1), RasterRecord("glc_cells", f"{scratch}/glc_cells", 16, 1)]

    c = {(r.dataset, r.tile_size): r.n_value for r in jobs.count_pixels_job(spark, rasters, (25, 50)).collect()}
    assert set(c.values()) == {66} and len(c) == 4

    rc = {r.dataset: (r.n_new, r.n_back) for r in jobs.reclassify_job(spark, rasters).collect()}
    assert rc == {"glc": (66, 66), "glc_cells": (66, 66)}

    ad = {r.dataset: r.n for r in jobs.raster_add_job(spark, rasters).collect()}
    assert ad == {"glc": 66, "glc_cells": 66}

    f = {(r.dataset, r.tile_size): r.n for r in jobs.focal_job(spark, rasters, (25,)).collect()}
    want = focal.count_truncated(focal.focal_mean(grid_a(spark, SF0001), 1, "tile", tile_size=25), 16).first().n
    assert f == {("glc", 25): want, ("glc_cells", 25): want}


def test_zonal_job_picks_vector_copy_by_srid(spark, scratch):
    tif = _grid_a_tiff(spark, f"{scratch}/glc.tif")
    base = f"{scratch}/shapes"
    os.makedirs(f"{base}/4326")
    with open(ZONES_PATH) as src, open(f"{base}/4326/zones.geojson", "w") as dst:
        dst.write(src.read())
    with open(f"{base}/4326/other.geojson", "w") as dst:
        json.dump({"type": "FeatureCollection", "features": [
            {"type": "Feature", "id": "q", "properties": {"NAME": "q", "ID": 9},
             "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}}]}, dst)
    out = jobs.zonal_job(spark, [RasterRecord("glc", tif, 16, 1)],
                         [VectorRecord("zones", base, "zones.geojson"), VectorRecord("other", base, "other.geojson")])
    got = {(r.zone_set, r.zone_id): r.n for r in out.collect()}
    ref = {r.zone_id: r.n for r in zonal.statistics(zonal_grid(spark, SF0001), fixture_zones(spark)).collect()}
    assert got[("zones", "p1")] == ref["p1"] and got[("zones", "m1")] == ref["m1"]
    assert got[("zones", "p0")] == 0
    assert got[("other", "q")] == grid_a(spark, SF0001).df.where("x < 10 and y < 10 and v is not null").count()


def test_tiling_report_job(spark, scratch):
    tif = _grid_a_tiff(spark, f"{scratch}/glc.tif")
    counts = jobs.tiling_report_job(spark, RasterRecord("glc", tif, 16, 1), f"{scratch}/rep", tile_size=30)
    assert counts == {"layout_extent_size": 4, "chunk_dims": 4, "chunk_size": 4,
                      "max_tile_dims": 4, "max_tile_size": 4}
    lines = sorted(r.value for r in spark.read.text(f"{scratch}/rep/chunk_dims").collect())
    assert lines == ["10,15", "30,15", "30,15", "30,15"]


def test_command_line(spark, scratch):
    from tessera.__main__ import _raster, _vector, main
    r = _raster("glc=s3://bucket/glc.tif:16:1:5070")
    assert (r.name, r.path, r.pixel_value, r.new_pixel, r.srid) == ("glc", "s3://bucket/glc.tif", 16, 1, 5070)
    assert _raster("g=/d/x.tif:16:1").srid == 4326
    v = _vector("states=s3://b/shapes:states_2.geojson")
    assert (v.base_path, v.file, v.srid) == ("s3://b/shapes", "states_2.geojson", 4326)
    tif = _grid_a_tiff(spark, f"{scratch}/glc.tif")
    assert main(["count", "--raster", f"glc={tif}:16:1", "--tile-sizes", "25,50", "--out", f"{scratch}/c"]) == 0
    rows = spark.read.option("header", True).csv(f"{scratch}/c").collect()
    assert {(r.tile_size, r.n_value) for r in rows} == {("25", "66"), ("50", "66")}
    base = f"{scratch}/shapes"
    os.makedirs(f"{base}/4326")
    with open(ZONES_PATH) as src, open(f"{base}/4326/zones.geojson", "w") as dst:
        dst.write(src.read())
    assert main(["zonal", "--raster", f"glc={tif}:16:1", "--vector", f"zones={base}:zones.geojson",
                 "--out", f"{scratch}/z"]) == 0
    z = {r.zone_id: r.n for r in spark.read.option("header", True).csv(f"{scratch}/z").collect()}
    assert z["p0"] == "0" and int(z["p1"]) > 0
