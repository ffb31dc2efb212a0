"""Cells are neither lost nor altered outside the fixtures' narrow grid."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF0001, SF001
from tessera.functions import geometry as geo
from tessera.layer import Georef, Layer, TileLayer
from tessera.operators import focal, layout, local, zonal
from tessera.plans import jobs, queries
from tessera.sources import geotiff as gt
from tessera.sources.catalog import RasterRecord, VectorRecord
from tessera.sources.geojson import ZoneSet, read_zones
from tessera.sources.grids import grid_a
from tessera import session, sinks
from tiff_writer import write_tiff


def cells(spark, rows, kind="int", georef=None):
    return Layer(spark.createDataFrame(rows, f"x int, y int, v {kind}"), "t", georef or Georef.pixel(4326))


def geojson(path, features):
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": [
            {"type": "Feature", "id": i, "properties": {"NAME": i, "ID": 1}, "geometry": g} for i, g in features]}, f)
    return str(path)


def box(x0, y0, x1, y1):
    return [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]


# ---------------------------------------------------------------- tiles

def test_to_cells_inverts_to_tiles_anywhere(spark):
    rows = [(x, y, None if (x + y) % 5 == 0 else x * y) for x in range(-7, 6) for y in range(-3, 9)]
    for n in (4, 5, 16):
        back = cells(spark, rows).to_tiles(n).to_cells().df.collect()
        assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


def test_repeated_cells_raise(spark):
    with pytest.raises(Exception, match="more than once"):
        cells(spark, [(0, 0, 1), (0, 0, 2), (1, 1, 3)]).to_tiles(2).df.collect()
    twice = cells(spark, [(0, 0, 1), (0, 0, 2)])
    with pytest.raises(Exception, match="more than once"):
        local.add_n([twice, cells(spark, [(0, 0, 5)])]).df.collect()
    missing = local.add_n([twice, cells(spark, [(9, 9, 5)])])  # two rows of one raster are not two rasters
    assert missing.df.collect() == []


def test_tile_layer_without_extent_asks_for_it(spark):
    tiles = cells(spark, [(0, 0, 1)]).to_tiles(2).df
    with pytest.raises(ValueError, match="extent"):
        TileLayer(tiles, 2).to_cells()
    assert TileLayer(tiles, 2, extent=(0, 0, 0, 0)).to_cells().df.count() == 1


def test_layout_reports_do_not_assemble_tiles(spark):
    for name in ("tile_dimensions", "tile_extent", "tile_extent_text"):
        plan = queries.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan, name


# ---------------------------------------------------------------- GeoTIFF

@pytest.mark.parametrize("kind, nodata, values, gone", [
    ("uint8", "-9999", [241, 0, 255], []), ("int32", "nan", [-2147483648, 5], []), ("int16", "1.5", [1, 2], []), ("uint8", "241", [241, 7], [241]),
    ("float64", "-9999", [-9999.05, -9998.95, -9999.0], [-9999.0]), ("int64", "7", [2**40 + 7, -2**50, 7], [7]),
    ("uint64", "18446744073709551615", [2**63 + 5, 2**64 - 1], [2**64 - 1]), ("float32", "-3.4028234663852886e+38", [np.float32(-3.4028235e38), 1.5], [np.float32(-3.4028235e38)])])
def test_nodata_marks_its_own_value_only(spark, tmp_path, kind, nodata, values, gone):
    a = np.array([values], kind)
    path = write_tiff(f"{tmp_path}/a.tif", a, nodata=nodata)
    got = [r.v for r in gt.read_geotiff(spark, path).df.orderBy("x").collect()]
    want = [None if v in gone else v for v in a[0].tolist()]
    assert [None if g is None else (float(g) if a.dtype.kind == "f" else int(g)) for g in got] == want


def test_mosaic_overlap_and_broken_grid_raise(spark, tmp_path):
    a = np.ones((4, 4), "int32")
    for name, x0 in (("one", 0.0), ("two", 2.0), ("three", 50.4)):
        os.makedirs(f"{tmp_path}/{name}")
        write_tiff(f"{tmp_path}/{name}/a.tif", a, georef=(0.0, 0.0, 1.0, 1.0))
        write_tiff(f"{tmp_path}/{name}/b.tif", a, georef=(x0, 0.0, 1.0, 1.0))
    for name, message in (("one", "overlap"), ("two", "overlap"), ("three", "whole number")):
        with pytest.raises(Exception, match=message):
            gt.read_geotiff(spark, f"{tmp_path}/{name}").df.count()


def test_window_report_reads_headers_only(spark, tmp_path, monkeypatch):
    path = write_tiff(f"{tmp_path}/a.tif", np.arange(600, dtype="int32").reshape(20, 30))
    with open(path, "r+b") as f:  # unreadable pixels
        f.seek(8)
        f.write(b"\xff" * 16)
    grid = gt.read_geotiff(spark, path, form="grid", chunk=7)
    assert "t" not in grid.columns and grid.count() == 5 * 3
    assert grid.selectExpr("sum(cols * rows) AS n").first().n == 600


# ---------------------------------------------------------------- zones

def test_cells_below_zero_count(spark, tmp_path):
    raster = cells(spark, [(x, y, 1) for x in range(-4, 4) for y in range(-4, 4)])
    zones = read_zones(spark, geojson(tmp_path / "z.json", [("z", {"type": "Polygon", "coordinates": box(-4, -4, 4, 4)})]))
    assert [r.n for r in zonal.histogram(raster, zones).collect()] == [64]
    assert [r.n for r in zonal.histogram_tiles(raster.to_tiles(3), zones).collect()] == [64]


def test_overlapping_parts_keep_their_cells(spark, tmp_path):
    parts = {"type": "MultiPolygon", "coordinates": [box(0, 0, 6, 6), box(3, 3, 9, 9), box(20, 0, 22, 2)]}
    zones = read_zones(spark, geojson(tmp_path / "z.json", [("z", parts)]))
    raster = cells(spark, [(x, y, 1) for x in range(30) for y in range(12)])
    assert [r.n for r in zonal.histogram(raster, zones).collect()] == [36 + 36 - 9 + 4]
    edges = geo.zone_edges(zones.df, raster.georef.col_of, raster.georef.row_of)
    assert geo.parity_inside(raster.df, edges).count() == 67


@pytest.mark.parametrize("text", [
    '{"type": "FeatureCollection", "features": [{"type": "Fea', '{"type": "FeatureCollection", "features": [{"id": "a", "properties": {"NAME": "a", "ID": 99999999999}, "geometry": null}]}',
    '{"type": "FeatureCollection", "features": [{"id": "a", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[["x", 1], [2, 3], [4, 5]]]}}]}',
    '{"type": "FeatureCollection", "features": [{"id": "a", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[1], [2, 3], [4, 5]]]}}]}'])
def test_broken_zone_files_raise(spark, tmp_path, text):
    path = tmp_path / "z.json"
    path.write_text(text)
    with pytest.raises(Exception):
        read_zones(spark, str(path)).df.collect()


def hand_zones(spark, ids):
    z = spark.createDataFrame([("s", i, i, 1, "Polygon") for i in ids], "zone_set string, zone_id string, name string, zid int, geom_type string")
    z = z.select(F.xxhash64("zone_set", "zone_id").alias("zk"), "*", F.lit(None).cast("array<array<array<array<double>>>>").alias("geom"))
    return ZoneSet(z, "s", 4326)


def test_huge_histograms_do_not_overflow(spark):
    hist = [("s", "a", 2_000_000_000, 5 * 10**9), ("s", "a", -2_000_000_000, 5 * 10**9), ("s", "b", -2147483648, 3), ("s", "b", 2147483647, 3), ("s", "b", 5, 1),
            ("s", "c", 4_000_000_000, 10**13)]
    table = spark.createDataFrame(hist, "zone_set string, zone_id string, v bigint, n bigint")
    got = {r.zone_id: r for r in zonal.statistics_from_histogram(table, hand_zones(spark, "abcd")).collect()}
    assert (got["a"].n, got["a"].mean, got["a"].stddev, got["a"].median) == (10**10, 0.0, 2e9, 0.0)
    assert (got["b"].mode, got["b"].median) == (-2147483648, 5.0)
    assert got["b"].stddev == pytest.approx(np.std([-2147483648] * 3 + [2147483647] * 3 + [5]), rel=1e-12)
    assert (got["c"].mean, got["c"].stddev) == (4e9, 0.0) and got["d"].n == 0 and got["d"].stddev is None


def test_mode_of_the_smallest_int(spark, tmp_path):
    zones = read_zones(spark, geojson(tmp_path / "z.json", [("z", {"type": "Polygon", "coordinates": box(0, 0, 9, 1)})]))
    raster = cells(spark, [(0, 0, -2147483648), (1, 0, -2147483648), (2, 0, 4), (3, 0, 4), (4, 0, 2147483647)])
    r = zonal.statistics(raster, zones).first()
    assert (r.mode, r.n, r.median) == (-2147483648, 5, 4.0)


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_float_median_is_exact(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.standard_normal(n), 2) * 10.0 ** rng.integers(-5, 5)
    zones = read_zones(spark, geojson(tmp_path / "z.json", [("z", {"type": "Polygon", "coordinates": box(0, 0, n, 1)})]))
    r = zonal.statistics(cells(spark, [(i, 0, float(x)) for i, x in enumerate(v)], "double"), zones).first()
    assert r.median == float(np.median(v)) and r.n == n


@pytest.mark.parametrize("name", ["zonal_histogram_shuffle", "zonal_histogram_tiles_shuffle"])
def test_shuffle_branch_has_no_broadcast_of_runs(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") <= 1  # the zones' names, of a checked count
    assert "SortMergeJoin" in plan


# ---------------------------------------------------------------- add, focal

def test_add_aligns_grids(spark):
    a = cells(spark, [(x, y, 10 * x + y) for x in range(4) for y in range(4)], georef=Georef(0, 0, 1, 1))
    b = cells(spark, [(x, y, 100) for x in range(4) for y in range(4)], georef=Georef(2, -1, 1, 1))
    want = {(x, y): 10 * x + y + 100 for x in (2, 3) for y in (1, 2, 3)}
    assert {(r.x, r.y): r.v for r in local.add(a, b).df.collect()} == want
    assert {(r.x, r.y): r.v for r in local.add_n([a, b]).df.collect()} == want
    even = cells(spark, [(x, y, 100) for x in range(4) for y in range(4)], georef=Georef(2, -2, 1, 1))
    tiles = local.add_tiles(a.to_tiles(2), even.to_tiles(2)).to_cells().df
    assert {(r.x, r.y): r.v for r in tiles.collect()} == {(x, y): 10 * x + y + 100 for x in (2, 3) for y in (2, 3)}
    for other in (Georef(0.5, 0, 1, 1), Georef(0, 0, 2, 1), Georef(0, 0, 1, 1, 5070)):
        with pytest.raises(ValueError):
            local.add(a, cells(spark, [(0, 0, 1)], georef=other))


def test_sums_have_room(spark):
    a, c = cells(spark, [(0, 0, 2_000_000_000)]), cells(spark, [(0, 0, 0.75)], "double")
    assert local.add(a, a).df.first().v == 4_000_000_000
    assert local.add_n([a, a, a]).df.first().v == 6_000_000_000
    assert local.add_n([a, c]).df.first().v == local.add(a, c).df.first().v == 2_000_000_000.75


def test_focal_counts_beyond_int(spark):
    raster = cells(spark, [(0, 0, 1e18), (1, 0, -1e300), (2, 0, 16.9), (3, 0, -0.5), (4, 0, -16.9)], "double")
    assert [focal.count_truncated(raster, a).first().n for a in (16, 0, -16, 17)] == [1, 1, 1, 0]


# ---------------------------------------------------------------- sessions, jobs

def test_submitted_session_is_taken_as_it_is(tmp_path):
    script = tmp_path / "job.py"
    script.write_text("from tessera.session import get_spark\ns = get_spark()\n"
                      "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.sparkContext.appName)\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import pyspark
    submit = os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit")
    got = subprocess.run([submit, "--master", "local[2]", "--name", "mine", "--conf", "spark.sql.shuffle.partitions=777", "--conf", "spark.ui.enabled=false", str(script)],
                         env={**os.environ, "PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable, "PYSPARK_DRIVER_PYTHON": sys.executable}, capture_output=True, text=True, timeout=180)
    assert "GOT local[2] 777 mine" in got.stdout, got.stderr[-2000:]


def test_no_checkpoint_folder_is_made_up_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_zonal_job_on_a_stored_parquet_raster(spark, tmp_path):
    a = grid_a(spark, SF0001)
    sinks.save_cells(a, f"{tmp_path}/cells")
    a.df.write.parquet(f"{tmp_path}/bare")
    os.makedirs(f"{tmp_path}/v/4326")
    geojson(tmp_path / "v/4326/z.json", [("z", {"type": "Polygon", "coordinates": box(-180, 89, -175, 90)})])
    vectors = [VectorRecord("v", f"{tmp_path}/v", "z.json", 4326)]
    assert jobs.zonal_job(spark, [RasterRecord("a", f"{tmp_path}/cells", 16, 1, 4326)], vectors).first().n > 0
    with pytest.raises(ValueError, match="georeference"):
        jobs.zonal_job(spark, [RasterRecord("a", f"{tmp_path}/bare", 16, 1, 4326)], vectors)
