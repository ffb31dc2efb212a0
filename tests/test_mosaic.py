"""Folders of GeoTIFF files, planned in the executors; strips cut by rows."""

import os

import numpy as np
import pytest

from tessera.operators import local
from tessera.sources import geotiff as gt
from tessera.sources import mosaic
from tiff_writer import write_tiff


def cells(layer):
    return {(r.x, r.y): r.v for r in layer.df.collect()}


@pytest.fixture()
def folder(tmp_path):
    """A 40 x 24 raster as 20 files of 8 x 6 cells, and files that are no rasters."""
    a = np.random.default_rng(3).integers(0, 50, (24, 40)).astype("int16")
    for r in range(4):
        for c in range(5):
            write_tiff(f"{tmp_path}/f{r}{c}.{'tif' if c % 2 else 'TIFF'}", a[r * 6:r * 6 + 6, c * 8:c * 8 + 8], nodata=0,
                       georef=(100.0 + c * 8 * 0.5, 50.0 - r * 6 * 0.5, 0.5, 0.5), epsg=5070, rows_per_strip=4)
    (tmp_path / "notes.txt").write_text("not a raster")
    return str(tmp_path), a


def want(a):
    return {(x, y): None if a[y, x] == 0 else int(a[y, x]) for y in range(a.shape[0]) for x in range(a.shape[1])}


def test_folder_equals_the_raster(spark, folder):
    path, a = folder
    layer = gt.read_geotiff(spark, path)
    assert cells(layer) == want(a) and layer.dims == (40, 24)
    assert (layer.georef.x0, layer.georef.y0, layer.georef.dx, layer.georef.srid) == (100.0, 50.0, 0.5, 5070)
    assert local.count_value(layer, 7).first().n == int((a == 7).sum())


@pytest.mark.parametrize("form", ["windows", "grid"])
@pytest.mark.parametrize("kw, size", [(dict(chunk=5), 5), (dict(max_tile=6), 6), (dict(max_tile=9), 9)])
def test_windows_of_a_folder(spark, folder, form, kw, size):
    path, a = folder
    rows = gt.read_geotiff(spark, path, form=form, **kw).collect()
    grid = sorted((x + c, y + r, min(size, 8 - c), min(size, 6 - r)) for x in range(0, 40, 8) for y in range(0, 24, 6)
                  for c in range(0, 8, size) for r in range(0, 6, size))
    assert sorted((w.win_x, w.win_y, w.cols, w.rows) for w in rows) == grid
    if form == "windows":
        for w in rows:
            own = a[w.win_y:w.win_y + w.rows, w.win_x:w.win_x + w.cols].ravel().tolist()
            assert w.t == [v or None for v in own]


def test_tiles_of_a_folder(spark, folder):
    path, a = folder
    tiles, meta = gt.read_geotiff_tiles(spark, path, 2)
    assert (meta.cols, meta.rows) == (40, 24) and cells(tiles.to_cells()) == want(a)
    with pytest.raises(ValueError, match="splits"):
        gt.read_geotiff_tiles(spark, path, 5)


def test_box_skips_windows(spark, folder):
    path, a = folder
    layer = mosaic.read_mosaic(spark, path, chunk=4, box=(9, 17, 3, 7))
    got = cells(layer)
    assert {k: v for k, v in want(a).items() if 9 <= k[0] <= 17 and 3 <= k[1] <= 7}.items() <= got.items() <= want(a).items()
    assert len(got) < a.size / 3


def test_driver_reads_no_header_of_a_folder(spark, folder, monkeypatch):
    path, a = folder
    here, read = [], gt.read_header  # a worker's copy of the list is its own

    def counted(p):
        here.append(p)
        return read(p)

    monkeypatch.setattr(gt, "read_header", counted)
    assert cells(gt.read_geotiff(spark, path)) == want(a) and here == []
    gt.read_header(f"{path}/f00.TIFF")
    assert len(here) == 1


def test_broken_folders_raise(spark, tmp_path):
    a = np.ones((4, 4), "int32")
    cases = {"overlap": (2.0, 1.0, "int32"), "apart": (50.4, 1.0, "int32"), "size": (8.0, 2.0, "int32"), "type": (8.0, 1.0, "float32")}
    message = {"overlap": "overlap", "apart": "whole number", "size": "differs", "type": "differs"}
    for name, (x0, d, kind) in cases.items():
        os.makedirs(f"{tmp_path}/{name}")
        write_tiff(f"{tmp_path}/{name}/a.tif", a, georef=(0.0, 0.0, 1.0, 1.0))
        write_tiff(f"{tmp_path}/{name}/b.tif", a.astype(kind), georef=(x0, 0.0, d, d))
        with pytest.raises(ValueError, match=message[name]):
            gt.read_geotiff(spark, f"{tmp_path}/{name}")
    os.makedirs(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no GeoTIFF"):
        gt.read_geotiff(spark, f"{tmp_path}/none")


def test_overlap_of_files_of_many_sizes(spark, tmp_path):
    """One large file and many small ones around it; then one small one inside it."""
    write_tiff(f"{tmp_path}/large.tif", np.ones((40, 40), "uint8"), georef=(0.0, 0.0, 1.0, 1.0))
    for k in range(30):
        write_tiff(f"{tmp_path}/s{k}.tif", np.full((2, 2), 2, "uint8"), georef=(40.0 + 2 * (k % 6), -2.0 * (k // 6), 1.0, 1.0))
    layer = gt.read_geotiff(spark, str(tmp_path))
    assert layer.df.count() == 1600 + 120
    write_tiff(f"{tmp_path}/t.tif", np.ones((1, 1), "uint8"), georef=(39.0, -39.0, 1.0, 1.0))
    with pytest.raises(ValueError, match="overlap"):
        gt.read_geotiff(spark, str(tmp_path))


@pytest.mark.parametrize("kw", [dict(rows_per_strip=1000), dict(rows_per_strip=30), dict(rows_per_strip=7), dict(rows_per_strip=1000, predictor=2)])
def test_uncompressed_strips_are_cut_by_rows(spark, tmp_path, monkeypatch, kw):
    a = np.random.default_rng(1).integers(0, 999, (101, 20)).astype("int32")
    path = write_tiff(f"{tmp_path}/a.tif", a, **kw)
    whole = gt.read_header(path)
    cut = gt._cut_strips(gt.read_header(path), 100)
    assert cut.width * cut.seg_h <= 100 < whole.width * whole.seg_h and sum(cut.counts) == sum(whole.counts)
    with gt._open(path) as f:
        for win in ((0, 0, 20, 101), (3, 17, 9, 40), (0, 100, 20, 1)):
            x, y, w, r = win
            assert (gt.read_window(f, cut, win, gt.SegmentCache()) == a[y:y + r, x:x + w]).all()
    assert len(list(gt.window_groups(cut, None, None, 200, lambda w: True))) >= 1


def test_one_strip_serves_many_tasks(spark, tmp_path):
    a = np.arange(3000 * 1000, dtype="int32").reshape(3000, 1000) % 97
    path = write_tiff(f"{tmp_path}/one.tif", a.astype("int16"), rows_per_strip=3000)
    layer = gt.read_geotiff(spark, path)
    assert layer.df.rdd.getNumPartitions() >= 3
    assert local.count_value(layer, 5).first().n == int((a == 5).sum())


def test_lzw_is_rejected(tmp_path):
    path = write_tiff(f"{tmp_path}/a.tif", np.ones((4, 4), "uint8"), compression=5)
    with pytest.raises(ValueError, match="compression 5"):
        gt.read_header(path)
