"""Windowed GeoTIFF source: encodings, window grids, mosaics, end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF0001
from tessera.operators import focal, local
from tessera.sources import geotiff as gt
from tessera.sources.grids import grid_a
from tiff_writer import write_tiff


def _cells(layer):
    return {(r.x, r.y): r.v for r in layer.df.collect()}


def _expect(a, nodata=None):
    out = {}
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            v = a[y, x].item()
            if (nodata is not None and v == nodata) or (isinstance(v, float) and np.isnan(v)):
                v = None
            out[(x, y)] = v
    return out


@pytest.fixture(scope="module")
def arr():
    rng = np.random.default_rng(7)
    return rng.integers(0, 30, size=(37, 53)).astype(np.int16)


@pytest.mark.parametrize("kw", [
    dict(rows_per_strip=5),
    dict(rows_per_strip=64, deflate=True),
    dict(tile=16, deflate=True, predictor=2),
    dict(tile=16, big_endian=True),
    dict(rows_per_strip=3, deflate=True, predictor=2, big_endian=True),
    dict(tile=16, deflate=True, bigtiff=True),
    dict(rows_per_strip=6, bigtiff=True, big_endian=True),
])
def test_encodings(spark, scratch, arr, kw):
    p = write_tiff(f"{scratch}/a.tif", arr, nodata=0, georef=(10.0, 50.0, 0.5, 0.25), epsg=5070, **kw)
    lay = gt.read_geotiff(spark, p, "a")
    assert _cells(lay) == _expect(arr, nodata=0)
    g = lay.georef
    assert (g.x0, g.y0, g.dx, g.dy, g.srid) == (10.0, 50.0, 0.5, 0.25, 5070)
    assert lay.dims == (53, 37)


@pytest.mark.parametrize("chunk", [7, 16, 100])
def test_chunked_cells_and_windows(spark, scratch, arr, chunk):
    p = write_tiff(f"{scratch}/c.tif", arr, tile=16, deflate=True)
    lay = gt.read_geotiff(spark, p, chunk=chunk)
    assert _cells(lay) == _expect(arr)
    w = gt.read_geotiff(spark, p, chunk=chunk, form="windows")
    rows = w.collect()
    assert sorted((r.win_x, r.win_y, r.cols, r.rows) for r in rows) == sorted(
        gt.window_grid(gt.read_header(p), chunk=chunk))
    assert sum(len(r.t) for r in rows) == arr.size
    r0 = [r for r in rows if r.win_x == 0 and r.win_y == 0][0]
    assert r0.t == arr[:r0.rows, :r0.cols].reshape(-1).tolist()


def test_max_tile(spark, scratch, arr):
    p = write_tiff(f"{scratch}/m.tif", arr, rows_per_strip=4)
    h = gt.read_header(p)
    assert gt.window_grid(h, max_tile=60) == [(0, 0, 53, 37)]
    assert gt.window_grid(h, max_tile=20) == gt.window_grid(h, chunk=20)
    w = gt.read_geotiff(spark, p, max_tile=20, form="windows")
    assert w.agg(F.sum(F.col("cols") * F.col("rows"))).first()[0] == arr.size


def test_float_nan_is_nodata(spark, scratch):
    a = np.arange(20, dtype=np.float32).reshape(4, 5) / 4
    a[1, 2] = np.nan
    p = write_tiff(f"{scratch}/f.tif", a, tile=16)
    got = _cells(gt.read_geotiff(spark, p))
    assert got[(2, 1)] is None and got[(1, 0)] == 0.25 and len(got) == 20


def test_mosaic_of_two_files(spark, scratch, arr):
    d = f"{scratch}/mosaic"
    import os
    os.makedirs(d)
    write_tiff(f"{d}/left.tif", arr[:, :30], georef=(0.0, 10.0, 1.0, 1.0), rows_per_strip=8)
    write_tiff(f"{d}/right.tif", arr[:, 30:], georef=(30.0, 10.0, 1.0, 1.0), tile=16, deflate=True)
    lay = gt.read_geotiff(spark, d)
    assert _cells(lay) == _expect(arr)
    assert lay.dims == (53, 37)


def test_unsupported_compression_raises(spark, scratch, arr):
    p = write_tiff(f"{scratch}/jpeg.tif", arr, compression=7)
    with pytest.raises(ValueError, match="compression 7"):
        gt.read_header(p)


def test_grid_a_as_geotiff_matches_parquet(spark, scratch):
    a = grid_a(spark, SF0001)
    pdf = a.df.toPandas()
    grid = np.full((15, 100), -1, dtype=np.int32)
    v = pdf["v"].fillna(-1).astype(np.int32).to_numpy()
    grid[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = v
    p = write_tiff(f"{scratch}/glc.tif", grid, tile=32, deflate=True, nodata=-1,
                   georef=(-180.0, 90.0, 0.1, 0.1), epsg=4326)
    lay = gt.read_geotiff(spark, p, "A", chunk=25)
    assert local.count_value(lay, 16).first().n == 66
    f1 = focal.focal_mean(lay, 1, "tile", tile_size=25).df
    f2 = focal.focal_mean(a, 1, "tile", tile_size=25).df
    assert f1.exceptAll(f2).count() == 0 and f2.exceptAll(f1).count() == 0


@pytest.mark.parametrize("n,kw", [(16, dict(tile=16, deflate=True)), (10, dict(rows_per_strip=7)),
                                  (25, dict(tile=32))])
def test_tiles_form_equals_retile(spark, scratch, arr, n, kw):
    p = write_tiff(f"{scratch}/t.tif", arr, nodata=0, **kw)
    tl, meta = gt.read_geotiff_tiles(spark, p, n)
    assert (meta.cols, meta.rows) == (53, 37)
    ref = gt.read_geotiff(spark, p).to_tiles(n).df
    got = tl.df
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
    plan = local.count_value_tiles(tl, 5)
    ex = plan._jdf.queryExecution().executedPlan().toString()
    assert ex.count("Exchange") == 1  # only the final single-row aggregate
    want = int((arr == 5).sum())
    assert plan.first().n == want


def test_tiles_form_mosaic_alignment(spark, scratch, arr):
    import os
    d = f"{scratch}/tm"
    os.makedirs(d)
    write_tiff(f"{d}/l.tif", arr[:, :32], georef=(0.0, 10.0, 1.0, 1.0), tile=16)
    write_tiff(f"{d}/r.tif", arr[:, 32:], georef=(32.0, 10.0, 1.0, 1.0), rows_per_strip=5)
    tl, meta = gt.read_geotiff_tiles(spark, d, 16)
    ref = gt.read_geotiff(spark, d).to_tiles(16).df
    assert tl.df.exceptAll(ref).count() == 0 and ref.exceptAll(tl.df).count() == 0
    with pytest.raises(Exception, match="tile grid|splits"):
        gt.read_geotiff_tiles(spark, d, 10)[0].df.count()


def test_window_pruning_with_pushdown(spark, scratch, arr):
    p = write_tiff(f"{scratch}/pr.tif", arr, tile=16, deflate=True)
    key = "spark.sql.python.filterPushdown.enabled"
    prev = spark.conf.get(key, "false")
    try:
        for flag in ("false", "true"):
            spark.conf.set(key, flag)
            gt.register(spark)
            df = (spark.read.format("geotiff").option("chunk", "8").option("cells_per_partition", "1")
                  .option("pushdown", gt._pushdown(spark)).load(p))
            q = df.where((F.col("y") >= 9) & (F.col("y") <= 15) & (F.col("x") < 8))
            got = {(r.x, r.y): r.v for r in q.collect()}
            want = {k: v for k, v in _expect(arr).items() if 9 <= k[1] <= 15 and k[0] < 8}
            assert got == want
            parts = q.rdd.getNumPartitions()
            assert parts == (2 if flag == "true" else 7 * 5)  # windows 8x8 of a 53x37 raster
        tl, _ = gt.read_geotiff_tiles(spark, p, 16)
        assert tl.df.where(F.col("tr") == 1).count() == 4
    finally:
        spark.conf.set(key, prev)


def test_pixel_is_point_and_transform_tag(scratch, arr):
    h = gt.read_header(write_tiff(f"{scratch}/pp.tif", arr, georef=(10.0, 50.0, 2.0, 2.0), pixel_is_point=True,
                                  epsg=32633))
    assert (h.x0, h.y0, h.dx, h.dy, h.srid) == (9.0, 51.0, 2.0, 2.0, 32633)
    m = (0.5, 0.0, 0.0, 100.0, 0.0, -0.25, 0.0, 40.0, 0, 0, 0, 0, 0, 0, 0, 1)
    h2 = gt.read_header(write_tiff(f"{scratch}/mt.tif", arr, transform=m))
    assert (h2.x0, h2.y0, h2.dx, h2.dy) == (100.0, 40.0, 0.5, 0.25)
    rot = (0.5, 0.1, 0.0, 100.0, 0.0, -0.25, 0.0, 40.0, 0, 0, 0, 0, 0, 0, 0, 1)
    with pytest.raises(ValueError, match="rotated"):
        gt.read_header(write_tiff(f"{scratch}/rot.tif", arr, transform=rot))


def test_sparse_segments_read_as_nodata(spark, scratch, arr):
    p = write_tiff(f"{scratch}/sp.tif", arr, tile=16, deflate=True, nodata=0, sparse=(1, 5))
    got = _cells(gt.read_geotiff(spark, p))
    want = _expect(arr, nodata=0)
    for (x, y) in want:
        if (y // 16) * 4 + (x // 16) in (1, 5):  # 4 tiles across a 53-wide raster
            want[(x, y)] = None
    assert got == want


@pytest.mark.parametrize("kind,comp,tile", [("TYPE_BYTE_GRAY", "Deflate", None), ("TYPE_USHORT_GRAY", "Deflate", None),
                                            ("TYPE_BYTE_GRAY", "Deflate", 16), ("TYPE_USHORT_GRAY", "Deflate", 32)])
def test_file_written_by_the_jdk(spark, scratch, kind, comp, tile):
    """Independent encoder: the JDK's TIFF writer (javax.imageio)."""
    jvm, gw = spark._jvm, spark.sparkContext._gateway
    h, w = 37, 61
    rng = np.random.default_rng(11)
    top = 256 if kind == "TYPE_BYTE_GRAY" else 65536
    a = rng.integers(0, 5, size=(h, w)) * (top // 8)
    a[10:20, 5:50] = rng.integers(0, top, size=(10, 45))
    bi = jvm.java.awt.image.BufferedImage
    img = bi(w, h, getattr(bi, kind))
    px = gw.new_array(gw.jvm.int, h * w)
    for i, v in enumerate(a.reshape(-1).tolist()):
        px[i] = int(v)
    img.getRaster().setPixels(0, 0, w, h, px)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
    param.setCompressionType(comp)
    if tile:
        param.setTilingMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
        param.setTiling(tile, tile, 0, 0)
    out = jvm.javax.imageio.stream.FileImageOutputStream(jvm.java.io.File(f"{scratch}/jdk.tif"))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), param)
    out.close()
    hd = gt.read_header(f"{scratch}/jdk.tif")
    assert hd.compression in (8, 32946)
    assert hd.tiled == bool(tile)
    got = _cells(gt.read_geotiff(spark, f"{scratch}/jdk.tif"))
    assert got == {(x, y): int(a[y, x]) for y in range(h) for x in range(w)}


@pytest.mark.parametrize("comp,tile", [("Deflate", None), ("Deflate", 16)])
def test_multiband_interleaved_file_written_by_the_jdk(spark, scratch, comp, tile):
    jvm, gw = spark._jvm, spark.sparkContext._gateway
    h, w = 23, 41
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, size=(h, w, 3))
    bi = jvm.java.awt.image.BufferedImage
    img = bi(w, h, bi.TYPE_3BYTE_BGR)
    px = gw.new_array(gw.jvm.int, h * w * 3)
    for i, v in enumerate(a.reshape(-1).tolist()):
        px[i] = int(v)
    img.getRaster().setPixels(0, 0, w, h, px)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
    param.setCompressionType(comp)
    if tile:
        param.setTilingMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
        param.setTiling(tile, tile, 0, 0)
    out = jvm.javax.imageio.stream.FileImageOutputStream(jvm.java.io.File(f"{scratch}/rgb.tif"))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), param)
    out.close()
    hd = gt.read_header(f"{scratch}/rgb.tif")
    assert (hd.samples, hd.planar) == (3, 1)
    for band in range(3):
        got = _cells(gt.read_geotiff(spark, f"{scratch}/rgb.tif", band=band))
        assert got == {(x, y): int(a[y, x, band]) for y in range(h) for x in range(w)}, band
    with pytest.raises(Exception, match="band 3"):
        gt.read_geotiff(spark, f"{scratch}/rgb.tif", band=3).df.count()


@pytest.mark.parametrize("kw", [dict(rows_per_strip=6), dict(tile=16, deflate=True), dict(tile=32)])
def test_band_separate_file(spark, scratch, arr, kw):
    planes = np.stack([arr, arr * 2 + 1, 100 - arr]).astype(np.int16)
    p = write_tiff(f"{scratch}/planar.tif", planes, **kw)
    hd = gt.read_header(p)
    assert (hd.samples, hd.planar) == (3, 2)
    for band in range(3):
        assert _cells(gt.read_geotiff(spark, p, band=band)) == _expect(planes[band]), band
    tl, _ = gt.read_geotiff_tiles(spark, p, 16, band=2)
    ref = gt.read_geotiff(spark, p, band=2).to_tiles(16).df
    assert tl.df.exceptAll(ref).count() == 0 and ref.exceptAll(tl.df).count() == 0
