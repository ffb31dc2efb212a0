"""Invariants, two-form and two-method agreement, hand-made edge fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from paths import SF0001, SF001
from tessera.functions import geometry as geo
from tessera.layer import Georef, Layer
from tessera.operators import focal, layout, local, sweep, zonal
from tessera.plans.queries import fixture_zones, zonal_grid
from tessera.sources.geojson import read_zones
from tessera.sources.grids import grid_a, grid_b, grid_c


def cells(spark, rows, vtype="int"):
    df = spark.createDataFrame(rows, f"x int, y int, v {vtype}")
    return Layer(df, "t", Georef.pixel(4326))


def test_tiles_round_trip(spark):
    a = grid_a(spark, SF0001)
    back = a.to_tiles(25).to_cells(keep_null=True).df
    # tiles are full 25x25, the raster is 100 x 15: padding does not come back
    assert back.count() == 1500
    got = back.join(a.df.withColumnRenamed("v", "w"), ["x", "y"], "inner")
    assert got.where(~F.col("v").eqNullSafe(F.col("w"))).count() == 0
    assert got.count() == a.df.count()


@pytest.mark.parametrize("n", [7, 25, 64])
def test_count_independent_of_tile_size(spark, n):
    a = grid_a(spark, SF0001)
    assert local.count_value_tiles(a.to_tiles(n), 16).first().n == 66


def test_self_add_count_equals_value_count(spark):
    a = grid_a(spark, SF001)
    n2 = local.count_value(local.add(a, a), 32).first().n
    assert n2 == local.count_value(a, 16).first().n


def test_add_n_two_layers_equals_add(spark):
    a, b = grid_a(spark, SF0001), grid_b(spark, SF0001)
    x = local.add(a, b).df
    y = local.add_n([a, b]).df
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_reclassify_values(spark):
    r = local.reclassify(grid_a(spark, SF0001), 16, 1)
    assert {row.v for row in r.df.select("v").distinct().collect()} == {1, -999}
    kept = local.reclassify(grid_a(spark, SF0001), 16, 1, keep_nodata=True)
    assert kept.df.where(F.col("v").isNull()).count() == 70


def test_reclassify_tiles_padding_stays_null(spark):
    a = grid_a(spark, SF0001)
    t = local.reclassify_tiles(a.to_tiles(25), a.meta(), 16, 1)
    c = t.df.select(F.explode("t").alias("v"))
    assert c.where(F.col("v").isNull()).count() == 4 * 625 - 1500
    assert t.to_cells().df.where(F.col("v").isNull()).count() == 0


def test_focal_tile_equals_halo_on_one_tile(spark):
    a = grid_a(spark, SF0001)  # 100 x 15 fits one 128 tile
    t = focal.focal_mean(a, 1, "tile", tile_size=128).df
    h = focal.focal_mean(a, 1, "halo").df
    assert t.exceptAll(h).count() == 0 and h.exceptAll(t).count() == 0


@pytest.mark.parametrize("block", [4, 9, 32])
def test_focal_halo_independent_of_block(spark, block):
    a = grid_a(spark, SF0001)
    ref = focal.focal_mean(a, 1, "halo", block=256).df
    got = focal.focal_mean(a, 1, "halo", block=block).df
    assert ref.exceptAll(got).count() == 0 and got.exceptAll(ref).count() == 0


def test_focal_radius_two_against_brute_force(spark):
    a = grid_a(spark, SF0001)
    got = focal.focal_mean(a, 2, "halo", block=8).df
    p, q = a.df.alias("p"), a.df.alias("q")
    cond = (F.abs(F.col("p.x") - F.col("q.x")) <= 2) & (F.abs(F.col("p.y") - F.col("q.y")) <= 2)
    ref = p.join(q, cond).groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(
        (F.sum("q.v").cast("double") / F.count("q.v").cast("double")).alias("v"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_focal_all_null_neighbourhood(spark):
    rows = [(x, y, None if x < 4 else 5) for x in range(8) for y in range(3)]
    m = focal.focal_mean(cells(spark, rows), 1, "halo", block=3).df
    got = {(r.x, r.y): r.v for r in m.collect()}
    assert got[(1, 1)] is None          # 3x3 all NoData
    assert got[(3, 1)] == 5.0           # NoData centre still gets a value
    assert got[(7, 2)] == 5.0


def test_sweep_value_count_invariant(spark):
    s = sweep.tile_size_sweep(grid_a(spark, SF001), 16).collect()
    assert len(s) == len(sweep.REFERENCE_TILE_SIZES)
    assert {r.n_value for r in s} == {726}
    assert {r.tile_size: r.n_tiles for r in s}[25] == 24


def test_windows_cover_raster(spark):
    for g in (grid_a, grid_b, grid_c):
        lay = g(spark, SF0001)
        m = lay.meta()
        w = layout.windows(lay, 30).agg(F.sum("size")).first()[0]
        assert w == m.cols * m.rows


def test_scanline_equals_parity(spark):
    layer, zones = zonal_grid(spark, SF001), fixture_zones(spark)
    scan = zonal.zone_cells(layer, zones)
    edges = geo.zone_edges(zones.df, layer.georef.col_of, layer.georef.row_of)
    par = geo.parity_inside(layer.df, edges).select("zone_set", "zone_id", "x", "y", "v")
    assert scan.exceptAll(par).count() == 0 and par.exceptAll(scan).count() == 0


def _zone_file(path, features):
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    return path


def _poly(fid, rings, name="z", i=1, kind="Polygon"):
    return {"type": "Feature", "id": fid, "properties": {"NAME": name, "ID": i},
            "geometry": {"type": kind, "coordinates": rings}}


def test_centre_on_edge_half_open(spark, scratch):
    # square with edges through cell centres: left/top edges own their cells
    sq = [[[2.5, 2.5], [5.5, 2.5], [5.5, 5.5], [2.5, 5.5], [2.5, 2.5]]]
    z = read_zones(spark, _zone_file(f"{scratch}/sq.geojson", [_poly("s", sq)]))
    lay = cells(spark, [(x, y, 1) for x in range(10) for y in range(10)])
    got = sorted((r.x, r.y) for r in zonal.zone_cells(lay, z).collect())
    assert got == [(x, y) for x in (2, 3, 4) for y in (2, 3, 4)]
    edges = geo.zone_edges(z.df, lay.georef.col_of, lay.georef.row_of)
    par = sorted((r.x, r.y) for r in geo.parity_inside(lay.df, edges).collect())
    assert par == got


def test_unclosed_ring_and_small_bins(spark, scratch):
    tri = [[[0, 0], [9, 0], [0, 9]]]  # not closed
    z = read_zones(spark, _zone_file(f"{scratch}/t.geojson", [_poly("t", tri)]))
    lay = cells(spark, [(x, y, x + y) for x in range(12) for y in range(12)])
    a = zonal.zone_cells(lay, z, bin_width=2, broadcast_max_runs=0)  # shuffled join, many bins
    b = zonal.zone_cells(lay, z)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() == sum(1 for x in range(12) for y in range(12) if x + y + 1 < 9)


def test_duplicate_ids_raise(spark, scratch):
    sq = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    p = _zone_file(f"{scratch}/d.geojson", [_poly("a", sq), _poly("a", sq)])
    with pytest.raises(ValueError, match="unique"):
        read_zones(spark, p)


def test_srid_mismatch_raises(spark):
    zones = fixture_zones(spark)
    lay = Layer(grid_a(spark, SF0001).df, "A", Georef.pixel(5070))
    with pytest.raises(ValueError, match="srid"):
        zonal.statistics(lay, zones)
    with pytest.raises(ValueError, match="srid"):
        local.add(lay, grid_a(spark, SF0001))


def test_zone_split_and_lookup(spark):
    z = fixture_zones(spark)
    assert sorted(r.zone_id for r in z.polygons().df.collect()) == ["p0", "p1"]
    assert [r.zone_id for r in z.multipolygons().df.collect()] == ["m1"]
    r = z.lookup("m1").first()
    assert (r.name, r.zid, len(r.geom)) == ("two", 2, 2)


def test_geojson_lines(spark, scratch):
    sq = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    with open(f"{scratch}/z.geojsonl", "w") as f:
        for i in range(3):
            f.write(json.dumps(_poly(f"f{i}", sq, f"n{i}", i)) + "\n")
    z = read_zones(spark, f"{scratch}/z.geojsonl", lines=True)
    assert sorted(r.zone_id for r in z.df.collect()) == ["f0", "f1", "f2"]


def test_map_units_zones(spark, scratch):
    # same square in map units of a georeferenced raster
    g = Georef(x0=100.0, y0=50.0, dx=0.5, dy=0.5, srid=4326)
    sq = [[[101.0, 49.0], [103.0, 49.0], [103.0, 47.0], [101.0, 47.0], [101.0, 49.0]]]
    z = read_zones(spark, _zone_file(f"{scratch}/m.geojson", [_poly("m", sq)]))
    lay = Layer(spark.createDataFrame([(x, y, 1) for x in range(10) for y in range(10)], "x int, y int, v int"),
                "g", g)
    got = sorted((r.x, r.y) for r in zonal.zone_cells(lay, z).collect())
    assert got == [(x, y) for x in (2, 3, 4, 5) for y in (2, 3, 4, 5)]


def test_float_grid_layout(spark):
    c = grid_c(spark, SF0001)
    t = c.to_tiles(16)
    assert t.df.count() == 4 * 32  # 64 x 500 raster, 16 x 16 tiles
    back = t.to_cells(keep_null=False).df
    assert back.exceptAll(c.df).count() == 0


def test_float_zone_statistics_close_to_exact(spark):
    c = grid_c(spark, SF0001)
    lay = Layer(c.df, "C", Georef.pixel(4326))
    zones = fixture_zones(spark)
    st = {r.zone_id: r for r in zonal.statistics(lay, zones).collect()}
    cells = zonal.zone_cells(lay, zones)
    exact = {r.zone_id: r for r in cells.groupBy("zone_id").agg(
        F.median("v").alias("med"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n")).collect()}
    for zid in ("p1", "m1"):
        assert st[zid].n == exact[zid].n
        assert st[zid].stddev == pytest.approx(exact[zid].sd, rel=1e-9)
        assert abs(st[zid].median - exact[zid].med) <= 0.01 * (st[zid].max - st[zid].min)
    assert st["p0"].n == 0


def test_zone_cells_pruned_to_zone_box(spark):
    lay, zones = zonal_grid(spark, SF001), fixture_zones(spark)
    plan = zonal.zone_cells(lay, zones)._jdf.queryExecution().optimizedPlan().toString()
    assert "y#" in plan and ">=" in plan  # bounding-box filter on the scan side


def _random_layer(spark, w, h, seed, kind="int", p_null=0.2):
    import numpy as np
    rng = np.random.default_rng(seed)
    rows = []
    for y in range(h):
        for x in range(w):
            if rng.random() < p_null:
                v = None
            elif kind == "int":
                v = int(rng.integers(-50, 50))
            else:
                v = float(rng.integers(-400, 400)) / 8.0  # exact binary fractions
            rows.append((x, y, v))
    return cells(spark, rows, "int" if kind == "int" else "double")


@pytest.mark.parametrize("kind,r,n", [("int", 1, 7), ("int", 2, 5), ("float", 1, 6), ("float", 3, 8)])
def test_tile_focal_equals_cell_focal(spark, kind, r, n):
    lay = _random_layer(spark, 23, 17, seed=r * 10 + n, kind=kind)
    meta = lay.meta()
    tiles = lay.to_tiles(n)
    t_tile = focal.focal_mean_tiles(tiles, meta, r).to_cells(keep_null=False).df
    c_tile = focal.focal_mean(lay, r, "tile", tile_size=n).df.where(F.col("v").isNotNull())
    assert t_tile.exceptAll(c_tile).count() == 0 and c_tile.exceptAll(t_tile).count() == 0
    t_halo = focal.focal_mean_tiles_halo(tiles, meta, r).to_cells(keep_null=False).df
    c_halo = focal.focal_mean(lay, r, "halo", block=n).df.where(F.col("v").isNotNull())
    assert t_halo.exceptAll(c_halo).count() == 0 and c_halo.exceptAll(t_halo).count() == 0


def test_zonal_tiles_equals_cells_random(spark, scratch):
    lay = _random_layer(spark, 40, 30, seed=3)
    feats = [_poly("a", [[[1.2, 0.5], [30.7, 3.3], [22.1, 27.9], [2.5, 20.0], [1.2, 0.5]],
                         [[8, 8], [14, 8], [14, 14], [8, 14], [8, 8]]]),
             _poly("b", [[[[20, 10], [39.5, 10], [39.5, 29.5], [20, 10]]], [[[0, 25], [5, 25], [5, 29], [0, 25]]]],
                   kind="MultiPolygon")]
    z = read_zones(spark, _zone_file(f"{scratch}/r.geojson", feats))
    for n in (4, 9, 64):
        a = zonal.histogram_tiles(lay.to_tiles(n), z, broadcast_max_runs=0 if n == 9 else 10**6)
        b = zonal.histogram(lay, z, bin_width=5)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_numeric_feature_ids_and_missing_ids(spark, scratch):
    sq = [[[0, 0], [3, 0], [3, 3], [0, 3], [0, 0]]]
    f1 = _poly("x", sq)
    f1["id"] = 7
    z = read_zones(spark, _zone_file(f"{scratch}/n.geojson", [f1]))
    assert [r.zone_id for r in z.df.collect()] == ["7"]
    f2 = _poly("y", sq)
    del f2["id"]
    with pytest.raises(ValueError, match="present and unique"):
        read_zones(spark, _zone_file(f"{scratch}/m.geojson", [f2]))


def test_zone_key_collision_detected(spark):
    from tessera.sources.geojson import check_ids
    z = fixture_zones(spark).df
    forced = z.withColumn("zk", F.lit(42).cast("bigint"))
    with pytest.raises(ValueError, match="collision"):
        check_ids(forced)
    assert check_ids(z) == 3


def test_tile_ops_mask_outside_bounds_not_starting_at_origin(spark):
    rows = [(x, y, (x + y) % 3) for x in range(5, 12) for y in range(3, 9)]
    lay = cells(spark, rows)
    meta = lay.meta()
    assert meta.bounds == (5, 11, 3, 8)
    t = lay.to_tiles(4)
    r = local.reclassify_tiles(t, meta, 1, 100).to_cells(keep_null=False).df
    assert r.count() == len(rows)
    f = focal.focal_mean_tiles(t, meta, 1).to_cells(keep_null=False).df
    c = focal.focal_mean(lay, 1, "tile", tile_size=4).df
    assert f.exceptAll(c).count() == 0 and c.exceptAll(f).count() == 0


@pytest.mark.parametrize("r", [1, 2])
def test_focal_sweep_equals_per_size(spark, r):
    a = grid_a(spark, SF0001)
    sizes = (4, 7, 25, 64)
    got = {row.tile_size: row.n for row in focal.focal_count_sweep(a, 10, sizes, r, block=16).collect()}
    for z in sizes:
        want = focal.count_truncated(focal.focal_mean(a, r, "tile", tile_size=z), 10).first().n
        assert got[z] == want, z


@pytest.mark.parametrize("old,new", [(1, 100), (2, -999), (0, 0)])
def test_reclassify_count_tiles_equals_cells(spark, old, new):
    rows = [(x, y, None if (x * y) % 7 == 0 else (x + y) % 3) for x in range(5, 17) for y in range(3, 12)]
    lay = cells(spark, rows)
    want = local.reclassify_count(lay, old, new).first()
    for n in (4, 5, 32):
        got = local.reclassify_count_tiles(lay.to_tiles(n), lay.meta(), old, new).first()
        assert (got.n_new, got.n_other) == (want.n_new, want.n_other), n


def test_zone_runs_cover_zone_cells(spark):
    lay, zones = zonal_grid(spark, SF001), fixture_zones(spark)
    runs = zonal.zone_runs(lay, zones)
    per_zone = {r.zone_id: r.n for r in runs.groupBy("zone_id").agg(
        F.sum(F.col("xb") - F.col("xa") + 1).alias("n")).collect()}
    cells = {r.zone_id: r["count"] for r in zonal.zone_cells(lay, zones).groupBy("zone_id").count().collect()}
    # grid A is 100 columns wide; runs beyond it hold no cells
    clipped = {r.zone_id: r.n for r in runs.where("xa < 100").groupBy("zone_id").agg(
        F.sum(F.least(F.col("xb"), F.lit(99)) - F.col("xa") + 1).alias("n")).collect()}
    assert clipped == cells
    assert all(per_zone[z] >= cells[z] for z in cells)


def test_statistics_from_histogram_equals_statistics(spark):
    lay, zones = zonal_grid(spark, SF0001), fixture_zones(spark)
    a = zonal.statistics_from_histogram(zonal.histogram(lay, zones), zones)
    b = zonal.statistics(lay, zones)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_zones_far_beyond_raster_are_bounded(spark, scratch):
    # a polygon 1000x larger than the raster: runs get clipped to the raster
    # once the run table exceeds the broadcast bound (forced here with 0)
    big = [[[-5000, -5000], [9000, -4000], [8000, 12000], [-3000, 9000], [-5000, -5000]]]
    z = read_zones(spark, _zone_file(f"{scratch}/huge.geojson", [_poly("h", big)]))
    lay = cells(spark, [(x, y, (x * 3 + y) % 4) for x in range(30) for y in range(20)])
    want = zonal.histogram(lay, z)
    got = zonal.histogram(cells(spark, [(x, y, (x * 3 + y) % 4) for x in range(30) for y in range(20)]), z,
                          broadcast_max_runs=0)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert want.agg(F.sum("n")).first()[0] == 600
    t = zonal.histogram_tiles(lay.to_tiles(8), z, broadcast_max_runs=0)
    assert t.exceptAll(want).count() == 0 and want.exceptAll(t).count() == 0


@pytest.mark.parametrize("w,h", [(37, 29), (40, 30)])
def test_exact_median_wide_domain(spark, scratch, w, h):
    import numpy as np
    rng = np.random.default_rng(w)
    vals = rng.integers(-300_000, 300_000, size=w * h)
    rows = [(x, y, int(vals[y * w + x])) for x in range(w) for y in range(h)]
    lay = cells(spark, rows)
    sq = [[[0, 0], [w, 0], [w, h], [0, h], [0, 0]]]
    tri = [[[0, 0], [w, 0], [0, h], [0, 0]]]
    z = read_zones(spark, _zone_file(f"{scratch}/m{w}.geojson", [_poly("all", sq), _poly("tri", tri)]))
    got = {r.zone_id: r.median for r in zonal.statistics(lay, z).collect()}
    want = {r.zone_id: r.m for r in zonal.zone_cells(lay, z).groupBy("zone_id")
            .agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_empty_raster(spark, scratch):
    empty = cells(spark, [])
    m = empty.meta()
    assert (m.cols, m.rows, m.cells) == (0, 0, 0)
    big = [[[-5000, -5000], [9000, -4000], [8000, 12000], [-3000, 9000], [-5000, -5000]]]
    z = read_zones(spark, _zone_file(f"{scratch}/e.geojson", [_poly("h", big)]))
    st = zonal.statistics(cells(spark, []), z, broadcast_max_runs=0).collect()
    assert [(r.zone_id, r.n) for r in st] == [("h", 0)]
    assert local.count_value(empty, 1).first().n == 0


def test_empty_raster_other_operators(spark):
    empty = cells(spark, [])
    assert layout.windows(empty, 10).count() == 0
    assert focal.focal_mean(empty, 1, "halo").df.count() == 0
    assert focal.focal_mean(empty, 1, "tile", tile_size=4).df.count() == 0
    assert empty.to_tiles(4).df.count() == 0
    assert {r.n_tiles for r in sweep.tile_size_sweep(empty, 1, (4, 8)).collect()} <= {0}
    assert layout.count_tiles(empty, 4).first().n_tiles == 0
