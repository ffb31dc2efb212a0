"""Forms of the operators that hold at scale: packed, hierarchical, incremental."""

import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF001
from tessera import sinks
from tessera.functions import geometry as geo
from tessera.functions import kernels
from tessera.layer import Georef, Layer
from tessera.operators import focal, local, zonal
from tessera.plans import queries
from tessera.sources import footers
from tessera.sources.geojson import read_zones


def raster(spark, w, h, f=lambda x, y: x * y % 7 or None, kind="int"):
    return Layer(spark.createDataFrame([(x, y, f(x, y)) for y in range(h) for x in range(w)], f"x int, y int, v {kind}"), "t", Georef.pixel(4326))


def zones(spark, tmp_path, boxes):
    rings = [("z%d" % i, [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]) for i, (x, y, w, h) in enumerate(boxes)]
    path = tmp_path / "z.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": i, "properties": {"NAME": i, "ID": 1}, "geometry": {"type": "Polygon", "coordinates": c}} for i, c in rings]}))
    return read_zones(spark, str(path))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- zones

def test_candidates_are_at_most_twice_the_matches(spark):
    """10,000 zones and more in one bin: rows that share the join's keys, without its
    comparison of x."""
    layer, many = queries.dense_grid(spark, SF001), queries.dense_zones(spark, SF001)
    r = zonal._runs(layer.georef, layer.bounds, many)
    widths = zonal._widths(zonal.BIN_WIDTH)
    w = zonal._width_of(F.col("xb") - F.col("xa") + 1, widths)
    pieces = r.withColumn("w", w).select("zk", "y", "w", zonal._bins(F.col("xa"), F.col("xb"), F.col("w")).alias("bin"))
    used = [k for k in widths if k <= 16]
    probes = layer.df.select("x", "y", F.explode(F.array(*[F.lit(k) for k in used])).alias("w")).withColumn("bin", F.floor(F.col("x") / F.col("w")).cast("int"))
    candidates = probes.join(pieces, ["y", "w", "bin"]).count()
    matches = zonal.zone_cells(layer, many).count()
    assert many.df.count() > 10_000 and matches < candidates <= 2 * matches
    # all in one bin of the widest class, where each cell would meet all runs of its row
    assert pieces.select("y").distinct().count() <= 10


@pytest.mark.parametrize("kw", [{}, {"broadcast_max_runs": 0}, {"bin_width": 3}, {"bin_width": 7, "broadcast_max_runs": 0}])
def test_zone_cells_of_all_widths(spark, tmp_path, kw):
    rng = random.Random(2)
    boxes = [(rng.uniform(-5, 90), rng.uniform(-3, 8), rng.choice([0.7, 1, 3, 9, 40, 200]), rng.choice([0.6, 2, 7])) for _ in range(60)]
    z = zones(spark, tmp_path, boxes)
    layer = raster(spark, 100, 9)
    gaps = layer.with_df(layer.df.where("x % 5 <> 3"))  # segments with gaps
    for own in (layer, gaps):
        edges = geo.zone_edges(z.df, own.georef.col_of, own.georef.row_of)
        want = rows(geo.parity_inside(own.df, edges).select("zone_set", "zone_id", "x", "y", "v"))
        assert rows(zonal.zone_cells(own, z, **kw).select("zone_set", "zone_id", "x", "y", "v")) == want


def test_width_of_a_run_bounds_pieces_and_candidates(spark):
    widths = zonal._widths(1024)
    df = spark.range(1, 9000).select(F.col("id").alias("n")).select("n", zonal._width_of(F.col("n"), widths).alias("w"))
    for n, w in df.collect():
        for xa in (0, 1, w - 1, 5 * w + w // 2):
            bins = (xa + n - 1) // w - xa // w + 1
            assert bins * w <= 2 * n and bins <= max(10, n // w + 2)


def test_zone_without_border_tiles_reads_no_cells(spark, tmp_path):
    tiles = raster(spark, 40, 24).to_tiles(8)
    blocks = zonal.tile_histograms(tiles).cache()
    blocks.count()
    unreadable = tiles.df.where(F.raise_error(F.lit("cells were read")).isNotNull())
    known = replace(tiles, df=unreadable, blocks=blocks, extent=(0, 39, 0, 23), source=None)
    covering = zones(spark, tmp_path, [(-3, -3, 100, 100), (8, 8, 16, 8)])
    assert rows(zonal.histogram_tiles(known, covering)) == rows(zonal.histogram_tiles(tiles, covering))
    with pytest.raises(Exception, match="cells were read"):
        zonal.histogram_tiles(known, zones(spark, tmp_path, [(1, 1, 9, 9)])).collect()


@pytest.mark.parametrize("limit", [10**6, 0])
def test_block_histograms_give_the_same_statistics(spark, tmp_path, limit):
    tiles = raster(spark, 43, 29).to_tiles(6)
    z = zones(spark, tmp_path, [(-3, -3, 100, 100), (5.5, 4, 20, 13), (12, 12, 1, 1), (200, 200, 3, 3)])
    with_blocks = replace(tiles, blocks=zonal.tile_histograms(tiles))
    assert rows(zonal.statistics_tiles(with_blocks, z, broadcast_max_runs=limit)) == rows(zonal.statistics_tiles(tiles, z))
    changed = local.reclassify_tiles(with_blocks, raster(spark, 43, 29).meta(), 3, 1)
    assert changed.blocks is None  # the stored histograms aren't those of other values


def test_histograms_are_stored_beside_tiles(spark, tmp_path):
    tiles = raster(spark, 20, 20).to_tiles(5)
    sinks.save_tiles(tiles, "kept_tiles", 4, path=f"{tmp_path}/kept_tiles", histograms=True)
    try:
        back = sinks.load_tiles(spark, "kept_tiles", 5, georef=tiles.georef, extent=(0, 19, 0, 19))
        z = zones(spark, tmp_path, [(0, 0, 20, 20), (3, 3, 9, 9)])
        assert back.blocks is not None and rows(zonal.histogram_tiles(back, z)) == rows(zonal.histogram_tiles(tiles, z))
    finally:
        spark.sql("DROP TABLE kept_tiles")
        spark.sql("DROP TABLE kept_tiles_blocks")


# ---------------------------------------------------------------- tiles

@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "double", "float", "decimal(20,0)"])
def test_retile_keeps_values_of_any_type(spark, kind):
    df = raster(spark, 23, 11).df.withColumn("v", F.col("v").cast(kind))
    layer = Layer(df.repartition(7), "t", Georef.pixel(4326))
    tiles = layer.to_tiles(4)
    assert tiles.df.schema["t"].dataType.elementType == df.schema["v"].dataType
    assert rows(tiles.to_cells().df) == rows(df)
    assert tiles.df.where("size(t) <> 16").count() == 0


def test_retile_of_a_large_tile_is_a_stream(spark):
    n = 1000
    cells = spark.range(n * n).select((F.col("id") % n).cast("int").alias("x"), F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % 251).cast("int").alias("v"))
    tiles = Layer(cells, "t").to_tiles(n)
    assert "collect_list" not in tiles.df._jdf.queryExecution().executedPlan().toString()
    r = tiles.df.select(F.size("t").alias("n"), F.expr("aggregate(t, 0L, (s, v) -> s + v)").alias("s"), F.expr("t[1003]").alias("v")).collect()
    assert [tuple(x) for x in r] == [(n * n, sum(i % 251 for i in range(n * n)), 1003 % 251)]


def test_adding_repeated_cells_raises(spark):
    def cells(values):
        return Layer(spark.createDataFrame(values, "x int, y int, v int"), "t", Georef.pixel(4326))
    twice, once = cells([(0, 0, 1), (0, 0, 2), (1, 0, 5)]), cells([(0, 0, 7), (1, 0, 7)])
    for a, b in ((twice, once), (once, twice), (twice, twice)):
        with pytest.raises(Exception, match="more than once"):
            local.add(a, b).df.collect()
    elsewhere = cells([(1, 0, 7)])
    assert rows(local.add(twice, elsewhere).df) == [(1, 0, 12)]
    tiles = once.to_tiles(2)
    doubled = replace(tiles, df=tiles.df.unionByName(tiles.df))
    with pytest.raises(Exception, match="more than once"):
        local.add_tiles(tiles, doubled).df.collect()


def test_add_has_one_exchange_a_side(spark):
    a, b = raster(spark, 9, 9), raster(spark, 9, 9)
    plan = local.add(a, b).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2


# ---------------------------------------------------------------- focal

@pytest.mark.parametrize("kind", ["int", "double"])
@pytest.mark.parametrize("radius", [1, 4, 5, 9, 30])
@pytest.mark.parametrize("edge", ["halo", "tile"])
def test_any_radius(spark, kind, radius, edge):
    rng = random.Random(radius)
    w, h, n = 19, 13, 6
    values = {(x, y): None if rng.random() < .2 else rng.randint(-50, 50) / (1 if kind == "int" else 7) for x in range(w) for y in range(h)}
    layer = raster(spark, w, h, lambda x, y: values[x, y] if kind == "double" or values[x, y] is None else int(values[x, y]), kind)
    got = {(r.x, r.y): r.v for r in focal.focal_mean(layer, radius, edge, tile_size=n, block=8).df.collect()}
    assert len(got) == w * h
    for (x, y), v in got.items():
        near = [values[p, q] for p in range(max(0, x - radius), min(w, x + radius + 1)) for q in range(max(0, y - radius), min(h, y + radius + 1))
                if values[p, q] is not None and (edge == "halo" or (p // n == x // n and q // n == y // n))]
        if not near:
            assert v is None
        elif kind == "int":
            assert v == sum(near) / len(near)
        else:
            assert math.isclose(v, math.fsum(near) / len(near), rel_tol=1e-11, abs_tol=1e-11)


def test_infinite_neighbours_stay_local(spark):
    layer = raster(spark, 30, 3, lambda x, y: math.inf if (x, y) == (3, 1) else -math.inf if (x, y) == (20, 1) else 1.0, "double")
    got = {(r.x, r.y): r.v for r in focal.focal_mean(layer, 6, block=64).df.collect()}
    assert [got[x, 0] for x in (0, 9, 10, 13, 14, 26, 27)] == [math.inf, math.inf, 1.0, 1.0, -math.inf, -math.inf, 1.0]


@pytest.mark.parametrize("kind", ["int64", "float64"])
@pytest.mark.parametrize("r", [1, 5, 12])
def test_box_sums_of_tiles(kind, r):
    rng = np.random.default_rng(r)
    v = rng.integers(-9, 9, (3, 12, 12)).astype(kind)
    ok = rng.random(v.shape) < .8
    s, c = kernels.box_sums(v, ok, r)
    for k, y, x in [(0, 0, 0), (1, 5, 6), (2, 11, 11), (0, 11, 3)]:
        own = slice(max(0, y - r), y + r + 1), slice(max(0, x - r), x + r + 1)
        assert c[k, y, x] == ok[k][own].sum() and s[k, y, x] == pytest.approx((v[k] * ok[k])[own].sum(), abs=1e-12)


# ---------------------------------------------------------------- sums of many tiles

def test_fifty_tile_layers_are_summed_as_a_stream(spark):
    base = raster(spark, 20, 11)
    plus = [base.with_df(base.df.select("x", "y", (F.col("v") + i).alias("v"))) for i in range(50)]
    got = rows(local.add_n_tiles([l.to_tiles(8) for l in plus]).to_cells().df)
    assert got == rows(base.df.select("x", "y", (F.col("v").cast("long") * 50 + sum(range(50)))))


@pytest.mark.parametrize("kind, big", [("decimal(20,0)", 10**18), ("double", 0.5), ("bigint", 2**61)])
def test_tile_sums_of_every_type(spark, kind, big):
    layer = raster(spark, 9, 5).with_df(raster(spark, 9, 5).df.select("x", "y", (F.col("v") + F.lit(big)).cast(kind).alias("v")))
    got = {(x, y): v for x, y, v in local.add_n_tiles([layer.to_tiles(4)] * 3).to_cells().df.collect()}
    assert got == {(x, y): None if v is None else v * 3 for x, y, v in layer.df.collect()}


def test_tiles_that_a_raster_lacks_and_repeated_ones(spark):
    tiles = raster(spark, 12, 8).to_tiles(4)
    some = tiles.with_df(tiles.df.where("tc <> 1"))
    twice = tiles.with_df(tiles.df.unionByName(tiles.df))
    assert {r.tc for r in local.add_n_tiles([tiles, some, tiles]).df.collect()} == {0, 2}
    assert local.add_n_tiles([some.with_df(some.df.where("tc = 9")), tiles, twice]).df.collect() == []
    with pytest.raises(Exception, match="more than once"):
        local.add_n_tiles([tiles, twice, some]).df.collect()


def test_sums_beyond_64_bits_raise(spark):
    big = raster(spark, 4, 4, lambda x, y: 2**62, "bigint").to_tiles(4)
    with pytest.raises(Exception, match="overflow"):
        local.add_n_tiles([big, big, big]).df.collect()


# ---------------------------------------------------------------- facts from footers

def test_stored_metadata_reads_no_data_pages(spark, tmp_path):
    layer = raster(spark, 30, 17, lambda x, y: None if x % 4 == 0 else y)
    sinks.save_cells(layer, str(tmp_path / "cells"), 5)
    facts = footers.file_facts(spark, str(tmp_path / "cells")).collect()
    assert len(facts) > 1 and all(f.groups_read == 0 for f in facts)
    assert footers.stored_metadata(spark, str(tmp_path / "cells")).collect() == layer.metadata().collect()


def test_stored_metadata_without_statistics(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    cells = pa.table({"x": pa.array([3, 4, 9], pa.int32()), "y": pa.array([7, 1, 2], pa.int32()), "v": [1.5, float("nan"), None]})
    for name, kept in (("a", True), ("b", False)):
        (tmp_path / name).mkdir()
        pq.write_table(cells, tmp_path / name / "p.parquet", write_statistics=kept, row_group_size=2)
        pq.write_table(cells.slice(0, 0), tmp_path / name / "none.parquet")
        facts = {f.path.rsplit("/", 1)[1]: f for f in footers.file_facts(spark, str(tmp_path / name)).collect()}
        assert facts["p.parquet"].groups_read == 2 and facts["none.parquet"].xmin is None
        assert [tuple(r) for r in footers.stored_metadata(spark, str(tmp_path / name)).collect()] == [(3, 9, 1, 7, 3, 1)]


def test_many_runs_are_made_once(spark, tmp_path, monkeypatch):
    """Where the edges give more runs than may be broadcast, the runs are not counted
    first; the bound and the box from the edges hold all runs."""
    rng = random.Random(6)
    z = zones(spark, tmp_path, [(rng.uniform(-3, 30), rng.uniform(-2, 8), rng.choice([0.7, 3, 9, 40]), rng.choice([0.6, 2, 7])) for _ in range(40)])
    layer = raster(spark, 50, 9)
    want, runs = rows(zonal.histogram(layer, z)), zonal.zone_runs(layer, z).collect()
    most, (x0, y0, x1, y1) = zonal._run_bound(layer.georef, layer.bounds, z)
    assert most >= len(runs) > 40
    assert all(x0 <= r.xa and r.xb <= x1 and y0 <= r.y <= y1 for r in runs)
    monkeypatch.setattr(zonal, "_size_and_bounds", None)
    assert rows(zonal.histogram(layer, z, broadcast_max_runs=len(runs) - 1)) == want
