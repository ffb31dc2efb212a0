"""Golden numbers of FIXTURES.md section 3 (computed independently in DuckDB)."""

import pytest
from pyspark.sql import functions as F

from paths import SF0001, SF001
from tessera.operators import focal, local, zonal
from tessera.plans.queries import fixture_zones, zonal_grid
from tessera.sources.grids import grid_a, grid_b

GOLD = {
    SF0001: dict(a=(1500, 1430, 66, 62, 4), b=(1000, 952, 45, 4), ab=(1000, 911, 24, 4),
                 reclass=(66, 1434), ftile=(279, 1500, 16229.093), fhalo=(280, 1500, 16238.982),
                 p1=(410, 390, 1, 21, 11.015385, 11, 6.054434, 3),
                 m1=(160, 145, 1, 21, 10.558621, 10, 6.222180, 2)),
    SF001: dict(a=(15000, 14287, 726, 657, 24), b=(10000, 9471, 419, 16), ab=(10000, 9014, 185, 16),
                reclass=(726, 14274), ftile=(2683, 15000, 165096.520), fhalo=(2739, 15000, 165078.679),
                p1=(1412, 1340, 1, 21, 11.155224, 11, 5.955539, 5),
                m1=(1314, 1253, 1, 21, 11.158021, 11, 5.994325, 6)),
}


def _grid_facts(layer, values):
    df = layer.df
    aggs = [F.count(F.lit(1)), F.count("v")] + [F.count(F.when(F.col("v") == v, 1)) for v in values]
    aggs.append(F.count_distinct(F.floor(F.col("x") / 25), F.floor(F.col("y") / 25)))
    return tuple(df.agg(*aggs).first())


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_grids(spark, sf):
    g = GOLD[sf]
    assert _grid_facts(grid_a(spark, sf), [16, 21]) == g["a"]
    assert _grid_facts(grid_b(spark, sf), [16]) == g["b"]
    assert _grid_facts(local.add(grid_a(spark, sf), grid_b(spark, sf)), [32]) == g["ab"]


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_reclassify(spark, sf):
    r = local.reclassify_count(grid_a(spark, sf), 16, 1).first()
    assert (r.n_new, r.n_other) == GOLD[sf]["reclass"]


@pytest.mark.parametrize("sf", [SF0001, SF001])
@pytest.mark.parametrize("edge", ["tile", "halo"])
def test_focal(spark, sf, edge):
    m = focal.focal_mean(grid_a(spark, sf), 1, edge, tile_size=25, block=25)
    r = m.df.agg(F.count(F.when(F.col("v").cast("int") == 10, 1)), F.count("v"), F.sum("v")).first()
    want = GOLD[sf]["ftile" if edge == "tile" else "fhalo"]
    assert (r[0], r[1]) == want[:2]
    assert round(r[2], 3) == pytest.approx(want[2], abs=1e-3)


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_zones(spark, sf):
    layer, zones = zonal_grid(spark, sf), fixture_zones(spark)
    cells = {r.zone_id: r[1] for r in zonal.zone_cells(layer, zones).groupBy("zone_id").count().collect()}
    stats = {r.zone_id: r for r in zonal.statistics(layer, zones).collect()}
    for zid in ("p1", "m1"):
        want = GOLD[sf][zid]
        s = stats[zid]
        assert cells[zid] == want[0]
        assert (s.n, s.min, s.max) == want[1:4]
        assert round(s.mean, 6) == pytest.approx(want[4], abs=1e-6)
        assert s.median == want[5]
        assert round(s.stddev, 6) == pytest.approx(want[6], abs=1e-6)
        assert s.mode == want[7]
    assert stats["p0"].n == 0 and stats["p0"].mean is None
    assert "p0" not in cells
