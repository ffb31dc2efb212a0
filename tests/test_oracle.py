"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from paths import SF001
from harness import compare, duck
from tessera.plans.queries import QUERIES

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    missing = [n for n in NAMES if n not in entry.oracle_sql()]
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF001)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert df.columns == ["zone_set", "zone_id", "name", "zid", "n", "min", "max",
                          "mean", "median", "mode", "stddev"]


OTHER_SCALES = ["zonal_statistics", "zonal_statistics_tiles", "zonal_min_max_mean_float",
                "focal_count_sweep", "tile_size_sweep", "raster_add_count"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
@pytest.mark.parametrize("name", OTHER_SCALES)
def test_query_matches_oracle_other_scales(spark, sf, name):
    r = compare(spark, duck(sf), name, sf)
    assert r["status"] == "ok", r
