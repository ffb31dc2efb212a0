"""Property test: scanline runs == brute-force crossing parity on random polygons."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions import geometry as geo
from tessera.layer import Georef, Layer
from tessera.operators import zonal
from tessera.sources.geojson import read_zones

W, H = 14, 11
# coordinates on a half-cell grid, so centres often fall exactly on edges
coord = st.integers(min_value=-4, max_value=2 * W + 4).map(lambda k: k / 2.0)
ring = st.lists(st.tuples(coord, coord), min_size=3, max_size=7)
polygon = st.lists(ring, min_size=1, max_size=2)
features = st.lists(polygon, min_size=1, max_size=3)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(features)
def test_scanline_matches_parity(spark, tmp_path_factory, feats):
    d = tmp_path_factory.mktemp("poly")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": f"f{i}", "properties": {"NAME": "n", "ID": i},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[list(p) for p in r] for r in poly]]}}
        for i, poly in enumerate(feats)]}
    path = d / "z.geojson"
    path.write_text(json.dumps(fc))
    zones = read_zones(spark, str(path))
    rows = [(x, y, (x * 7 + y) % 5 or None) for x in range(W) for y in range(H)]
    lay = Layer(spark.createDataFrame(rows, "x int, y int, v int"), "r", Georef.pixel(4326))
    scan = zonal.zone_cells(lay, zones, bin_width=4)
    edges = geo.zone_edges(zones.df, lay.georef.col_of, lay.georef.row_of)
    par = geo.parity_inside(lay.df, edges).select("zone_set", "zone_id", "x", "y", "v")
    a = sorted(map(tuple, scan.collect()))
    b = sorted(map(tuple, par.collect()))
    assert a == b
