"""Cells packed into row segments give the sums of a plain join."""

import random
from decimal import Decimal

import pytest

from tessera.layer import Georef, Layer
from tessera.operators import local


def _layer(spark, rows, kind="int"):
    return Layer(spark.createDataFrame(rows, f"x int, y int, v {kind}").repartition(5), "t", Georef(0, 0, 1, 1, 4326))


def _cells(rng, density, values):
    return [(x, y, rng.choice(values)) for y in (-1, 0, 3) for x in range(-1100, 2100, 1) if rng.random() < density]


@pytest.mark.parametrize("da, db", [(1, 1), (1, 0.02), (0.02, 1), (0.3, 0.3), (0, 1)])
@pytest.mark.parametrize("kind, values", [("int", [None, 0, 7, 2**31 - 1]), ("double", [None, 0.5, -3.25]), ("decimal(20,0)", [None, Decimal(2**64 - 1), Decimal(1)])])
def test_equals_plain_join(spark, da, db, kind, values):
    rng = random.Random(f"{da}{db}{kind}")
    a, b = _cells(rng, da, values), _cells(rng, db, values)
    right = {(x, y): v for x, y, v in b}
    want = sorted((x, y, str(None if v is None or right[x, y] is None else v + right[x, y])) for x, y, v in a if (x, y) in right)
    got = local.add(_layer(spark, a, kind), _layer(spark, b, kind)).df
    assert sorted((r.x, r.y, str(r.v)) for r in got.collect()) == want
    assert [f.dataType.simpleString() for f in got.schema][:2] == ["int", "int"]


@pytest.mark.parametrize("extra", [[(5, 0, 1)], [(5, 0, None)], [(5, 0, 1), (900, 0, 2)]])
@pytest.mark.parametrize("side", [0, 1])
def test_repeated_cells_raise(spark, extra, side):
    cells = [(x, 0, x) for x in range(40) if x != 9]
    layers = [_layer(spark, cells), _layer(spark, cells)]
    layers[side] = _layer(spark, cells + extra)
    with pytest.raises(Exception, match="more than once"):
        local.add(*layers).df.collect()


def test_repeated_cells_that_meet_nothing(spark):
    a = _layer(spark, [(0, 0, 1), (0, 0, 2), (1, 0, 3)])
    assert [tuple(r) for r in local.add(a, _layer(spark, [(1, 0, 4), (2, 0, 5)])).df.collect()] == [(1, 0, 7)]


def test_packed_before_the_exchange(spark):
    plan = local.add(_layer(spark, [(0, 0, 1)]), _layer(spark, [(0, 0, 1)])).df._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("SortMergeJoin"):]
    assert joined.count("partial_collect_list") >= 2 and joined.count("hashpartitioning(y") == 2
