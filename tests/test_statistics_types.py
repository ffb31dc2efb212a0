"""Statistics of every numeric type against Python's exact arithmetic."""

import math
import random
import statistics as st
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.operators.statistics import grouped_statistics

RNG = random.Random(11)
SPREAD = [RNG.uniform(-1, 1) * 10.0 ** RNG.randint(-300, 140) for _ in range(400)]
CASES = {
    "smallint": [-32768, 32767, 5, 5, 6],
    "int": [RNG.randint(-2**31, 2**31 - 1) for _ in range(501)] + [-2**31, 2**31 - 1],
    "bigint": [RNG.randint(-2**63, 2**63 - 1) for _ in range(500)] + [-2**63, 2**63 - 1],
    "decimal(20,0)": [Decimal(RNG.randint(0, 2**64 - 1)) for _ in range(301)] + [Decimal(2**64 - 1)] * 3,
    "decimal(38,6)": [Decimal(RNG.randint(-10**37, 10**37)).scaleb(-6) for _ in range(300)],
    "double": SPREAD + [0.0, -0.0, 5e-324, 1.7e150, -1.7e150],
}
NEAR = {  # values close together and far from zero: nothing may cancel
    "bigint": [2**62 + RNG.randint(-3, 3) for _ in range(999)] + [2**62 + 2**32 * 7],
    "decimal(20,0)": [Decimal(2**64 - 1 - RNG.randint(0, 5)) for _ in range(500)],
    "double": [1e15 + RNG.randint(0, 3) for _ in range(400)],
}


def hist(spark, kind, groups):
    rows = [(z, v, n) for z, values in groups.items() for v, n in Counter(values).items()]
    return spark.createDataFrame(rows, f"zk bigint, v {kind}, n bigint")


def close(got, want, places=1e-12):
    return got == want or math.isclose(got, want, rel_tol=places, abs_tol=1e-300)


@pytest.mark.parametrize("kind, values", [*CASES.items(), *NEAR.items()], ids=lambda x: x if isinstance(x, str) else "")
def test_every_type(spark, kind, values):
    broadcast = kind != "int"  # the join's form doesn't depend on the type
    groups = {1: values, 2: values[:1], 3: values[:2], 4: values[: len(values) // 2 + 1], 5: [values[-1]] * 7}
    got = {r.zk: r for r in grouped_statistics(hist(spark, kind, groups), broadcast).collect()}
    assert set(got) == set(groups)
    for z, own in groups.items():
        exact = sorted(Fraction(v) for v in own)
        n, r = len(own), got[z]
        assert (r.n, Fraction(r.min), Fraction(r.max)) == (n, exact[0], exact[-1])
        middle = (exact[(n + 1) // 2 - 1] + exact[n // 2]) / 2
        assert r.median == float(middle) if kind in ("int", "bigint", "smallint", "decimal(20,0)") else close(r.median, float(middle), 1e-15), (z, r)
        most = Counter(own)
        assert Fraction(r.mode) == min(Fraction(v) for v, k in most.items() if k == max(most.values()))
        mean = sum(exact) / n
        size = float(max(abs(exact[0]), abs(exact[-1])))
        assert abs(r.mean - float(mean)) <= 1e-14 * size
        deviation = math.sqrt(float(sum(((x - mean) / Fraction(size or 1)) ** 2 for x in exact) / n)) * size
        assert abs(r.stddev - deviation) <= max(1e-10 * deviation, 4e-16 * size if kind in ("double", "decimal(38,6)") else 0), (z, r, deviation)


def test_infinite_values(spark):
    got = grouped_statistics(hist(spark, "double", {1: [math.inf, 1.0, -math.inf], 2: [math.inf, 1e308, 1e308, 5.0]}), True).collect()
    assert {r.zk: (r.min, r.max, r.median) for r in got} == {1: (-math.inf, math.inf, 1.0), 2: (5.0, math.inf, 1e308)}


def test_many_values_in_one_group(spark):
    """More distinct values than buckets, and no window over a group."""
    h = spark.range(300_000).select(F.lit(7).cast("bigint").alias("zk"), (F.col("id") * 30_000_000_000_007 - 2**62).alias("v"), (F.col("id") % 3 + 1).alias("n"))
    df = grouped_statistics(h, True)
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    r = df.first()
    weighted = st.median([k for k in range(300_000) for _ in range(k % 3 + 1)])
    assert r.n == 600_000 and r.median == float(Fraction(weighted) * 30_000_000_000_007 - 2**62)


def test_empty_and_unusable(spark):
    assert grouped_statistics(hist(spark, "int", {}), True).collect() == []
    with pytest.raises(ValueError, match="numbers"):
        grouped_statistics(spark.createDataFrame([], "zk bigint, v string, n bigint"), True)
