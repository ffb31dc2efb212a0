"""Statistics of grouped numbers of any type, from their histogram ``(zk, v, n)``.

Nothing here gathers a group's values. All groups are worked on at once, in a
few rounds of grouped counts:

* **Median**: selection by descent. A round cuts the range that holds a middle
  rank into at most 2^16 buckets, counts the values in each, and keeps the
  bucket with the rank: its least and greatest value are the next range. The
  bucket of a value is a monotone function of it, exact for its type, so the
  ranks stay exact; 16 bits are settled a round, until a bucket is one value.
* **Moments**: the first round gives the sum, so the second can take the squares
  about the mean. Deviations of 64-bit integers are split into two limbs,
  d = h 2^32 + l with l in [-2^31, 2^31), whose products add up exactly in 38
  digits; integers, and decimals of up to 20 digits, are exact. Floating-point
  and longer decimal values are summed as doubles about the mean.
* **Mode**: the least of (-n, v), in the first round.

Every round is a partial and a final aggregate; a group's row holds at most
2 x 2^16 buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

#: Buckets of a round.
BUCKETS = 1 << 16
#: Decimals of up to this many digits have exact moments.
EXACT_DIGITS = 20
LIMB = 1 << 32

_INTEGERS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


class Numbers:
    """How values of one type are cut into buckets, and how they are summed."""

    def __init__(self, vt: DataType):
        self.type, self.name = vt, vt.typeName()
        self.real = self.name in ("float", "double")
        if not (self.real or self.name in _INTEGERS or isinstance(vt, DecimalType)):
            raise ValueError(f"statistics need numbers, not {vt.simpleString()}")
        self.decimal = isinstance(vt, DecimalType)
        self.scale = vt.scale if self.decimal else 0
        if self.decimal and vt.precision == 38 and vt.scale > 6:
            raise ValueError(f"differences of {vt.simpleString()} don't fit into 38 digits")
        self.exact = self.name in _INTEGERS or (self.decimal and vt.precision <= EXACT_DIGITS)

    @property
    def rounds(self) -> int:
        """Rounds until every bucket is one value."""
        if self.real:  # 1/16 of an octave, then the 53 bits of a number and a bit of slack
            return 5
        if self.decimal:  # and one for roundings
            return 2 + math.ceil(max(0, self.type.precision - 4) * math.log2(10) / 16)
        return max(1, _INTEGERS[self.name] // 16)

    def whole(self, v: Column) -> Column:
        """The value as a whole number: a decimal's digits (few enough to be exact)
        without its point."""
        if not self.decimal:
            return v
        return _dec(v.cast(f"decimal(38,{self.scale})") * _dec(F.lit(10**self.scale))) if self.scale else _dec(v)

    def first_bucket(self, v: Column) -> Column:
        if self.real:
            finite = F.abs(v) < float("inf")  # log2 is monotone, if not exact
            octave = F.when(finite, F.floor(F.log2(F.abs(v)) * 16) + 20_000).otherwise(40_000)
            return F.when(v == 0, 0).when(v > 0, octave).otherwise(-octave).cast("bigint")
        if self.decimal:  # the four leading digits; rounding is monotone
            return F.floor(v.cast("double") / 10.0 ** (self.type.precision - 4 - self.scale)).cast("bigint")
        return F.shiftright(v.cast("bigint"), max(0, _INTEGERS[self.name] - 16))

    def bucket(self, v: Column, lo: Column, hi: Column) -> Column:
        """Bucket of a value in [lo, hi]."""
        if self.real:
            part = (v - lo) / (hi - lo) * (BUCKETS - 1)
            return F.when(lo < hi, F.floor(part)).otherwise(0).cast("bigint")
        if self.decimal:
            unit = F.lit("1E-%d" % self.scale).cast(f"decimal(38,{self.scale})")
            return F.call_function("div", v - lo, F.floor((hi - lo) / BUCKETS, F.lit(self.scale)) + unit)
        v, lo, hi = (c.cast("bigint") for c in (v, lo, hi))
        return F.call_function("div", v - lo, F.call_function("div", hi - lo, F.lit(BUCKETS).cast("bigint")) + 1)

    # ------------------------------------------------------------ sums

    def sum(self, v: Column, n: Column) -> Column:
        """Sum of values, exact (of whole numbers) or as a double."""
        return F.sum(_dec(self.whole(v)) * _dec(n)) if self.exact else F.sum(v.cast("double") * n)

    def centre(self, s: Column, n: Column) -> Column:
        """The mean: rounded down, or as a double."""
        if not self.exact:
            return s / n
        s, n = _dec(s), _dec(n)
        return _dec((s - _dec(F.pmod(s, n))) / n)

    def squares(self, v: Column, n: Column, q: Column) -> dict[str, Column]:
        """Aggregates of the squares about the centre q."""
        if not self.exact:
            d = (v - q.cast(self.type)).cast("double")  # of decimals, the exact difference
            return {"d1": F.sum(d * n), "d2": F.sum(d * d * n)}
        d = _dec(_dec(self.whole(v)) - q)
        if self.name in ("byte", "short", "integer"):
            return {"ll": F.sum(_dec(_dec(d * d) * _dec(n)))}
        low = _dec(_dec(F.pmod(_dec(d + LIMB // 2), _dec(F.lit(LIMB)))) - LIMB // 2)
        high = _dec(_dec(d - low) / _dec(F.lit(LIMB)))
        return {k: F.sum(_dec(_dec(x * y) * _dec(n))) for k, x, y in (("hh", high, high), ("hl", high, low), ("ll", low, low))}

    def average(self, s: Column, n: Column) -> Column:
        """Mean from a :meth:`sum`."""
        return self._scaled(s.cast("double") / n.cast("double")) if self.exact else s / n

    def mean(self, n: Column, s: Column, q: Column, sums: dict[str, Column]) -> Column:
        return self.average(s, n) if self.exact else q.cast(self.type).cast("double") + sums["d1"] / n

    def deviation(self, n: Column, s: Column, sums: dict[str, Column]) -> Column:
        """Population standard deviation."""
        n, rest = n.cast("double"), None
        if self.exact:
            rest = _dec(F.pmod(_dec(s), _dec(n))).cast("double") / n
            about = sums["ll"].cast("double")
            if "hh" in sums:  # no cancellation: |l| is at most half of a limb
                about = sums["hh"].cast("double") * float(LIMB)**2 + sums["hl"].cast("double") * (2.0 * LIMB) + about
        else:
            rest, about = sums["d1"] / n, sums["d2"]
        root = F.sqrt(F.greatest(about / n - rest * rest, F.lit(0.0)))
        return self._scaled(root) if self.exact else root

    def middle(self, a: Column, b: Column) -> Column:
        """Mean of two values as a double."""
        if not self.exact:
            a, b = a.cast("double"), b.cast("double")
            return F.when(F.abs(a) + F.abs(b) < float("inf"), (a + b) / 2.0).otherwise(a / 2.0 + b / 2.0)
        return self._scaled((_dec(self.whole(a)) + _dec(self.whole(b))).cast("double") / 2.0)

    def _scaled(self, c: Column) -> Column:
        return c / float(10**self.scale) if self.scale else c


def _chosen(side: str, rank: str) -> str:
    """SQL of the bucket that holds a rank, among the sorted buckets of one side:
    ``struct(left, found)``, left being the rank within the bucket ``found``."""
    own = f"filter(buckets, b -> b.side = {side})"
    return f"""aggregate({own}, named_struct('left', {rank}, 'found', get({own}, -1)), (acc, b) -> CASE
      WHEN acc.found IS NOT NULL THEN acc
      WHEN acc.left <= b.n THEN named_struct('left', acc.left, 'found', b)
      ELSE named_struct('left', acc.left - b.n, 'found', acc.found) END)"""


def _descended(groups: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with sorted ``buckets``, ranks r1, r2 and the side of the second rank:
    the next ranges and ranks."""
    g = groups.selectExpr("zk", *keep, f"{_chosen('0', 'r1')} AS a", f"{_chosen('side2', 'r2')} AS b")
    return g.selectExpr("zk", *keep, "a.left AS r1", "a.found.lo AS lo1", "a.found.hi AS hi1",
                        "b.left AS r2", "b.found.lo AS lo2", "b.found.hi AS hi2")


def grouped_statistics(hist: DataFrame, broadcast_groups: bool) -> DataFrame:
    """``(zk, n, min, max, mean, median, mode, stddev)`` of a histogram ``(zk, v, n)``
    without NULL or NaN values, n > 0.

    ``broadcast_groups``: a row per group is small enough to be broadcast.
    Ranks, minimum, maximum, median and mode are exact for every type.
    """
    num = Numbers(hist.schema["v"].dataType)
    v, n = F.col("v"), F.col("n").cast("bigint")
    if num.real:
        hist = hist.select("zk", (v + 0.0).alias("v"), "n")  # one zero

    # Round 1, with the sum and the mode.
    bucket = F.struct(F.lit(0).alias("side"), F.col("bucket"), F.col("n"), F.col("lo"), F.col("hi"))
    counts = hist.groupBy("zk", num.first_bucket(v).alias("bucket")).agg(
        F.sum(n).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), num.sum(v, n).alias("s"), F.min(F.struct((-n).alias("n"), v)).alias("most"))
    zone = counts.groupBy("zk").agg(
        F.sum("n").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("s"), F.min("most").alias("most"),
        F.array_sort(F.collect_list(bucket)).alias("buckets"))
    facts = ["n", "min", "max", "s", "mode"]
    zone = _descended(zone.select(
        "zk", "n", "min", "max", "s", F.col("most.v").alias("mode"), "buckets", F.expr("(n + 1) div 2").alias("r1"),
        F.expr("n div 2 + 1").alias("r2"), F.lit(0).alias("side2")), facts)
    zone = zone.withColumn("q", num.centre(F.col("s"), F.col("n")))

    # Round 2 to the last; the second takes the squares about the mean as well. A
    # comparison with '<=>' or in a CASE infers no filter, so that Spark reads the
    # histogram's one exchange in every round.
    sums: list[str] = []
    for k in range(2, max(num.rounds, 2) + 1):
        t = zone.select("zk", *[F.col(c).alias(f"z_{c}") for c in zone.columns if c != "zk"])
        h = hist.join(F.broadcast(t) if broadcast_groups else t, "zk")
        one = v.between(F.col("z_lo1"), F.col("z_hi1"))
        two = v.between(F.col("z_lo2"), F.col("z_hi2"))
        side = F.when(one, 0).when(two, 1)
        place = F.when(one, num.bucket(v, F.col("z_lo1"), F.col("z_hi1"))).when(two, num.bucket(v, F.col("z_lo2"), F.col("z_hi2")))
        # in every round but the second, only values inside the ranges matter
        h = h if k == 2 else h.where(F.coalesce(one | two, F.lit(False)))
        carried = [c for c in t.columns if c != "zk"]
        squares = num.squares(v, n, F.col("z_q")) if k == 2 else {}
        h = h.groupBy("zk", side.alias("side"), place.alias("bucket")).agg(
            F.sum(n).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
            *[F.max(c).alias(c) for c in carried], *[x.alias(f"m_{c}") for c, x in squares.items()])
        listed = F.array_sort(F.collect_list(F.when(F.col("side").isNotNull(), F.struct("side", "bucket", "n", "lo", "hi"))))
        zone = h.groupBy("zk").agg(
            *[F.max(c).alias(c[2:]) for c in carried], *[F.sum(f"m_{c}").alias(c) for c in squares], listed.alias("buckets"))
        sums = sums or list(squares)
        zone = zone.withColumn("side2", F.when((F.col("lo2") > F.col("hi1")), 1).otherwise(0))
        zone = _descended(zone, [*facts, "q", *sums])
    got = {c: F.col(c) for c in sums}
    n, s = F.col("n"), F.col("s")
    settled = F.when((F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")), F.lit(True)).otherwise(
        F.raise_error(F.lit("the median's range was not settled")).cast("boolean"))
    middle = num.middle(F.col("lo1"), F.col("lo2"))
    return zone.select(
        "zk", "n", "min", "max", num.mean(n, s, F.col("q"), got).alias("mean"), F.when(settled, middle).alias("median"),
        "mode", num.deviation(n, s, got).alias("stddev"))
