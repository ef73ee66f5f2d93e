"""Rounding helpers (E20) and exact integer ratios.

* ``round_js``: JavaScript ``Math.round`` — half toward +infinity: ``floor(x + 0.5)``.
* ``round_py``: Python/numpy ``round`` — half to even: ``bround``.
* ``round_half_up``: Spark ``round`` (decimal half-up).
* ``ratio_pct``: ``round(scale * num / den)`` half-up on exact integers, so both engines
  agree bit for bit where a float ratio would sit on a rounding edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_js(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def round_py(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def round_half_up(c: Column, scale: int = 0) -> Column:
    return F.round(c, scale)


def int_div(a: Column, b: Column) -> Column:
    """Exact floor division of non-negative integers (NULL when b = 0):
    ``a - a mod b`` is a multiple of b, so the double quotient is exact below 2**53."""
    a = a.cast("bigint")
    b = b.cast("bigint")
    return F.when(b != 0, ((a - F.pmod(a, b)) / b).cast("bigint"))


def ratio_pct(num: Column, den: Column, scale: int = 100) -> Column:
    """round_half_up(scale * num / den) for integer num >= 0, den > 0; NULL if den <= 0."""
    n = num.cast("bigint")
    d = den.cast("bigint")
    return F.when(d > 0, int_div(F.lit(2 * scale) * n + d, F.lit(2) * d))


def exact_tenths(x: Column) -> Column:
    """Text of ``x`` >= 0 with one decimal, rounded by its exact binary value (half to even), as C and Python print it.
    (``%.1f`` of the JVM rounds the shortest decimal: 75.85 lies below 75.85 and must print 75.8.)

    ``x`` is cut into two parts of few enough bits that 20 times each is exact, so the side of the tie is."""
    tenths = F.floor(x * 10.0)
    upper = F.floor(x * 1048576.0).cast("double") / 1048576.0
    past = (upper * 20.0 - (tenths * 2 + 1)) + (x - upper) * 20.0
    up = F.when((past > 0) | ((past == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.format_string("%d.%d", F.floor((tenths + up) / 10), (tenths + up) % 10)
