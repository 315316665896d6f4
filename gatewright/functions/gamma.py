"""The incomplete gamma function as column expressions, and the chi-square test that needs it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-17
_TINY = 1e-300


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for positive ``a``: Stirling's series at a + 10, taken down by ten factors."""
    z = a + 10.0
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
    # 1/(12 z) - 1/(360 z^3) + ..., the even Bernoulli numbers over 2k (2k - 1)
    bernoulli = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)
    series = sum((F.lit(b / (2 * k * (2 * k - 1))) / F.pow(z, F.lit(2.0 * k - 1)) for k, b in enumerate(bernoulli, 1)), F.lit(0.0))
    product = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + F.log(a + i.cast("double")))
    return stirling + series - product


def _steps(a: Column) -> Column:
    """Places of a loop that is long enough for any x: a few times the square root of ``a``, and no fewer than 300."""
    return F.sequence(F.lit(1), (F.lit(300) + F.lit(12) * F.sqrt(a)).cast("int"))


def _lower_series(a: Column, x: Column) -> Column:
    """P(a, x) over its leading factor, for x below a + 1: the sum of x^n / (a (a + 1) ... (a + n))."""
    start = F.struct((F.lit(1.0) / a).alias("sum"), (F.lit(1.0) / a).alias("term"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n.cast("double"))
        # a sum that no term changes any more stays as it is
        return F.when(s["term"] < s["sum"] * _EPS, s).otherwise(F.struct((s["sum"] + term).alias("sum"), term.alias("term")))

    return F.aggregate(_steps(a), start, step, lambda s: s["sum"])


def _upper_fraction(a: Column, x: Column) -> Column:
    """Q(a, x) over its leading factor, for x from a + 1 on: Legendre's continued fraction from its head on."""
    b = x + 1.0 - a
    d = F.lit(1.0) / b
    start = F.struct(b.alias("b"), F.lit(1 / _TINY).alias("c"), d.alias("d"), d.alias("h"), F.lit(2.0).alias("by"))

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(s: Column, i: Column) -> Column:
        n = i.cast("double")
        part, b = n * (a - n), s["b"] + 2.0
        d, c = F.lit(1.0) / safe(part * s["d"] + b), safe(b + part / s["c"])
        moved = F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"), (d * c).alias("by"))
        return F.when(F.abs(s["by"] - 1.0) < 1e-16, s).otherwise(moved)

    return F.aggregate(_steps(a), start, step, lambda s: s["h"])


def upper_gamma(a: Column, x: Column) -> Column:
    """Q(a, x), the regularized upper incomplete gamma function; 1 for x up to 0, null for a not positive or a null."""
    a, x = a.cast("double"), x.cast("double")
    factor = F.exp(a * F.log(x) - x - log_gamma(a))
    below = F.greatest(F.lit(0.0), F.lit(1.0) - factor * _lower_series(a, x))
    value = F.when(x <= 0, 1.0).when(x < a + 1.0, below).otherwise(factor * _upper_fraction(a, x))
    return F.when((a > 0) & x.isNotNull(), value)


def chi_square_tail(x: Column, df: Column) -> Column:
    """Probability that a chi-square variable of ``df`` degrees of freedom exceeds ``x``."""
    return upper_gamma(df.cast("double") / 2.0, x.cast("double") / 2.0)
