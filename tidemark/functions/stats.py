"""Tail probabilities and quantiles Spark has no built-in for, as plain column expressions.

All of them are fast-converging series and fractions folded with ``aggregate(sequence(...))``, so they
stay in the JVM and need no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantiles and the significance threshold.
Z_975 = 1.959963984540054
Z_ROUNDED = {90: 1.645, 95: 1.96, 99: 2.576}
SIGNIFICANCE_LEVEL = 0.05

# Pairs of terms of the continued fraction: the error is below 1e-12 up to 20,000 degrees of freedom and about
# 1e-11 at ten million.
_PAIRS = 60
# Bisection steps from an interval of 16, which holds the quantile even for one degree of freedom.
_HALVINGS = 56


def _gamma_step(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a) for a > 0: its expansion in 1/a, sixteen steps further up."""
    up = a + 16.0
    terms = ((-1, 8), (1, 128), (5, 1024), (-21, 32768), (-399, 262144), (869, 4194304), (39325, 33554432))
    series = sum((F.lit(n / d) / F.pow(up, F.lit(float(k))) for k, (n, d) in enumerate(terms, 1)), F.lit(1.0))
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(1.0), lambda acc, k: acc * (a + k) / (a + k + 0.5))
    return F.sqrt(up) * series * steps


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t with df >= 1 degrees of freedom, whole or not; null below.

    It is the regularised incomplete beta function of df / (df + t^2) at (df / 2, 1 / 2), from its continued fraction or,
    near 1, from that of the complement.  What the fraction needs is worked out once and carried along the fold.
    """
    wide, square = F.when(df >= 1, df.cast("double")), t * t
    near = wide / (wide + square) >= (wide / 2 + 1) / (wide / 2 + 2.5)
    front = F.exp(-wide / 2 * F.log1p(square / wide)) * F.sqrt(square / (wide + square)) * _gamma_step(wide / 2) / math.sqrt(math.pi)
    start = F.struct(
        F.lit(1.0).alias("f"), front.alias("front"), near.alias("near"), F.when(near, 0.5).otherwise(wide / 2).alias("a"),
        F.when(near, wide / 2).otherwise(0.5).alias("b"), (F.when(near, square).otherwise(wide) / (wide + square)).alias("x"),
    )

    def pair(s: Column, m: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.struct((1 + even / (1 + odd / s["f"])).alias("f"), *[s[c].alias(c) for c in ("front", "near", "a", "b", "x")])

    def end(s: Column) -> Column:
        part = s["front"] / s["a"] / (1 - (s["a"] + s["b"]) * s["x"] / ((s["a"] + 1) * s["f"]))
        return F.when(s["near"], 1 - part).otherwise(part)

    inside = F.aggregate(F.sequence(F.lit(_PAIRS), F.lit(1), F.lit(-1)), start, pair, end)
    return F.when(inside.isNotNull(), F.greatest(F.lit(0.0), inside))


def t_quantile_975(df: Column) -> Column:
    """The 0.975 quantile of Student's t, by bisection on the tail."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(16.0).alias("hi"), df.cast("double").alias("df"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        above = t_two_sided_p(mid, acc["df"]) > 0.05
        return F.struct(
            F.when(above, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(above, acc["hi"]).otherwise(mid).alias("hi"),
            acc["df"].alias("df"),
        )

    return F.when(df >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), start, halve)["lo"])


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x > 0: Stirling's series eight steps further up."""
    up = x + 8.0
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, 3)) + 1 / (1260 * F.pow(up, 5)) - 1 / (1680 * F.pow(up, 7))
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, k: acc + F.log(x + k))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - steps


def chi2_upper_p(x: Column, df: Column) -> Column:
    """P(X >= x) for chi-square with any df > 0: the regularised incomplete gamma function in log space.

    The series below the mean, the continued fraction above it.  Both settle within a number of terms that grows with
    the root of df.
    """
    half, shape = F.greatest(x / 2, F.lit(1e-300)), df / 2
    terms = F.sequence(F.ceil(60 + 12 * F.sqrt(shape)).cast("int"), F.lit(1), F.lit(-1))
    front = shape * F.log(half) - half
    series = F.aggregate(terms, F.lit(1.0), lambda acc, k: 1.0 + acc * half / (shape + k))
    below = 1.0 - F.exp(front - _log_gamma(shape + 1.0)) * series
    last = half + 2 * F.get(terms, F.lit(0)) + 1 - shape
    fraction = F.aggregate(terms, last, lambda acc, k: half + 2 * k - 1 - shape + k * (shape - k) / F.when(acc == 0, 1e-300).otherwise(acc))
    above = F.exp(front - _log_gamma(shape)) / fraction
    p = F.when(half < shape + 1, below).otherwise(above)
    return F.when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
