"""Statistical columns and constants shared by reports. Rounding is half away from zero everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Abramowitz-Stegun 7.1.26 approximation.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def two_sided(z: Column) -> Column:
    """Two-sided normal tail probability."""
    return 1 - erf(F.abs(z) / F.sqrt(F.lit(2.0)))


def logistic(z: Column, k: float, z0: float) -> Column:
    return 100 / (1 + F.exp(-k * (z - z0)))


def correlation(x: str, y: str) -> list[Column]:
    """n, r, slope, intercept: null below three pairs or without variance; r is kept within [-1, 1]."""
    enough = (F.count("*") >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr(x, y)))
    return [F.count("*").alias("n"), F.when(enough, r).alias("r"), F.when(enough, F.regr_slope(F.col(y), F.col(x))).alias("slope"), F.when(enough, F.regr_intercept(F.col(y), F.col(x))).alias("intercept")]


def p_of_r(r: Column, n: Column) -> Column:
    """Normal approximation; a perfect fit has probability zero."""
    return F.when(F.abs(r) >= 1, 0.0).otherwise(two_sided(r * F.sqrt((n - 2) / (1 - r * r))))


ERF_SQL = "(1 - (((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}) * exp(-({x}) * ({x})))"


def two_sided_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    return f"(1 - {ERF_SQL.format(t=f'(1 / (1 + 0.3275911 * {x}))', x=x)})"
