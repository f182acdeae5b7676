"""Column expressions shared by the profiler, the audit and the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIVE_TOLERANCE = 0.01


def rate(condition: Column) -> Column:
    """Share of rows meeting a condition; NULL (not 0) when there are no rows."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def within_tolerance(real: Column, claimed: Column) -> Column:
    """Relative error of at most 1 %; a real value of zero is compared against 1e-8."""
    scale = F.when(real == 0, F.lit(1e-8)).otherwise(F.abs(real))
    return F.abs(claimed - real) / scale <= RELATIVE_TOLERANCE


def adjusted_skew(column: Column) -> Column:
    """Sample skewness G1; 0.0 on a constant column, NULL below three values."""
    n = F.count(column).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(F.count(column) >= 3, F.coalesce(F.skewness(column) * factor, F.lit(0.0)))


def adjusted_kurtosis(column: Column) -> Column:
    """Sample excess kurtosis G2; 0.0 on a constant column, NULL below four values."""
    n = F.count(column).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    value = factor * ((n + 1) * F.kurtosis(column) + 6.0)
    return F.when(F.count(column) >= 4, F.coalesce(value, F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; NULL below two pairs or on a constant.

    ``F.corr`` divides by zero under ANSI mode when a side is constant, hence the explicit form.
    """
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))
    return F.when(value > 1.0, 1.0).when(value < -1.0, -1.0).otherwise(value)
