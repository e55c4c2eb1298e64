"""Forecast error measures as aggregate expressions over (actual, forecast) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the smallest denominator used for percentage errors (double epsilon).
TINY = 2.220446049250313e-16


def squared_error(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def percentage_error(y: Column, p: Column) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(TINY))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(squared_error(y, p)))


def mape(y: Column, p: Column) -> Column:
    return F.avg(percentage_error(y, p)) * 100


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def peak_mape(y: Column, p: Column, cutoff: Column) -> Column:
    """Percentage error over rows whose actual reaches the cutoff (inclusive)."""
    return F.avg(F.when(y >= cutoff, percentage_error(y, p))) * 100
