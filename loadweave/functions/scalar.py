"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN sorts above every number in Spark and poisons max/avg; a missing value is NULL here."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def flag(condition: Column) -> Column:
    """0/1 with unknown counted as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def interpolate(x: Column, points: Mapping[float, float]) -> Column:
    """Straight lines between known points, constant beyond both ends."""
    xs = sorted(points)
    result = F.lit(float(points[xs[-1]]))
    for left, right in reversed(list(zip(xs, xs[1:]))):
        slope = (points[right] - points[left]) / (right - left)
        line = F.lit(slope) * (x - F.lit(float(left))) + F.lit(float(points[left]))
        result = F.when(x < F.lit(right), line).otherwise(result)
    return F.when(x <= F.lit(xs[0]), F.lit(float(points[xs[0]]))).otherwise(result)


def linspace(start: float, stop: float, n: int) -> list[float]:
    if n == 1:
        return [float(start)]
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [float(stop)]


def normalise(weights: Sequence[float]) -> list[float]:
    total = sum(weights)
    return list(weights) if total == 0 else [w / total for w in weights]


def equal_width_bin(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Index of the half-open bin holding ``x``; ``x == hi`` gets index ``n``.

    Division can land one bin off at an edge, so the candidate is checked against the edges.
    """
    width = (hi - lo) / F.lit(n)
    raw = F.floor((x - lo) / width).cast("long")
    below = x < lo + raw * width
    above = (raw + 1 < n) & (x >= lo + (raw + 1) * width)
    moved = F.when(below, raw - 1).when(above, raw + 1).otherwise(raw)
    return F.when(x == hi, F.lit(n).cast("long")).otherwise(F.least(moved, F.lit(n - 1).cast("long")))


def resolve_column(names: Sequence[str], candidates: Sequence[str]) -> str:
    """First column, in table order, whose lower-cased name is a candidate."""
    for name in names:
        if name.lower() in candidates:
            return name
    raise ValueError(f"none of {list(candidates)} among columns {list(names)}")


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
