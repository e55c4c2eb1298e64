"""Joining load to weather, and the reports that say what the join drops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.config import JOINED_VALUES, LOCAL_ZONE, TARGET
from loadweave.functions.timefn import to_local
from loadweave.operators.weather import daily_extremes, weigh_wide


def alignment_report(left: DataFrame, right: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Counts of distinct timestamps on each side, shared, and on one side only: one shuffle."""
    marks = left.select(ts, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(ts, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    seen = marks.groupBy(ts).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(
        F.count_if(F.col("l") == 1).alias("n_left"),
        F.count_if(F.col("r") == 1).alias("n_right"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_common"),
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
    )


def only_in(left: DataFrame, right: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Distinct timestamps of ``left`` that ``right`` lacks."""
    return left.select(ts).subtract(right.select(ts))


def common(left: DataFrame, right: DataFrame, ts: str = "timestamp") -> DataFrame:
    return left.select(ts).intersect(right.select(ts))


def join_on_time(load: DataFrame, weather: DataFrame, ts: str = "timestamp", zone: str = LOCAL_ZONE) -> DataFrame:
    """Inner join on the UTC instant plus a local label; keys first, then values in fixed order."""
    keys = [c for c in load.columns if c not in (ts, TARGET)]
    values = [c for c in JOINED_VALUES if c != TARGET]
    joined = load.join(weather.select(ts, *values), ts, "inner")
    return joined.select(*keys, ts, to_local(F.col(ts), zone).alias("timestamp_central"), TARGET, *values)


def align_and_join(load: DataFrame, stations: DataFrame, ts: str = "timestamp", zone: str = LOCAL_ZONE,
                   **weights) -> DataFrame:
    """Weight the stations, add daily extremes, join to load."""
    return join_on_time(load, daily_extremes(weigh_wide(stations, ts=ts, **weights), zone, ts), ts, zone)


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count of each column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns])
    return counts.select(F.inline(rows), F.col("_n").alias("n_rows"))


def null_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows with any null among the columns."""
    hit = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.where(hit).orderBy(*order).limit(n)
