"""Derived columns: calendar, lags, rolling statistics, fitted flags and frequencies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.config import (
    COLD_Q, CORE_COLUMNS, HEAT_Q, LOCAL_ZONE, PRECIP_Q, TARGET, Layout,
)
from loadweave.functions.scalar import either, flag
from loadweave.functions.timefn import to_local, weekday_of, is_weekend, years_since
from loadweave.operators.blocks import change_from, on_clock, on_rows, rolling_std, time_lags
from loadweave.operators.folds import Fold, fit_by_fold
from loadweave.operators.gaps import gap_fill, on_grid
from loadweave.operators.holidays import add_holiday_name, calendar_bounds, with_holiday_name

HOUR_LAGS = {"load_lag_24": (TARGET, 24), "load_lag_168": (TARGET, 168)}
DAY_LAGS = {"load_lag_24": (TARGET, 1), "load_lag_168": (TARGET, 7)}


def calendar_features(df: DataFrame, local: str = "timestamp_central") -> DataFrame:
    clock = F.col(local)
    return df.withColumns({
        "hour": F.hour(clock),
        "dayofweek": weekday_of(clock),
        "month": F.month(clock),
        "is_weekend": is_weekend(clock),
    })


def holiday_flag(df: DataFrame, layout: Layout, zone: str = LOCAL_ZONE) -> DataFrame:
    """1 on federal holidays within the span of the series."""
    named = with_holiday_name(df, layout, calendar_bounds(df, layout, zone), zone, "_holiday")
    return named.withColumn("is_holiday", F.col("_holiday").isNotNull().cast("int")).drop("_holiday")


def core_features(joined: DataFrame, layout: Layout, lags: Mapping[str, tuple[str, int]] = HOUR_LAGS,
                  zone: str = LOCAL_ZONE, aligned: bool = False) -> DataFrame:
    """Calendar, holiday and lag features of a joined table, warm-up and gap rows removed.

    Rows off the grid that a series' first timestamp sets are left out, as a gap fill would; pass
    ``aligned=True`` when all timestamps are known to be whole steps.

    Lags are looked up on the clock, which gives what shifting a gap-filled series would. Rows a
    gap fill would insert have no load and are dropped at the end anyway, so they are never made.
    The holiday calendar starts with the series, which only matters on its first local day; when a
    lag reaches back further than a day, no row of that day survives and the span is not needed.
    """
    if not aligned:
        joined = on_grid(joined, layout)
    labelled = joined.withColumn("timestamp_central", to_local(F.col(layout.ts), zone))
    lagged = calendar_features(time_lags(labelled, layout, lags).dropna(subset=[TARGET, *lags]))
    longest_day = 25 * 3600
    if max(n for _, n in lags.values()) * layout.step > longest_day:
        named = add_holiday_name(lagged, F.to_date("timestamp_central"), "_holiday")
    else:
        named = with_holiday_name(lagged, layout, calendar_bounds(joined, layout, zone), zone, "_holiday")
    flagged = named.withColumn("is_holiday", F.col("_holiday").isNotNull().cast("int"))
    return flagged.select(*layout.keys, *CORE_COLUMNS)


def core_features_filled(joined: DataFrame, layout: Layout, lags: Mapping[str, tuple[str, int]] = HOUR_LAGS,
                         zone: str = LOCAL_ZONE) -> DataFrame:
    """The same table with the gap rows made visible first and kept until the final drop."""
    filled = gap_fill(joined, layout, zone)
    lagged = time_lags(filled, layout, lags)
    flagged = holiday_flag(calendar_features(lagged), layout, zone)
    return flagged.dropna(subset=[TARGET, *lags]).select(*layout.keys, *CORE_COLUMNS)


def with_trend_idx(df: DataFrame, layout: Layout, origin: Column | None = None) -> DataFrame:
    """Years of 365 days since the origin; by default each series' own first row."""
    ts = F.col(layout.ts)
    if origin is not None:
        return df.withColumn("trend_idx", years_since(ts, origin))
    first = df.groupBy(*layout.keys).agg(F.min(layout.ts).alias("_origin"))
    return df.join(first, list(layout.keys)).withColumn("trend_idx", years_since(ts, F.col("_origin"))).drop("_origin")


def add_base_features(df: DataFrame, layout: Layout, window: int = 72, minimum: int = 24, back: int = 24,
                      mode: str = "rows") -> DataFrame:
    """Trend index, hour x temperature, rolling temperature deviation, change against ``back`` rows ago.

    ``mode="rows"`` counts rows, skipping over holes left by dropped hours; ``mode="time"`` counts
    hours on the clock.
    """
    rows = mode == "rows"
    frames = {
        "temp_c_roll_std_72": rolling_std("temp_c", window, minimum, rows),
        "temp_change_vs_lag24": change_from("temp_c", back, rows),
    }
    halo = max(window - 1, back)
    crossed = df.withColumn("hour_x_temp", F.col("hour") * F.col("temp_c"))
    if not rows:
        return on_clock(with_trend_idx(crossed, layout), layout, halo, frames)
    framed = on_rows(crossed, layout, halo, frames, origin="_origin")
    return with_trend_idx(framed, layout, F.col("_origin")).drop("_origin")


def drop_warmup(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["temp_c_roll_std_72", "temp_change_vs_lag24"])


def attach_holiday_names(df: DataFrame, train: DataFrame, layout: Layout, zone: str = LOCAL_ZONE,
                         calendar_scope: str = "train") -> DataFrame:
    """Holiday names drawn from the train span (``"train"``) or from the whole frame (``"full"``)."""
    span = train if calendar_scope == "train" else df
    return with_holiday_name(df, layout, calendar_bounds(span, layout, zone), zone)


# --- Fit on train rows only, apply anywhere ---------------------------------------------------

def threshold_stats(heat: float = HEAT_Q, cold: float = COLD_Q, precip: float = PRECIP_Q
                    ) -> dict[str, Callable[[Callable[[Column], Column]], Column]]:
    """Exact quantiles per group. The groups are (series, fold): one row per step of the fold's
    train range at most, so the exact aggregate holds a bounded number of values."""
    return {
        "heat": lambda m: F.percentile(m(F.col("tmax")), heat),
        "cold": lambda m: F.percentile(m(F.col("tmin")), cold),
        "precip": lambda m: F.percentile(m(F.col("precip_mm")), precip),
    }


def fit_thresholds(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    return train.groupBy(*keys).agg(*[fn(lambda c: c).alias(k) for k, fn in threshold_stats().items()])


def extreme_event_columns(heat: Column, cold: Column, precip: Column) -> dict[str, Column]:
    hot, chill = flag(F.col("tmax") > heat), flag(F.col("tmin") < cold)
    return {
        "is_extreme_heat_event": hot,
        "is_extreme_cold_event": chill,
        "is_holiday_x_extreme": F.col("is_holiday") * either(hot, chill),
        "is_high_precip_event": flag(F.col("precip_mm") > precip),
    }


def apply_thresholds(df: DataFrame, fitted: DataFrame, on: Sequence[str]) -> DataFrame:
    flags = extreme_event_columns(F.col("heat"), F.col("cold"), F.col("precip"))
    return df.join(fitted, list(on)).withColumns(flags).drop("heat", "cold", "precip")


def fit_holiday_freq(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each holiday among the holiday rows."""
    counts = train.where(F.col("holiday_name").isNotNull()).groupBy(*keys, "holiday_name").agg(
        F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))  # at most eleven rows per group
    return counts.select(*keys, "holiday_name", (F.col("_n") / total).alias("holiday_freq"))


def fit_holiday_freq_by_fold(df: DataFrame, folds: Sequence[Fold], keys: Sequence[str],
                             ts: str = "timestamp") -> DataFrame:
    named = df.where(F.col("holiday_name").isNotNull())
    counts = fit_by_fold(named, folds, [*keys, "holiday_name"], {"_n": lambda m: F.count(m(F.lit(1)))}, ts)
    total = F.sum("_n").over(Window.partitionBy(*keys, "fold_id"))
    return (
        counts.where(F.col("_n") > 0)
        .select(*keys, "fold_id", "holiday_name", (F.col("_n") / total).alias("holiday_freq"))
    )


def apply_holiday_freq(df: DataFrame, fitted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Known holiday -> its share; no holiday or one unseen in training -> 0.

    The shares are folded into one map per group first, so rows without a holiday do not meet in
    one join key.
    """
    maps = fitted.groupBy(*on).agg(
        F.map_from_entries(F.collect_list(F.struct("holiday_name", "holiday_freq"))).alias("_freq"))
    joined = df.join(maps, list(on), "left")
    known = F.when(F.col("holiday_name").isNotNull(), F.try_element_at("_freq", F.col("holiday_name")))
    return joined.withColumn("holiday_freq", F.coalesce(known, F.lit(0.0))).drop("_freq")


@dataclass(frozen=True)
class FoldFeature:
    """A feature fitted per fold: ``fit(train_df, folds, keys)`` and ``apply(df, fitted, on)``."""

    name: str
    fit: Callable[[DataFrame, Sequence[Fold], Sequence[str]], DataFrame]
    apply: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]


EXTREME_EVENTS = FoldFeature(
    "extreme_events", lambda df, folds, keys: fit_by_fold(df, folds, keys, threshold_stats()), apply_thresholds)
HOLIDAY_FREQ = FoldFeature("holiday_freq", fit_holiday_freq_by_fold, apply_holiday_freq)


def apply_fold_features(rows: DataFrame, source: DataFrame, folds: Sequence[Fold], keys: Sequence[str],
                        chain: Sequence[FoldFeature]) -> DataFrame:
    """Fit each feature of the chain on ``source`` per fold and apply it to ``rows`` by (keys, fold)."""
    on = [*keys, "fold_id"]
    return reduce(lambda df, f: f.apply(df, f.fit(source, folds, keys), on), chain, rows)


# --- Scoring side -----------------------------------------------------------------------------

def model_input_columns(features: Sequence[str]) -> list[str]:
    return [*features, "trend_idx"]
