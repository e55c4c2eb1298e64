"""From station readings to one weather signal: merge, weight by population, daily extremes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadweave.config import CITIES, LOCAL_ZONE, POPULATION, WEATHER_FIELDS
from loadweave.functions.scalar import interpolate
from loadweave.functions.timefn import local_day


def merge_stations(frames: Sequence[DataFrame], ts: str = "timestamp") -> DataFrame:
    """Inner join of one frame per station: only hours every station reports survive."""
    return reduce(lambda a, b: a.join(b, ts, "inner"), frames)


def stations_wide(readings: DataFrame, cities: Sequence[str] = tuple(CITIES), ts: str = "timestamp") -> DataFrame:
    """The same result from long rows ``(timestamp, city, fields...)`` with one shuffle."""
    wide = readings.where(F.col("city").isin(*cities)).groupBy(ts).agg(
        *[
            F.max(F.when(F.col("city") == city, F.col(field))).alias(f"{field}_{city}")
            for city in cities for field in WEATHER_FIELDS
        ],
        *[F.max((F.col("city") == city).cast("int")).alias(f"_has_{city}") for city in cities],
    )
    everyone = reduce(lambda a, b: a & b, [F.col(f"_has_{c}") == 1 for c in cities])
    return wide.where(everyone).drop(*[f"_has_{c}" for c in cities])


def stations_long(wide: DataFrame, cities: Sequence[str] = tuple(CITIES), ts: str = "timestamp") -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(c).alias("city"), *[F.col(f"{f}_{c}").alias(f) for f in WEATHER_FIELDS]) for c in cities
    ])
    return wide.select(ts, F.inline(rows))


def station_counts(readings: DataFrame, cities: Sequence[str] = tuple(CITIES), ts: str = "timestamp") -> DataFrame:
    """Hours per station beside the hours all of them share: unequal numbers mean a gap."""
    known = readings.where(F.col("city").isin(*cities))
    hours = known.groupBy(ts).agg(F.collect_set("city").alias("seen"))
    wanted = F.array(*[F.lit(c) for c in cities])
    return (
        hours.select(F.explode("seen").alias("city"),
                     F.size(F.array_except(wanted, F.col("seen"))).alias("_missing"))
        .groupBy("city")
        .agg(F.count(F.lit(1)).alias("n_hours"), F.count_if(F.col("_missing") == 0).alias("n_merged"))
    )


def population_in(year: Column, city: str, anchors: Mapping[int, Mapping[str, int]] = POPULATION) -> Column:
    return interpolate(year, {y: pops[city] for y, pops in anchors.items()})


def city_weights(year: Column, cities: Sequence[str] = tuple(CITIES),
                 anchors: Mapping[int, Mapping[str, int]] = POPULATION) -> dict[str, Column]:
    """Each city's share of the population in a year; the shares sum to one."""
    pops = {c: population_in(year, c, anchors) for c in cities}
    total = reduce(lambda a, b: a + b, pops.values())
    return {c: p / total for c, p in pops.items()}


def yearly_weights(years: DataFrame, cities: Sequence[str] = tuple(CITIES),
                   anchors: Mapping[int, Mapping[str, int]] = POPULATION) -> DataFrame:
    """One row per (year, city) for the years listed in ``years.year``."""
    shares = city_weights(F.col("year"), cities, anchors)
    rows = F.array(*[F.struct(F.lit(c).alias("city"), w.alias("weight")) for c, w in shares.items()])
    return years.select("year", F.inline(rows))


def yearly_weights_between(spark: SparkSession, start: int, end: int, cities: Sequence[str] = tuple(CITIES),
                           anchors: Mapping[int, Mapping[str, int]] = POPULATION) -> DataFrame:
    years = spark.range(start, end + 1).select(F.col("id").cast("int").alias("year"))
    return yearly_weights(years, cities, anchors)


def years_covered(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Every calendar year (UTC) between the first and the last row."""
    return (
        df.agg(F.min(F.year(ts)).alias("a"), F.max(F.year(ts)).alias("z"))
        .select(F.explode(F.sequence("a", "z")).alias("year"))
    )


def weigh_wide(wide: DataFrame, cities: Sequence[str] = tuple(CITIES), ts: str = "timestamp",
               anchors: Mapping[int, Mapping[str, int]] = POPULATION) -> DataFrame:
    """Population-weighted fields from per-city columns: no shuffle, null if any city is null.

    The weights follow the UTC year of the row.
    """
    shares = city_weights(F.year(ts), cities, anchors)
    return wide.withColumns({
        field: reduce(lambda a, b: a + b, [F.col(f"{field}_{c}") * shares[c] for c in cities])
        for field in WEATHER_FIELDS
    })


def weigh_long(readings: DataFrame, cities: Sequence[str] = tuple(CITIES), ts: str = "timestamp",
               anchors: Mapping[int, Mapping[str, int]] = POPULATION) -> DataFrame:
    """The same from long rows: one aggregation; hours lacking a city drop out."""
    shares = city_weights(F.year(ts), cities, anchors)
    weight = reduce(
        lambda other, c: F.when(F.col("city") == c, shares[c]).otherwise(other), cities, F.lit(None).cast("double")
    )
    known = readings.where(F.col("city").isin(*cities)).withColumn("_w", weight)
    n = len(cities)
    return (
        known.groupBy(ts)
        .agg(F.count(F.lit(1)).alias("_cities"), *[
            F.when(F.count(f) == n, F.sum(F.col(f) * F.col("_w"))).alias(f) for f in WEATHER_FIELDS
        ])
        .where(F.col("_cities") == n).drop("_cities")
    )


def daily_extremes(df: DataFrame, zone: str = LOCAL_ZONE, ts: str = "timestamp", value: str = "temp_c",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Highest, lowest and mean value of each local day on every row of that day.

    A window over (keys, day) does it in one shuffle; a day has at most 25 hours, so groups are small.
    """
    day = Window.partitionBy(*keys, "_day")
    return (
        df.withColumn("_day", local_day(F.col(ts), zone))
        .withColumns({
            "tmax": F.max(value).over(day), "tmin": F.min(value).over(day), "tavg": F.avg(value).over(day),
        })
        .drop("_day")
    )


def daily_table(df: DataFrame, zone: str = LOCAL_ZONE, ts: str = "timestamp", value: str = "temp_c",
                keys: Sequence[str] = ()) -> DataFrame:
    """The daily aggregates alone, one row per local day."""
    return df.groupBy(*keys, local_day(F.col(ts), zone).alias("day")).agg(
        F.max(value).alias("tmax"), F.min(value).alias("tmin"), F.avg(value).alias("tavg")
    )
