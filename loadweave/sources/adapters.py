"""Load and weather series derived from the star-schema and event tables.

Sums are taken over whole cents, so a result does not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.config import CITIES, TARGET

# Which event type plays which station.
STATION_EVENTS = {"click": "san_antonio", "view": "austin", "purchase": "round_rock", "signup": "san_marcos"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def hour_of_event() -> Column:
    return F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")


def hourly_load(spark: SparkSession, sf_dir: str, series: str | None = "event_type") -> DataFrame:
    """Hourly load per zone (``event_type``), per meter (``user_id``) or of the whole system (``None``)."""
    name = F.col(series).cast("string") if series else F.lit("system")
    return (
        table(spark, sf_dir, "events")
        .groupBy(name.alias("series_id"), hour_of_event().alias("timestamp"))
        .agg((F.sum(cents("value")) / 100.0).alias(TARGET))
    )


def station_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings per station, in long rows."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin(*STATION_EVENTS))
    city = F.lit(None).cast("string")
    for kind, name in STATION_EVENTS.items():
        city = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(city)
    k = F.get_json_object("props", "$.k").cast("long")
    n = F.count(F.lit(1))
    return events.groupBy(hour_of_event().alias("timestamp"), city.alias("city")).agg(
        (F.sum(cents("value")) / n / 200.0 - 5.0).alias("temp_c"),
        (F.sum(k) / n).alias("humidity_pct"),
        (F.sum(F.greatest(cents("value") - 10000, F.lit(0))) / n / 100.0).alias("precip_mm"),
    )


def daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily load per zone (order priority), several years long, with missing days."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"))
        .agg((F.sum(cents("o_totalprice")) / 100.0).alias(TARGET))
    )


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather: extremes over the day's return-flag groups, means over its lines."""
    n = F.count(F.lit(1))
    parts = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"), "l_returnflag",
    ).agg(
        n.alias("n"),
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("long"))).alias("q_o"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_o"),
        F.sum(cents("l_tax")).alias("tax"),
        F.sum(cents("l_discount")).alias("disc"),
    )
    total = F.sum("n")
    return parts.groupBy("timestamp").agg(
        (F.sum("q_o") / F.nullif(F.sum("n_o"), F.lit(0))).alias("temp_c"),
        (F.sum("tax") * 10.0 / total).alias("humidity_pct"),
        (F.sum("disc") / total).alias("precip_mm"),
        F.max(F.col("q") / F.col("n")).alias("tmax"),
        F.min(F.col("q") / F.col("n")).alias("tmin"),
        (F.sum("q") / total).alias("tavg"),
    )


# Census anchors moved to the years the tables cover, so that both ends lie inside the data.
REBASED_YEARS = {1996: 2016, 1998: 2018, 2000: 2020}


def rebased_population() -> dict[int, dict[str, int]]:
    from loadweave.config import POPULATION
    return {year: {c: POPULATION[source][c] for c in CITIES} for year, source in REBASED_YEARS.items()}
