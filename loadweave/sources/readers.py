"""Reading landed files: CSV, Parquet and weather JSON, always with a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.config import LOCAL_ZONE, TARGET, TIMESTAMP_NAMES, WEATHER_FIELDS
from loadweave.functions.scalar import nan_to_null, resolve_column
from loadweave.functions.timefn import ntz, parse_utc, to_local

PAYLOAD = T.StructType([T.StructField("hourly", T.StructType([
    T.StructField("time", T.ArrayType(T.StringType())),
    T.StructField("temperature_2m", T.ArrayType(T.DoubleType())),
    T.StructField("relative_humidity_2m", T.ArrayType(T.DoubleType())),
    T.StructField("precipitation", T.ArrayType(T.DoubleType())),
]))])


def read_series_csv(spark: SparkSession, path: str, values: Sequence[str], times: Sequence[str] = ("timestamp",),
                    zone: str = LOCAL_ZONE, keys: Sequence[str] = ()) -> DataFrame:
    """Columns matched by header; ``timestamp`` becomes a UTC instant, other time columns local labels.

    Spark raises if the path does not exist.
    """
    header = spark.read.option("header", True).csv(path).columns  # reads one line
    schema = T.StructType([
        T.StructField(c, T.DoubleType() if c in values else T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    parsed = [
        (parse_utc(F.col(c)) if c == "timestamp" else to_local(parse_utc(F.col(c)), zone)).alias(c) for c in times]
    return nan_to_null(raw.select(*keys, *parsed, *values))


def read_gate_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first column stays raw text, the others are numbers (or null where unreadable)."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([
        T.StructField(c, T.StringType() if i == 0 or c.startswith("timestamp") else T.DoubleType())
        for i, c in enumerate(header)])
    return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet feature table. Order is a matter of the consumer, not of the scan."""
    return nan_to_null(spark.read.parquet(path))


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path)


def read_weather_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed payloads, a record a line: (good, refused).

    ``good`` has ``hourly``, the file and the folder's partition columns; ``refused`` the record as text, the file
    and the ``problem``: json where a record cannot be read, hourly where it lacks that part.
    """
    schema = T.StructType([*PAYLOAD.fields, T.StructField("record", T.StringType())])
    rows = (spark.read.schema(schema).option("columnNameOfCorruptRecord", "record").json(path)
            .withColumn("file", F.col("_metadata.file_path")))
    problem = F.when(F.col("record").isNotNull(), "json").when(F.col("hourly").isNull(), "hourly")
    marked = rows.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem", "record"), marked.where("problem is not null").drop("hourly")


def explode_payload(df: DataFrame, payload: Column | str = "hourly", keep: Sequence[str] = ()) -> DataFrame:
    """Parallel arrays -> one row per hour. A record without ``hourly`` is an error."""
    hourly = F.col(payload) if isinstance(payload, str) else payload
    checked = F.when(hourly.isNull(), F.raise_error(F.lit("weather payload without hourly"))).otherwise(hourly)
    zipped = F.arrays_zip(*[
        F.col(f"_h.{name}").alias(name)
        for name in ("time", "temperature_2m", "relative_humidity_2m", "precipitation")])
    rows = df.withColumn("_h", checked).select(*keep, F.inline(zipped))
    return nan_to_null(rows.select(
        *keep, parse_utc(F.col("time")).alias("timestamp"), F.col("temperature_2m").alias("temp_c"),
        F.col("relative_humidity_2m").alias("humidity_pct"), F.col("precipitation").alias("precip_mm")))


def _utc(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return parse_utc(F.col(column))
    return F.col(column).cast("timestamp_ntz")


def normalise_load(df: DataFrame, zone_column: str = "south_central") -> DataFrame:
    """One zone of a landed load table as ``(timestamp, actual_load_mw)``."""
    ts = resolve_column(df.columns, TIMESTAMP_NAMES)
    if zone_column not in df.columns:
        raise ValueError(f"no column {zone_column!r} among {df.columns}")
    return df.select(_utc(df, ts).alias("timestamp"), F.col(zone_column).cast("double").alias(TARGET))


def normalise_all_zones(df: DataFrame, zones: Sequence[str]) -> DataFrame:
    """Every zone column as its own series, in one pass."""
    ts = resolve_column(df.columns, TIMESTAMP_NAMES)
    rows = F.array(*[F.struct(F.lit(z).alias("series_id"), F.col(z).cast("double").alias(TARGET)) for z in zones])
    return df.select(_utc(df, ts).alias("timestamp"), F.inline(rows)).select("series_id", "timestamp", TARGET)


def between_dates(df: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """Rows of whole days from ``start`` to ``end``, both included; pushed down to the scan."""
    upper = F.lit(end).cast("date") + F.expr("INTERVAL 1 DAY")
    return df.where((F.col(ts) >= ntz(start)) & (F.col(ts) < upper.cast("timestamp_ntz")))


def with_weather_names(df: DataFrame, city: str) -> DataFrame:
    return df.withColumnsRenamed({f: f"{f}_{city}" for f in WEATHER_FIELDS})
