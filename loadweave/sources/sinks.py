"""Writing results: CSV, Parquet, and append-only tables with insert-or-ignore."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG_KEY = ("target_timestamp", "model_version")
LOG_MONTH, LOG_PART = "log_month", "log_part"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_series(df: DataFrame, path: str, keys: Sequence[str] = ("series_id",), ts: str = "timestamp",
                 mode: str = "overwrite") -> None:
    """Parquet laid out by year, sorted by series and time inside each file.

    Files are filled by (series, month), so a long series is spread and a scan for one series and
    period skips the other files by their statistics.
    """
    month = F.trunc(F.col(ts).cast("date"), "month")
    (
        df.withColumn("year", F.year(ts))
        .repartition(*keys, month).sortWithinPartitions("year", *keys, ts)
        .write.mode(mode).partitionBy("year").parquet(path)
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``. An aggregate, so copies of a key meet on the map side."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, "_best.*").select(*df.columns)


def new_rows(batch: DataFrame, existing: DataFrame | None, key: Sequence[str] = LOG_KEY, arrival: str | None = None) -> DataFrame:
    """Rows of the batch whose key the table does not hold yet: of each key the one that arrived first.

    ``arrival`` names the column that tells (an offset or a time); it is not kept. Without one the order of
    the rows as read counts, which a batch that has been shuffled no longer has.
    """
    order = arrival or "_arrival"
    timed = batch if arrival else batch.withColumn(order, F.monotonically_increasing_id())
    fresh = first_per_key(timed, key, (order,)).drop(order)
    if existing is None:
        return fresh
    held = existing.select(*[F.col(c).alias(f"_held_{c}") for c in key])
    # null counts as a value, else a row with a null in its key would be new at every replay
    return fresh.join(held, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in key]), "left_anti")


def insert_or_ignore(batch: DataFrame, path: str, key: Sequence[str] = LOG_KEY, arrival: str | None = None,
                     time_column: str = "target_timestamp", part: str | None = None, known: Callable[[DataFrame], Column] | None = None) -> None:
    """Append rows with unseen keys; the first arrival of a key wins, in a batch and across batches.

    The table is laid out by the month of ``time_column`` (``LOG_MONTH``; null where it is no time), and only the
    batch's months and time range are looked up: other folders are not opened. Inside a month each append has folders
    of its own. One that is named (``part``) replaces what an attempt of the same name has left and does not look
    it up, so a batch that broke off or comes twice may be repeated. ``known`` marks rows of the table whose keys the
    caller has removed from the batch already; they are not looked up. Files offer no lock between the lookup and
    the append: keep one writer per table.
    """
    spark, name = batch.sparkSession, f"part-{part or uuid.uuid4().hex}"
    dated = batch.withColumn(LOG_MONTH, F.trunc(F.expr(f"try_cast(`{time_column}` as date)"), "month"))
    existing = None
    if table_exists(spark, path):
        # as many months as the calendar has
        span = dated.agg(F.collect_set(LOG_MONTH).alias("months"), F.count_if(F.col(LOG_MONTH).isNull()).alias("timeless"),
                         F.min(time_column).alias("first"), F.max(time_column).alias("last")).first()
        month, kind = F.col(LOG_MONTH).cast("date"), batch.schema[time_column].dataType
        asked = F.lit(False)
        if span["months"]:
            asked = month.isin(span["months"]) & F.col(time_column).between(F.lit(span["first"]).cast(kind), F.lit(span["last"]).cast(kind))
        existing = spark.read.parquet(path).where(asked | month.isNull() if span["timeless"] else asked).where(F.col(LOG_PART) != name)
        if known is not None:
            existing = existing.where(~known(existing))
    fresh = new_rows(dated, existing, key, arrival).withColumn(LOG_PART, F.lit(name))
    # few files a month, but a large month in several
    (fresh.hint("rebalance", LOG_MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(LOG_MONTH, LOG_PART).parquet(path))


def prediction_log_rows(scored: DataFrame, features: Sequence[str], name: str, version: str,
                        keys: Sequence[str] = ()) -> DataFrame:
    return scored.select(
        *keys, "target_timestamp",
        F.to_json(F.struct(*features)).alias("features"),
        "predicted_load_mw",
        F.lit(name).alias("model_name"),
        F.lit(version).alias("model_version"),
    )


def log_run(spark: SparkSession, path: str, name: str, params: dict, metrics: dict) -> None:
    """Append one run record."""
    row = [(name, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})]
    schema = "run_name string, params map<string,string>, metrics map<string,double>"
    spark.createDataFrame(row, schema).withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
