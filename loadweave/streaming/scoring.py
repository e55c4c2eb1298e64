"""Requests arriving as a stream: validate, score, log once, keep what was refused."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loadweave.config import Layout
from loadweave.operators.features import model_input_columns
from loadweave.plans.registry import Bundle
from loadweave.plans.scoring import predict, respond, validate_json
from loadweave.sources.sinks import LOG_PART, insert_or_ignore, prediction_log_rows

log = logging.getLogger(__name__)
ARRIVED = "log_arrived"


def read_requests(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def read_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The Parquet table ``name`` of a folder as a stream, whether it is one file or a folder of part files."""
    path = f"{folder}/{name}"
    table = spark.read.parquet(path)
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch)
    if any(f.endswith(f"/{name}") for f in table.inputFiles()[:1]):  # a stream watches folders
        return source.option("pathGlobFilter", name).parquet(folder)
    return source.parquet(path)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that keeps its state in ``checkpoint``: the same after a restart, another for a new folder."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def log_distinct(stream: DataFrame, path: str, key: Sequence[str], time_column: str, checkpoint: str,
                 remember: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Appends the first row per key to the table at ``path``, however late it comes.

    Keys that came within ``remember`` are in the stream's state, which drops their repeats; it forgets them
    after. What the state lets pass is looked up only among rows that it may have forgotten or never knew: those
    logged longer ago, or by another query. Files of this query's recent batches hold one arrival
    time each, so their statistics rule them out. The state goes by the clock of arrival, so no row is too
    late for it; the clock must not be set back by more than ``remember``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        try:
            now = held.agg(F.max(ARRIVED)).first()[0]
            if now is None:
                return
            me = _query_id(spark, checkpoint)

            def known(table: DataFrame) -> Column:
                if ARRIVED not in table.columns:
                    return F.lit(False)
                recent = F.col(LOG_PART).startswith(f"part-{me}-") & (F.col(ARRIVED) >= F.lit(now) - F.expr(f"interval {remember}"))
                return F.coalesce(recent, F.lit(False))

            insert_or_ignore(held, path, key=key, time_column=time_column, part=f"{me}-{batch_id}", known=known)
        finally:
            held.unpersist()

    timed = stream.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, remember).dropDuplicatesWithinWatermark(list(key))
    writer = timed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def match_actuals(predictions: DataFrame, actuals: DataFrame, key: Sequence[str], time_column: str, value: str, path: str,
                  checkpoint: str, wait: str = "30 days", available_now: bool = True) -> StreamingQuery:
    """Writes each logged prediction beside its actual value, as both arrive: a stream-stream outer join on
    ``key``, of which ``time_column`` is one.

    A prediction is written once: with its actual as soon as both are there, or with a null once both streams are
    ``wait`` past its time, when its state is dropped. What is still awaited is in no row. Rows
    that come later than ``wait`` behind their stream are not matched."""
    rest = [c for c in key if c != time_column]
    at = F.col(time_column).cast("timestamp")
    left = predictions.withColumn(time_column, at).withWatermark(time_column, wait)
    right = actuals.select(*rest, at.alias(time_column), value).withWatermark(time_column, wait)
    joined = left.join(right, list(key), "left_outer").withColumn(time_column, F.col(time_column).cast("timestamp_ntz"))
    writer = joined.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_micro_batch(batch: DataFrame, batch_id: int, bundle: Bundle, layout: Layout, root: str,
                      payload: str = "payload", query_id: str | None = None) -> None:
    """Three outputs of one batch. Responses and refusals are rewritten if the batch is replayed, and so is its
    part of the log where ``query_id`` names it; the log ignores keys it already holds. A replay leaves no second row anywhere."""
    inputs = model_input_columns(bundle.features)
    checked = validate_json(batch, payload, inputs, layout.keys).persist()
    try:
        refused = checked.where(~F.col("is_valid")).select(*layout.keys, payload, "errors")
        refused.write.mode("overwrite").parquet(f"{root}/dead_letter/batch={batch_id}")
        # responses and the log both read the forecasts
        scored = predict(checked.where("is_valid").drop("errors", "is_valid", payload), bundle, layout).persist()
        respond(scored, bundle, layout.keys).write.mode("overwrite").parquet(f"{root}/responses/batch={batch_id}")
        try:
            rows = prediction_log_rows(scored, inputs, bundle.name, str(bundle.version), layout.keys)
            insert_or_ignore(rows, f"{root}/predictions", key=(*layout.keys, "target_timestamp", "model_version"),
                             part=f"{query_id}-{batch_id}" if query_id else None)
        except Exception:
            log.exception("batch %s: forecasts were made but could not be logged", batch_id)
        finally:
            scored.unpersist()
    finally:
        checked.unpersist()


def score_stream(requests: DataFrame, bundle: Bundle, layout: Layout, root: str, checkpoint: str,
                 payload: str = "payload", available_now: bool = True) -> StreamingQuery:
    """Start the scoring job over ``(keys..., payload)`` rows."""
    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: score_micro_batch(batch, batch_id, bundle, layout, root, payload, _query_id(batch.sparkSession, checkpoint)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
