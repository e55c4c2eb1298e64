"""Queries over fitted state, requests, responses and the prediction log."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.catalog.ctes import sql
from loadweave.catalog.experiment import naive_and_trend
from loadweave.catalog.registry import query, rounded
from loadweave.catalog.tables import TEST_START_LOCAL, Daily, daily
from loadweave.config import CHAMPION, DAILY, FEATURES_V3, MODEL_NAME, PARITY_TOLERANCE, TARGET
from loadweave.operators import align, forecast, quality
from loadweave.operators.features import model_input_columns
from loadweave.operators.gaps import series_bounds
from loadweave.plans import experiment as lab
from loadweave.plans import registry, scoring
from loadweave.plans.packaged import TrendResidualModel
from loadweave.session import materialise, scratch_path
from loadweave.sources import adapters, sinks
from loadweave.streaming import scoring as live

FEATURES = [*FEATURES_V3, "holiday_freq"]
INPUTS = model_input_columns(FEATURES)
KEYS = list(DAILY.keys)


def trend_bundle(d: Daily) -> registry.Bundle:
    """Fitted state with the trend as the whole model: every number can be checked in SQL."""
    state = materialise(lab.fit_state(d.train, series_bounds(d.core, DAILY), DAILY, use_holiday=True), "state")
    return registry.Bundle(MODEL_NAME, 1, FEATURES, "v3_holiday", state, None)


def prepared(spark, sf) -> tuple[Daily, registry.Bundle]:
    d = daily(spark, sf, "full")
    return d, trend_bundle(d)


@query("fitted_state", sql(
    "select series_id, round(slope, 3) as slope, round(intercept, 3) as intercept, round(heat, 6) as heat, round(cold, 6) as cold, "
    "round(precip, 6) as precip, origin as trend_origin from dstate join dorigin using (series_id)", "dstate", "dorigin", "hol"))
def fitted_state(spark, sf):
    _, bundle = prepared(spark, sf)
    out = bundle.state.drop("holiday_freq_map")
    return rounded(rounded(out, 3, "slope", "intercept"), 6, "heat", "cold", "precip")


_ROUND = {"hour_x_temp": 6, "temp_c_roll_std_72": 4, "temp_change_vs_lag24": 6, "holiday_freq": 9, "trend_idx": 9,
          "temp_c": 6, "humidity_pct": 6, "precip_mm": 6, "tmax": 6, "tmin": 6, "tavg": 6}
_ENG = ", ".join(f"round({c}, {_ROUND[c]}) as {c}" if c in _ROUND else c for c in INPUTS)


@query("engineered_rows", sql(f"select series_id, target_timestamp, {_ENG} from eng", "eng", "hol"))
def engineered_rows(spark, sf):
    """Model-ready rows of the test period, from the fitted state alone."""
    d, bundle = prepared(spark, sf)
    out = scoring.engineer_with_state(d.test, bundle, DAILY)
    return out.withColumns({c: F.round(c, n) for c, n in _ROUND.items()})


@query("engineered_check", sql(
    "select column_name, cast(0 as bigint) as n_null, n_rows from (select count(*) as n_rows from eng), (values "
    + ", ".join(f"('{c}')" for c in INPUTS) + ") v(column_name)", "eng", "hol"))
def engineered_check(spark, sf):
    d, bundle = prepared(spark, sf)
    return align.null_report(scoring.engineer_with_state(d.test, bundle, DAILY), INPUTS)


@query("output_check", sql(
    "select 'null' as problem, 'humidity_pct' as column_name, cast(count(*) as bigint) as n from eng where dayofweek = 0 having count(*) > 0 "
    "union all select 'absent', 'tmax', null union all select 'surplus', 'note', null union all select 'text', 'note', null", "eng", "hol"))
def output_check(spark, sf):
    """Model-ready rows with a column lost, a text column added and one day's humidity missing."""
    d, bundle = prepared(spark, sf)
    rows = scoring.engineer_with_state(d.test, bundle, DAILY).select(*INPUTS).drop("tmax").withColumns({
        "humidity_pct": F.when(F.col("dayofweek") != 0, F.col("humidity_pct")), "note": F.lit("x")})
    return quality.output_problems(rows, INPUTS)


@query("contract_validation", sql(
    "select series_id, target_timestamp, case when dayofweek = 0 and humidity_pct * 3 > 100 then 'humidity_pct:range' "
    "when dayofweek = 1 then 'hour:type' when dayofweek = 2 and precip_mm > 0 then 'precip_mm:range' "
    "when dayofweek = 3 then 'load_lag_24:missing' when dayofweek = 4 then 'note:extra' "
    "when dayofweek = 5 then 'is_holiday:range,month:range' else '' end as errors from eng", "eng", "hol"))
def contract_validation(spark, sf):
    """Requests spoilt by a rule that depends on the row: each weekday breaks the contract in its own way."""
    d, bundle = prepared(spark, sf)
    rows = scoring.engineer_with_state(d.test, bundle, DAILY)
    dow = F.col("dayofweek")
    spoilt = rows.withColumns({
        "humidity_pct": F.when(dow == 0, F.col("humidity_pct") * 3).otherwise(F.col("humidity_pct")),
        "hour": F.when(dow == 1, F.col("hour") + 0.5).otherwise(F.col("hour").cast("double")),
        "precip_mm": F.when(dow == 2, -F.col("precip_mm")).otherwise(F.col("precip_mm")),
        "load_lag_24": F.when(dow != 3, F.col("load_lag_24")),
        "note": F.when(dow == 4, F.lit("x")),
        "is_holiday": F.when(dow == 5, F.lit(2)).otherwise(F.col("is_holiday")),
        "month": F.when(dow == 5, F.lit(13)).otherwise(F.col("month")),
    })
    requests = spoilt.select("series_id", scoring.request_json(spoilt, [*INPUTS, "note"], "target_timestamp").alias("payload"))
    checked = scoring.validate_json(requests, "payload", INPUTS, ["series_id"])
    return checked.select("series_id", "target_timestamp", F.array_join("errors", ",").alias("errors"))


@query("score_batch", sql(
    f"select series_id, target_timestamp, round(slope * trend_idx + intercept, 4) as predicted_load_mw, '{MODEL_NAME}' as model_name, "
    f"'1' as model_version, '{CHAMPION}' as model_alias from eng", "eng", "hol"))
def score_batch(spark, sf):
    d, bundle = prepared(spark, sf)
    responses, _ = scoring.score_batch(d.test, bundle, DAILY)
    return rounded(responses.drop("predicted_at"), 4, "predicted_load_mw")


@query("registry_round_trip", sql(
    f"select series_id, target_timestamp, round(slope * trend_idx + intercept, 4) as predicted_load_mw, '{MODEL_NAME}' as model_name, "
    f"'1' as model_version, '{CHAMPION}' as model_alias from eng", "eng", "hol"))
def registry_round_trip(spark, sf):
    """Two versions take the alias, which is then rolled back: the first is loaded and scores the test rows."""
    d, bundle = prepared(spark, sf)
    root = scratch_path(spark, "models")
    for _ in range(2):
        registry.register(spark, root, bundle.state, None, FEATURES, "trend", "v3_holiday", str(d.split.train_end), str(d.split.test_start),
                          alias=CHAMPION)
    registry.roll_back(spark, root)
    responses, _ = scoring.score_batch(d.test, registry.load_champion(spark, root), DAILY)
    return rounded(responses.drop("predicted_at"), 4, "predicted_load_mw")


@query("score_batch_summary", sql("select count(*) as n_scored, count(*) as n_rows from eng", "eng", "hol"))
def score_batch_summary(spark, sf):
    d, bundle = prepared(spark, sf)
    return scoring.batch_summary(*scoring.score_batch(d.test, bundle, DAILY))


def _requests(d: Daily, bundle: registry.Bundle) -> DataFrame:
    rows = scoring.engineer_with_state(d.test, bundle, DAILY)
    return rows.select("series_id", scoring.request_json(rows, INPUTS, "target_timestamp").alias("payload"))


@query("score_parity", sql(
    "select count(*) as n_rows, cast(0 as bigint) as n_unmatched, 0.0::double as max_abs_diff, true as matches from eng", "eng", "hol"))
def score_parity(spark, sf):
    """Typed rows and JSON requests give the same forecasts."""
    d, bundle = prepared(spark, sf)
    direct, _ = scoring.score_batch(d.test, bundle, DAILY)
    checked = scoring.validate_json(_requests(d, bundle), "payload", INPUTS, KEYS)
    via_json = scoring.predict(checked.where("is_valid").drop("errors", "is_valid", "payload"), bundle, DAILY)
    return forecast.compare_forecasts(direct, via_json, [*KEYS, scoring.TIME_FIELD], "predicted_load_mw", PARITY_TOLERANCE)


@query("champion_lookup", sql(
    "m as (select model, fold_id, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) as rmse from oof group by 1, 2) "
    "select model as model_name, case when newest > oldest then first else last end as model_version, "
    "round(case when newest > oldest then oldest else newest end, 4) as rmse, false as use_holiday_feature from ("
    "select model, cast(min(fold_id) as int) as first, cast(max(fold_id) as int) as last, arg_min(rmse, fold_id) as oldest, "
    "arg_max(rmse, fold_id) as newest from (select *, avg(rmse) over (partition by model) as a from m) where rmse <= a group by 1)",
    "oof", "hol").replace(") m as", "), m as"))
def champion_lookup(spark, sf):
    """Folds as versions: those no worse than their model's mean take the alias in turn, and it moves back to
    the first of them if the newest is worse."""
    from pyspark.sql import Window
    versions = forecast.oof_metrics(naive_and_trend(daily(spark, sf).train), ("model", "fold_id"))
    mean = F.avg("rmse").over(Window.partitionBy("model"))  # one row per fold in each group
    rows = versions.select(
        F.col("model").alias("model_name"), F.col("fold_id").alias("model_version"), "rmse",
        (F.col("rmse") <= mean).alias("good"), F.array(*[F.lit(c) for c in FEATURES_V3]).alias("features"))
    taken = rows.where("good").select("model_name", "model_version", F.col("model_version").alias("set_no"), "rmse")
    back = (taken.groupBy("model_name")
            .agg(F.min_by(F.struct("model_version", "rmse"), "set_no").alias("old"), F.max_by(F.struct("set_no", "rmse"), "set_no").alias("new"))
            .where("new.rmse > old.rmse").select("model_name", "old.model_version", (F.col("new.set_no") + 1).alias("set_no")))
    aliases = taken.drop("rmse").unionByName(back).withColumn("alias", F.lit(CHAMPION))
    out = registry.champion_rows(rows, aliases)
    return out.select("model_name", "model_version", F.round("rmse", 4).alias("rmse"), "use_holiday_feature")


_LOG = "round(slope * trend_idx + intercept"


@query("idempotent_log", sql(
    f"select series_id, target_timestamp, '1' as model_version, {_LOG}, 4) as predicted_load_mw from eng union all "
    f"select series_id, target_timestamp, '2', {_LOG}, 4) from eng where dayofweek < 3", "eng", "hol"))
def idempotent_log(spark, sf):
    """Two overlapping batches into one log: repeated keys, in a batch or across batches, change nothing."""
    d, bundle = prepared(spark, sf)
    rows = scoring.predict(scoring.engineer_with_state(d.test, bundle, DAILY), bundle, DAILY)
    first = materialise(sinks.prediction_log_rows(rows, INPUTS, MODEL_NAME, "1", KEYS), "batch")
    again = first.withColumn("predicted_load_mw", F.col("predicted_load_mw") + 1)
    some = sinks.prediction_log_rows(rows.where("dayofweek < 3"), INPUTS, MODEL_NAME, "2", KEYS)
    lower = some.withColumn("predicted_load_mw", F.col("predicted_load_mw") - 5)
    path = scratch_path(spark, "predictions")
    key = (*KEYS, "target_timestamp", "model_version")
    sinks.insert_or_ignore(first, path, key)
    # the first arrival is neither the lowest nor the first row of the batch
    batch = reduce(DataFrame.unionByName, (df.withColumn("arrived", F.lit(n)) for n, df in ((3, lower), (2, again), (1, some))))
    sinks.insert_or_ignore(batch, path, key, "arrived")
    sinks.insert_or_ignore(again, path, key)
    log = spark.read.parquet(path)
    return rounded(log.select("series_id", "target_timestamp", "model_version", "predicted_load_mw"), 4, "predicted_load_mw")


_ACCURACY = sql(
    "select '1' as model_version, count(*) as n_predictions, count(y) as n_actuals, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, "
    "round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) * 100, 6) as mape from (select slope * trend_idx + intercept as p, "
    "dl.actual_load_mw as y from eng left join dl on dl.series_id = eng.series_id and dl.timestamp = target_timestamp)", "eng", "dl", "hol")


@query("prediction_accuracy", _ACCURACY)
def prediction_accuracy(spark, sf):
    """Logged predictions beside the load that arrived later."""
    d, bundle = prepared(spark, sf)
    rows = scoring.predict(scoring.engineer_with_state(d.test, bundle, DAILY), bundle, DAILY)
    log = sinks.prediction_log_rows(rows, INPUTS, MODEL_NAME, "1", KEYS)
    actuals = adapters.daily_load(spark, sf).withColumnRenamed("timestamp", "target_timestamp")
    out = forecast.prediction_accuracy(log, actuals, [*KEYS, "target_timestamp"], ["model_version"])
    return rounded(rounded(out, 4, "rmse"), 6, "mape")


@query("late_actuals", _ACCURACY)
def late_actuals(spark, sf):
    """The same when predictions and loads land file by file, the loads behind the predictions, and meet in a stream."""
    d, bundle = prepared(spark, sf)
    rows = scoring.predict(scoring.engineer_with_state(d.test, bundle, DAILY), bundle, DAILY)
    log = materialise(sinks.prediction_log_rows(rows, INPUTS, MODEL_NAME, "1", KEYS), "log").select(
        *KEYS, "target_timestamp", "model_version", "predicted_load_mw")
    actuals = materialise(adapters.daily_load(spark, sf).withColumnRenamed("timestamp", "target_timestamp"), "loads").select(
        *KEYS, "target_timestamp", TARGET)
    # files in order of time: predictions by quarter, loads of the years before them first
    quarter = F.year("target_timestamp") * 4 + F.quarter("target_timestamp")
    first = 4 * int(TEST_START_LOCAL[:4]) + 1
    late = [quarter == first, quarter == first + 1, quarter == first + 2, quarter >= first + 3]
    early = [quarter < first - 12, quarter.between(first - 12, first - 1)]
    landed = {}
    for name, df, parts in (("log", log, [quarter <= first, *late[1:]]), ("loads", actuals, early + late)):
        landed[name] = scratch_path(spark, name)
        for part in parts:
            df.where(part).coalesce(1).write.mode("append").parquet(landed[name])
    streams = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(landed[name])
               for name, df in (("log", log), ("loads", actuals))]
    out = scratch_path(spark, "matched")
    key = [*KEYS, "target_timestamp"]
    live.match_actuals(*streams, key, "target_timestamp", TARGET, out, scratch_path(spark, "offsets")).awaitTermination()
    settled = spark.read.parquet(out).where(F.col(TARGET).isNotNull())
    return rounded(rounded(forecast.prediction_accuracy(log, settled, key, ["model_version"]), 4, "rmse"), 6, "mape")


@query("registered_champion", sql(
    "b as (select regr_slope(res, load_lag_168) as b1, regr_intercept(res, load_lag_168) as b0 from (select t.load_lag_168, "
    "actual_load_mw - (slope * trend_idx + intercept) as res from dtrain t join dstate s on s.series_id = t.series_id)) "
    "select series_id, target_timestamp, round(slope * trend_idx + intercept + b0 + b1 * load_lag_168, 2) as predicted_load_mw, "
    f"'{MODEL_NAME}' as model_name, '1' as model_version, '{CHAMPION}' as model_alias, true as stamped from eng, b", "eng", "dtrain", "dstate", "hol"
).replace(") b as", "), b as"))
def registered_champion(spark, sf):
    """Trend plus a linear residual model, fitted, stored with its state, loaded back by its alias, scoring the test rows."""
    d = daily(spark, sf, "full")
    model, _ = lab.final_fit(d.train, d.test, DAILY, ["load_lag_168"], lab.linear_model, False)
    state = lab.fit_state(d.train, series_bounds(d.core, DAILY), DAILY, use_holiday=True)
    root = scratch_path(spark, "models")
    start = datetime.now(timezone.utc).replace(tzinfo=None)
    registry.register(spark, root, state, model, FEATURES, "trend_plus_linear", "v3_holiday",
                      str(d.split.train_end), str(d.split.test_start), alias=CHAMPION)
    responses, _ = scoring.score_batch(d.test, registry.load_champion(spark, root), DAILY)
    made = F.col("predicted_at").cast("timestamp_ntz").between(F.lit(start), F.lit(start + timedelta(hours=2)))
    return rounded(responses.withColumn("stamped", F.coalesce(made, F.lit(False))).drop("predicted_at"), 2, "predicted_load_mw")


@query("stored_model_parity", sql(
    "select count(*) as n_rows, cast(0 as bigint) as n_unmatched, 0.0::double as max_abs_diff, true as matches from eng", "eng", "hol"))
def stored_model_parity(spark, sf):
    """Trend plus a linear residual model as one Spark model: forecasts before it was stored and after it was loaded."""
    d = daily(spark, sf, "full")
    residual, _ = lab.final_fit(d.train, d.test, DAILY, ["load_lag_168"], lab.linear_model, False)
    state = materialise(lab.fit_state(d.train, series_bounds(d.core, DAILY), DAILY, use_holiday=True), "state")
    rows = scoring.engineer_with_state(d.test, registry.Bundle(MODEL_NAME, 1, FEATURES, "v3_holiday", state, residual), DAILY)
    model, path = TrendResidualModel(state=state, residual=residual, keyCols=KEYS), scratch_path(spark, "model")
    model.save(path)
    return forecast.compare_forecasts(model.transform(rows), TrendResidualModel.load(path).transform(rows), [*KEYS, scoring.TIME_FIELD],
                                      "predicted_load_mw", PARITY_TOLERANCE)


def _stream_requests(spark, requests: DataFrame) -> DataFrame:
    path = scratch_path(spark, "requests")
    requests.write.json(path)
    return live.read_requests(spark, path, "series_id string, payload string")


@query("stream_score", sql(
    f"select series_id, target_timestamp, '1' as model_version, {_LOG}, 4) as predicted_load_mw from eng where dayofweek <> 6", "eng", "hol"))
def stream_score(spark, sf):
    """Requests as a stream: Sunday's are spoilt and refused, the rest are scored and logged once."""
    d, bundle = prepared(spark, sf)
    rows = scoring.engineer_with_state(d.test, bundle, DAILY).withColumn(
        "humidity_pct", F.when(F.col("dayofweek") == 6, F.lit(101.0)).otherwise(F.col("humidity_pct")))
    requests = rows.select("series_id", scoring.request_json(rows, INPUTS, "target_timestamp").alias("payload"))
    root = scratch_path(spark, "stream")
    stream = _stream_requests(spark, requests.unionByName(requests))
    live.score_stream(stream, bundle, DAILY, root, scratch_path(spark, "offsets")).awaitTermination()
    log = spark.read.parquet(f"{root}/predictions")
    return rounded(log.select("series_id", "target_timestamp", "model_version", "predicted_load_mw"), 4, "predicted_load_mw")


@query("stream_dead_letter", sql(
    "select series_id, count(*) as n_refused, 'humidity_pct:range' as errors from eng where dayofweek = 6 group by 1", "eng", "hol"))
def stream_dead_letter(spark, sf):
    d, bundle = prepared(spark, sf)
    rows = scoring.engineer_with_state(d.test, bundle, DAILY).withColumn(
        "humidity_pct", F.when(F.col("dayofweek") == 6, F.lit(101.0)).otherwise(F.col("humidity_pct")))
    requests = rows.select("series_id", scoring.request_json(rows, INPUTS, "target_timestamp").alias("payload"))
    root = scratch_path(spark, "stream")
    live.score_stream(_stream_requests(spark, requests), bundle, DAILY, root, scratch_path(spark, "offsets")).awaitTermination()
    refused = spark.read.parquet(f"{root}/dead_letter")
    return refused.groupBy("series_id", F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n_refused"))


@query("stream_dedup", "select distinct user_id, date_trunc('hour', ts) as event_hour from events")
def stream_dedup(spark, sf):
    """First event of each user and hour, from the event table landed as files that a stream reads one at a time;
    hours and users are spread over all of them, so most repeats meet across batches and many come late."""
    landed = scratch_path(spark, "landed")
    spark.read.parquet(f"{sf}/events.parquet").repartition(6, "event_id").write.parquet(f"{landed}/events.parquet")
    events = live.read_table(spark, landed, "events.parquet", files_per_batch=1)
    hours = events.select("user_id", adapters.hour_of_event().alias("event_hour"))
    out = scratch_path(spark, "dedup")
    live.log_distinct(hours, out, ["user_id", "event_hour"], "event_hour", scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("user_id", F.col("event_hour").cast("timestamp_ntz").alias("event_hour"))
