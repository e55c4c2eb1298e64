import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.config import FEATURES_V3, FIELD_SPECS, HOURLY, PARITY_TOLERANCE, RAW_REQUIRED
from loadweave.operators import forecast
from loadweave.operators.features import model_input_columns
from loadweave.plans.packaged import TrendResidualModel
from loadweave.plans import experiment as lab, registry, scoring
from loadweave.session import scratch_path
from loadweave.sources import readers, sinks
from loadweave.streaming import scoring as live
from test_models import daily

FEATURES = [*FEATURES_V3, "holiday_freq"]
INPUTS = model_input_columns(FEATURES)
VALID = {n: (1 if kind == "int" else 0.5) for n, (kind, _, _) in FIELD_SPECS.items()}
WHEN = "2024-05-01T10:00:00+00:00"


def check(spark, body):
    df = spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body),)], "payload string")
    return scoring.validate_json(df, "payload", INPUTS).first()


def test_contract(spark):
    good = {**VALID, "target_timestamp": WHEN}
    row = check(spark, good)
    assert row["is_valid"] and str(row["target_timestamp"]) == "2024-05-01 10:00:00" and row["hour"] == 1
    assert check(spark, {**good, "hour": 13.0})["is_valid"]
    bad = {
        "humidity_pct": (101, "humidity_pct:range"), "hour": (24, "hour:range"), "dayofweek": (13.7, "dayofweek:type"),
        "load_lag_24": (-1, "load_lag_24:range"), "tmax": ("warm", "tmax:type"), "precip_mm": ("NaN", "precip_mm:range"),
        "extra": (1, "extra:extra"), "target_timestamp": ("soon", "target_timestamp:type"), "month": (0, "month:range"),
    }
    for name, (value, error) in bad.items():
        row = check(spark, {**good, name: value})
        assert row["errors"] == [error] and not row["is_valid"]
    assert check(spark, {k: v for k, v in good.items() if k != "tavg"})["errors"] == ["tavg:missing"]
    assert check(spark, {k: v for k, v in good.items() if k != "target_timestamp"})["errors"] == ["target_timestamp:missing"]
    assert check(spark, "{not json")["errors"] == ["body:json"]
    assert check(spark, {**good, "hour": 99, "tavg": "x"})["errors"] == ["hour:range", "tavg:type"]
    with pytest.raises(ValueError, match="wind"):
        scoring.check_fields(["temp_c", "wind"])


def test_typed_contract_knows_nan_and_extra(spark):
    row = {**VALID, "precip_mm": float("nan")}
    df = spark.createDataFrame(pd.DataFrame([row])).withColumn("target_timestamp", F.lit("2024-05-01").cast("timestamp_ntz"))
    assert scoring.validate_columns(df, INPUTS).first()["errors"] == ["precip_mm:range"]
    named = df.withColumns({"precip_mm": F.lit(1.0), "series_id": F.lit("a")})
    assert scoring.validate_columns(named, INPUTS).first()["errors"] == ["series_id:extra"]
    assert scoring.validate_columns(named, INPUTS, ignore=["series_id"]).first()["is_valid"]
    assert "tmax:missing" in scoring.validate_columns(named.drop("tmax"), INPUTS, ignore=["series_id"]).first()["errors"]


@pytest.fixture(scope="module")
def fitted(spark):
    """A registered champion and raw rows to score."""
    _, df = daily(spark)
    train, test = df.where("timestamp < '2022-06-01'"), df.where("timestamp >= '2022-06-08'")
    origin = df.groupBy("series_id").agg(F.min("timestamp").alias("first_ts"))
    small = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}
    model, scored = lab.final_fit(train, test, HOURLY, FEATURES_V3, lambda: lab.boosted_trees(small), True)
    root = scratch_path(spark, "models")
    state = lab.fit_state(train, origin, HOURLY, True)
    for family in ("old", "trend_plus_gbt_a"):
        registry.register(spark, root, state, model, FEATURES, family, "v3_holiday", "a", "b", small, alias="champion")
    registry.register(spark, root, state, None, FEATURES, "trend", "v3_holiday", "a", "b", alias="shadow")
    return root, scored, test.select("series_id", "timestamp", *RAW_REQUIRED)


def test_champion_scores_as_the_final_fit_did(spark, fitted):
    root, scored, raw = fitted
    bundle = registry.load_champion(spark, root)
    assert bundle.version == 2 and bundle.use_holiday and registry.load_champion(spark, root, alias="shadow").version == 3
    with pytest.raises(LookupError):
        registry.load_champion(spark, root, alias="nobody")
    responses, rejected = scoring.score_batch(raw, bundle, HOURLY)
    summary = scoring.batch_summary(responses, rejected).first()
    assert rejected.count() > 0 and summary["n_rows"] == raw.count()  # random inputs break a few bounds
    same = scored.select("series_id", F.col("timestamp").alias("target_timestamp"), F.col("y_pred").alias("predicted_load_mw"))
    kept = same.join(responses.select("series_id", "target_timestamp"), ["series_id", "target_timestamp"])
    out = forecast.compare_forecasts(kept, responses, ["series_id", "target_timestamp"], "predicted_load_mw", 1e-9).first()
    assert out["matches"] and out["n_rows"] == summary["n_scored"]
    assert {"model_name", "model_version", "model_alias", "predicted_at"} <= set(responses.columns)


def test_engineering_needs_its_columns(spark, fitted):
    root, _, raw = fitted
    with pytest.raises(ValueError, match="tmax"):
        scoring.engineer_with_state(raw.drop("tmax"), registry.load_champion(spark, root), HOURLY)


def test_alias_moves_and_rolls_back(spark, fitted):
    root, _, _ = fitted
    with pytest.raises(LookupError):
        registry.roll_back(spark, root, "shadow")  # it named one version only
    with pytest.raises(LookupError):
        registry.set_alias(spark, root, 9, "shadow")
    registry.set_alias(spark, root, 1, "shadow")
    assert registry.load_champion(spark, root, alias="shadow").version == 1
    assert registry.roll_back(spark, root, "shadow") == 3
    assert registry.load_champion(spark, root, alias="shadow").version == 3
    assert registry.load_champion(spark, root).version == 2


def test_type_letters_are_no_numbers(spark):
    row = {c: 1 for c in INPUTS} | {"target_timestamp": "2024-01-01T00:00:00Z"}
    bodies = [json.dumps(row | {"temp_c": v}) for v in ("13d", "13.F ", "13", " 1.5e1 ")]
    df = spark.createDataFrame([(b,) for b in bodies], "payload string")
    got = [r["errors"] for r in scoring.validate_json(df, "payload", INPUTS).collect()]
    assert [("temp_c:type" in e) for e in got] == [True, True, False, False]


def test_stream_equals_batch_and_replay_changes_nothing(spark, fitted):
    root, _, raw = fitted
    bundle = registry.load_champion(spark, root)
    rows = scoring.engineer_with_state(raw, bundle, HOURLY)
    requests = rows.select("series_id", scoring.request_json(rows, INPUTS, "target_timestamp").alias("payload"))
    inbox, out, offsets = (scratch_path(spark, n) for n in ("inbox", "out", "offsets"))
    requests.write.json(inbox)

    def run(where):
        live.score_stream(live.read_requests(spark, inbox, "series_id string, payload string"), bundle, HOURLY, out, where).awaitTermination()

    run(offsets)
    batch, rejected = scoring.score_batch(raw, bundle, HOURLY)
    key = ["series_id", "target_timestamp"]
    log = spark.read.parquet(f"{out}/predictions")
    assert forecast.compare_forecasts(batch, log, key, "predicted_load_mw", PARITY_TOLERANCE).first()["matches"]
    assert spark.read.parquet(f"{out}/responses").count() == batch.count()
    assert spark.read.parquet(f"{out}/dead_letter").count() == rejected.count()
    assert set(json.loads(log.first()["features"])) == set(INPUTS)
    run(offsets)  # nothing new
    run(scratch_path(spark, "offsets"))  # everything again, as after a lost checkpoint
    assert spark.read.parquet(f"{out}/predictions").count() == batch.count()


def test_failed_log_keeps_the_forecast(spark, fitted, monkeypatch):
    root, _, raw = fitted
    bundle = registry.load_champion(spark, root)
    rows = scoring.engineer_with_state(raw.limit(20), bundle, HOURLY)
    batch = rows.select("series_id", scoring.request_json(rows, INPUTS, "target_timestamp").alias("payload"))
    monkeypatch.setattr(live, "insert_or_ignore", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("log is down")))
    out = scratch_path(spark, "out")
    live.score_micro_batch(batch, 0, bundle, HOURLY, out)
    done = spark.read.parquet(f"{out}/responses").count() + spark.read.parquet(f"{out}/dead_letter").count()
    assert done == 20 and not sinks.table_exists(spark, f"{out}/predictions")


def test_insert_or_ignore(spark):
    path = scratch_path(spark, "log")
    make = lambda *rows: spark.createDataFrame(rows, "target_timestamp string, model_version string, predicted_load_mw double")
    sinks.insert_or_ignore(make(("t1", "1", 10.0), ("t1", "1", 9.0), ("t2", "1", 5.0)), path)
    sinks.insert_or_ignore(make(("t1", "1", 1.0), ("t1", "2", 2.0)), path)
    got = sorted(tuple(r) for r in spark.read.parquet(path).drop(sinks.LOG_MONTH, sinks.LOG_PART).collect())
    assert got == [("t1", "1", 10.0), ("t1", "2", 2.0), ("t2", "1", 5.0)]
    late = make(("t9", "1", 1.0), ("t9", "1", 2.0)).withColumn("arrived", 5 - F.col("predicted_load_mw"))
    sinks.insert_or_ignore(late, path, arrival="arrived")
    log = spark.read.parquet(path)
    assert log.where("target_timestamp = 't9'").first()["predicted_load_mw"] == 2.0 and log.count() == 4


def test_log_opens_only_the_months_of_a_batch(spark):
    path = scratch_path(spark, "log")
    make = lambda *rows: spark.createDataFrame(rows, "target_timestamp string, model_version string, x int").withColumn(
        "target_timestamp", F.col("target_timestamp").cast("timestamp_ntz"))
    first = make(("2024-01-05 00:00:00", "1", 1), ("2024-03-07 10:00:00", "1", 2), (None, "1", 3), ("2024-03-08 10:00:00", None, 4))
    for batch in (first, first, make(("2024-03-07 10:00:00", "1", 9), ("2024-03-09 00:00:00", "1", 5))):
        sinks.insert_or_ignore(batch, path)
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]  # null keys are not added again
    folders = [f for f in os.listdir(path.removeprefix("file://")) if f.startswith(sinks.LOG_MONTH)]
    assert sorted(folders) == ["log_month=2024-01-01", "log_month=2024-03-01", "log_month=__HIVE_DEFAULT_PARTITION__"]


def test_refused_payloads(spark, tmp_path):
    (tmp_path / "city=a").mkdir()
    (tmp_path / "city=a" / "x.json").write_text('{"hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [1.5]}}\n{"hourly": {"ti\n{}\n')
    good, refused = readers.read_weather_payloads(spark, str(tmp_path))
    assert good.count() == 1 and good.first()["city"] == "a"
    assert sorted((r["problem"], r["record"]) for r in refused.collect()) == [("hourly", None), ("json", '{"hourly": {"ti')]


def test_log_distinct_drops_no_late_row(spark):
    source, out = scratch_path(spark, "events"), scratch_path(spark, "distinct")
    for hour in (20, 3, 20, 11, 0, 3):  # far beyond any watermark, out of order, one file each
        spark.sql(f"select 1 as user_id, timestamp_ntz'2024-01-01' + interval {hour} hours as h").coalesce(1).write.mode("append").parquet(source)
    folder, name = source.rsplit("/", 1)
    stream = live.read_table(spark, folder, name, files_per_batch=1)
    live.log_distinct(stream, out, ["user_id", "h"], "h", scratch_path(spark, "offsets")).awaitTermination()
    assert sorted(r["h"].hour for r in spark.read.parquet(out).collect()) == [0, 3, 11, 20]


def test_repeated_append_leaves_one_row(spark):
    """An attempt that left some of its rows is repeated under its name; a second repeat changes nothing."""
    path = scratch_path(spark, "log")
    make = lambda *rows: spark.createDataFrame(rows, "target_timestamp string, model_version string, x int")
    sinks.insert_or_ignore(make(("2024-01-01", "1", 0)), path)
    whole = make(("2024-01-01", "1", 9), ("2024-01-02", "1", 1), ("2024-02-01", "1", 2), (None, "1", 3))
    for attempt in (whole.where("x = 1"), whole, whole):
        sinks.insert_or_ignore(attempt, path, part="a")
        sinks.insert_or_ignore(attempt.where("x > 1"), path, part="b")
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]


def test_log_distinct_looks_up_only_what_its_state_may_not_know(spark, monkeypatch):
    source, out, offsets = (scratch_path(spark, n) for n in ("events", "distinct", "offsets"))
    for part in range(4):
        spark.range(60).selectExpr(f"(id * 7 + {part} * 13) % 50 as user_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id % 5) as h").coalesce(
            1).write.mode("append").parquet(source)
    want = {tuple(r) for r in spark.read.parquet(source).distinct().collect()}
    folder, name = source.rsplit("/", 1)
    looked_up, plain, fail = [], sinks.new_rows, [True]

    def watched(batch, existing, *more):
        looked_up.append(existing.count() if existing is not None else 0)
        return plain(batch, existing, *more)

    def broken(*args, **named):  # the second batch is logged, then the driver is lost
        sinks.insert_or_ignore(*args, **named)
        if fail[0] and named["part"].endswith("-1"):
            fail[0] = False
            raise RuntimeError("lost")

    def run(where, remember):
        stream = live.read_table(spark, folder, name, files_per_batch=1)
        live.log_distinct(stream, out, ["user_id", "h"], "h", where, remember).awaitTermination()

    def logged():
        rows = [tuple(r) for r in spark.read.parquet(out).select("user_id", "h").collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    monkeypatch.setattr(sinks, "new_rows", watched)
    monkeypatch.setattr(live, "insert_or_ignore", broken)
    with pytest.raises(Exception, match="lost"):
        run(offsets, "1 hour")
    run(offsets, "1 hour")  # the second batch again
    assert logged() == want and len(looked_up) >= 5 and not any(looked_up)
    looked_up.clear()
    run(scratch_path(spark, "offsets"), "1 hour")  # a query that knows nothing of the first
    assert logged() == want and all(looked_up)
    again = scratch_path(spark, "distinct")
    out = again
    run(scratch_path(spark, "offsets"), "0 seconds")  # the state may forget at once, the table does not
    assert logged() == want


def test_packaged_model(spark, hourly):
    """The model in a pipeline, alone and without a residual part, before and after it was stored."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml import Pipeline
    rows = hourly([(s, h, h, 3.0 * h % 7, h / 10) for s in "ab" for h in range(50)], ("residual", "x", "trend_idx"))
    steps = [VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="residual", predictionCol="residual_pred")]
    residual = Pipeline(stages=steps).fit(rows)
    state = spark.createDataFrame([("a", 2.0, 1.0), ("b", -1.0, 0.5)], "series_id string, slope double, intercept double")
    for part in (residual, None):
        model = TrendResidualModel(state=state, residual=part, predictionCol="p")
        want = model.transform(rows)
        path = scratch_path(spark, "model")
        model.save(f"{path}/alone")
        PipelineModel([model]).save(f"{path}/pipe")
        for back in (TrendResidualModel.load(f"{path}/alone"), PipelineModel.load(f"{path}/pipe")):
            assert forecast.compare_forecasts(want, back.transform(rows), ["series_id", "timestamp"], "p", 1e-9).first()["matches"]
        model.write().overwrite().save(f"{path}/alone")
        with pytest.raises(Exception):
            model.save(f"{path}/alone")
    trend = {r["series_id"]: r["p"] for r in want.where("trend_idx = 1").collect()}
    assert trend == {"a": 3.0, "b": -0.5} and "slope" not in want.columns


def test_actuals_meet_predictions_as_both_arrive(spark):
    """Days 1, 2, 3, 90 and 91 are forecast; day 2 has no actual, day 91 has none yet, day 60 no forecast."""
    def land(days, column):
        path = scratch_path(spark, column)
        for part in days:
            spark.createDataFrame([("a", d, float(d)) for d in part], f"s string, d int, {column} double").selectExpr(
                "s", "timestamp_ntz'2024-01-01' + make_dt_interval(d) as t", column).coalesce(1).write.mode("append").parquet(path)
        schema = spark.read.parquet(path).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    out = scratch_path(spark, "matched")
    forecasts, actuals = land([[1, 3, 2], [90], [91]], "p"), land([[1], [3], [60], [90]], "y")
    live.match_actuals(forecasts, actuals, ["s", "t"], "t", "y", out, scratch_path(spark, "offsets"), wait="10 days").awaitTermination()
    got = sorted((r["p"], r["y"]) for r in spark.read.parquet(out).collect())
    assert got == [(1.0, 1.0), (2.0, None), (3.0, 3.0), (90.0, 90.0)]
    assert dict(spark.read.parquet(out).dtypes)["t"] == "timestamp_ntz"


def test_files_round_trip(spark, tmp_path, hourly):
    df = hourly([("a", h, h) for h in range(48)], start="2023-12-31")
    sinks.write_series(df, str(tmp_path / "p"))
    assert sorted(os.listdir(tmp_path / "p"))[-2:] == ["year=2023", "year=2024"]
    part = readers.between_dates(readers.read_features(spark, str(tmp_path / "p")), "2024-01-01", "2024-01-01")
    assert part.count() == 24
    text = df.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss'+00:00'").alias("timestamp"),
                     F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss'+00:00'").alias("timestamp_central"),
                     F.when(F.col("actual_load_mw") == 3, F.lit("NaN")).otherwise(F.col("actual_load_mw")).alias("actual_load_mw"))
    sinks.write_csv(text, str(tmp_path / "c"))
    back = readers.read_series_csv(spark, str(tmp_path / "c"), ["actual_load_mw"], ["timestamp", "timestamp_central"])
    first = back.orderBy("timestamp").first()
    assert str(first["timestamp"]) == "2023-12-31 00:00:00" and str(first["timestamp_central"]) == "2023-12-30 18:00:00"
    assert back.where("actual_load_mw is null").count() == 1
    with pytest.raises(Exception):
        readers.read_series_csv(spark, str(tmp_path / "none"), ["x"])


def test_landed_payloads(spark, tmp_path):
    body = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.0, None],
                       "relative_humidity_2m": [50, 60], "precipitation": [0.0, 0.1]}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    got = readers.explode_payload(readers.read_weather_json(spark, str(tmp_path / "a.json"))).orderBy("timestamp").collect()
    assert [tuple(r)[1:] for r in got] == [(1.0, 50.0, 0.0), (None, 60.0, 0.1)]
    (tmp_path / "b.json").write_text(json.dumps({"error": True}))
    with pytest.raises(Exception, match="without hourly"):
        readers.explode_payload(readers.read_weather_json(spark, str(tmp_path / "b.json"))).collect()
    wide = spark.createDataFrame([("2024-01-01 00:00:00-06:00", 5.0, 6.0)], "Interval_Start string, south_central double, west double")
    row = readers.normalise_load(wide).first()
    assert str(row["timestamp"]) == "2024-01-01 06:00:00" and row["actual_load_mw"] == 5.0
    assert readers.normalise_all_zones(wide, ["south_central", "west"]).count() == 2
    with pytest.raises(ValueError):
        readers.normalise_load(wide.drop("south_central"))
    with pytest.raises(ValueError):
        readers.normalise_load(wide.drop("Interval_Start"))


def test_run_log(spark):
    path = scratch_path(spark, "runs")
    sinks.log_run(spark, path, "a", {"k": 1}, {"rmse": 2})
    sinks.log_run(spark, path, "b", {}, {"rmse": 1})
    best = spark.read.parquet(path).agg(F.min_by("run_name", F.col("metrics")["rmse"])).first()[0]
    assert best == "b"
