import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.config import HOURLY
from loadweave.functions.timefn import local_midnight_utc, to_local, years_since
from loadweave.operators import blocks, features as feat, gaps

rng = np.random.default_rng(7)


def holey(n, share=0.2, start="2024-01-01"):
    """A series with holes, as pandas."""
    keep = np.sort(rng.choice(n, int(n * (1 - share)), replace=False))
    ts = pd.Timestamp(start) + pd.to_timedelta(keep, unit="h")
    return pd.DataFrame({"series_id": "a", "timestamp": ts, "temp_c": rng.normal(20, 5, len(keep)).round(3)})


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def back(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_row_frames_equal_unpartitioned_windows(spark):
    pdf = pd.concat([holey(900), holey(400, 0.5).assign(series_id="b")])
    out = blocks.on_rows(to_spark(spark, pdf), HOURLY, 71, {
        "std": blocks.rolling_std("temp_c", 72, 24), "diff": blocks.change_from("temp_c", 24)}, block=80)
    got = back(out, "series_id", "timestamp")
    g = pdf.sort_values(["series_id", "timestamp"]).groupby("series_id")["temp_c"]
    np.testing.assert_allclose(got["std"], g.transform(lambda s: s.rolling(72, min_periods=24).std()).to_numpy(), atol=1e-9)
    np.testing.assert_allclose(got["diff"], (pdf["temp_c"] - g.shift(24)).to_numpy(), atol=1e-9)
    assert len(got) == len(pdf)


def test_positions_are_dense_and_origin_is_first(spark):
    pdf = holey(500, 0.7)
    got = back(blocks.with_positions(to_spark(spark, pdf), HOURLY, origin="o", block=16), "timestamp")
    assert got["_pos"].tolist() == list(range(len(pdf)))
    assert (got["o"] == pdf["timestamp"].min()).all()


def test_time_lags_equal_shift_on_a_full_grid(spark):
    pdf = holey(700, 0.1)
    out = blocks.time_lags(to_spark(spark, pdf), HOURLY, {"l24": ("temp_c", 24), "l168": ("temp_c", 168)}, block=200)
    got = back(out, "timestamp")
    full = pdf.set_index("timestamp")["temp_c"].asfreq("h")
    want = pd.DataFrame({"l24": full.shift(24), "l168": full.shift(168)}).loc[pdf["timestamp"]]
    np.testing.assert_allclose(got[["l24", "l168"]].to_numpy(float), want.to_numpy(float))


def test_clock_frames_keep_holes(spark, hourly):
    df = hourly([("a", 0, 1), ("a", 1, 2), ("a", 5, 9)], ["temp_c"])
    out = blocks.on_clock(df, HOURLY, 2, {"d": blocks.change_from("temp_c", 1, rows=False),
                                          "s": blocks.rolling_std("temp_c", 3, 2, rows=False)})
    got = back(out, "timestamp")
    assert got["d"].isna().tolist() == [True, False, True]
    assert got["s"].isna().tolist() == [True, False, True]


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_gap_fill_equals_reindex(spark, block):
    pdf = pd.concat([holey(300, 0.6), holey(50, 0.5, "2024-03-09").assign(series_id="b")])
    got = back(gaps.gap_fill(to_spark(spark, pdf), HOURLY, block=block), "series_id", "timestamp")
    want = pd.concat([
        g.set_index("timestamp").reindex(pd.date_range(g["timestamp"].min(), g["timestamp"].max(), freq="h"))
        .assign(series_id=s) for s, g in pdf.groupby("series_id")])
    assert got["timestamp"].tolist() == want.index.tolist()
    np.testing.assert_array_equal(got["temp_c"].to_numpy(float), want["temp_c"].to_numpy(float))
    label = want.index.tz_localize("UTC").tz_convert("America/Chicago").tz_localize(None)
    assert (got["timestamp_central"].to_numpy() == label.to_numpy()).all()


def test_gap_fill_drops_rows_off_the_grid(spark, hourly):
    df = hourly([("a", 0, 1), ("a", 1.5, 2), ("a", 3, 3)])
    got = back(gaps.gap_fill(df, HOURLY), "timestamp")
    assert got["actual_load_mw"].fillna(-1).tolist() == [1, -1, -1, 3]


def test_gap_and_duplicate_reports(spark, hourly):
    df = hourly([("a", 0, 1), ("a", 1, 1), ("a", 4, 1), ("a", 5000, 1), ("b", 3, 1)])
    got = back(gaps.gap_report(df, HOURLY, block=8), "timestamp")
    assert got["n_missing"].tolist() == [2, 4995]
    dup = hourly([("a", 0, 1), ("a", 0, 2), ("a", 1, 1)])
    assert gaps.duplicate_report(dup, HOURLY).first()["n_duplicates"] == 1
    with pytest.raises(ValueError, match="1 duplicate"):
        gaps.quality_check(dup, HOURLY)
    assert gaps.quality_check(df, HOURLY).count() == 2
    with pytest.raises(ValueError, match="expected a UTC timestamp"):
        gaps.quality_check(df.withColumn("timestamp", F.col("timestamp").cast("string")), HOURLY)


def test_local_label_follows_daylight_saving(spark, hourly):
    for start, hours, days in (("2024-03-10 06:00", 47, 23), ("2024-11-03 05:00", 49, 25)):
        df = hourly([("a", h, 0) for h in range(hours)], start=start)
        got = df.groupBy(F.to_date(to_local(F.col("timestamp"))).alias("d")).count().orderBy("d").collect()
        assert got[0]["count"] == days
    assert str(local_midnight_utc("2025-08-13 00:00:00")) == "2025-08-13 05:00:00"


def test_trend_years_have_365_days(spark, hourly):
    df = hourly([("a", 0, 0), ("a", 365 * 24, 0)])
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert [r[0] for r in df.select(years_since(F.col("timestamp"), origin)).collect()] == [0.0, 1.0]


def joined(spark, n=400, gap=(200,)):
    hours = [h for h in range(n) if h not in gap]
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h")
    pdf = pd.DataFrame({"series_id": "a", "timestamp": ts})
    for c in ("actual_load_mw", "temp_c", "humidity_pct", "precip_mm", "tmax", "tmin", "tavg"):
        pdf[c] = rng.normal(50, 10, len(pdf)).round(2)
    return pdf


def test_core_features_match_the_step_by_step_build(spark):
    pdf = joined(spark)
    df = to_spark(spark, pdf)
    got = back(feat.core_features(df, HOURLY), "timestamp")
    slow = back(feat.core_features_filled(df, HOURLY), "timestamp")
    pd.testing.assert_frame_equal(got, slow)

    full = pdf.set_index("timestamp").asfreq("h")
    central = full.index.tz_localize("UTC").tz_convert("America/Chicago")
    full["l24"], full["l168"] = full["actual_load_mw"].shift(24), full["actual_load_mw"].shift(168)
    full["dow"] = central.dayofweek
    want = full.dropna(subset=["actual_load_mw", "l24", "l168"])
    # one gap costs itself, the hour 24 later and the hour 168 later
    assert len(got) == len(want) == 400 - 168 - 3
    np.testing.assert_array_equal(got["load_lag_24"], want["l24"])
    np.testing.assert_array_equal(got["dayofweek"], want["dow"])
    assert got.columns.tolist()[0] == "series_id" and len(got.columns) == 17


def test_base_features_match_pandas(spark):
    core = feat.core_features(to_spark(spark, joined(spark)), HOURLY)
    got = back(feat.add_base_features(core, HOURLY), "timestamp")
    p = back(core, "timestamp")
    np.testing.assert_allclose(got["temp_c_roll_std_72"], p["temp_c"].rolling(72, min_periods=24).std())
    np.testing.assert_allclose(got["temp_change_vs_lag24"], p["temp_c"] - p["temp_c"].shift(24))
    years = (p["timestamp"] - p["timestamp"].min()).dt.total_seconds() / (365 * 86400)
    np.testing.assert_allclose(got["trend_idx"], years)
    clock = back(feat.add_base_features(core, HOURLY, mode="time"), "timestamp")
    np.testing.assert_allclose(clock["trend_idx"], years)
    assert feat.drop_warmup(feat.add_base_features(core, HOURLY)).count() == len(p) - 24


def test_lag_spot_check_finds_a_wrong_lag(spark, hourly):
    df = hourly([("a", h, h) for h in range(40)])
    good = blocks.time_lags(df, HOURLY, {"l": ("actual_load_mw", 24)})
    spec = {"l": ("actual_load_mw", 24)}
    assert gaps.lag_spot_check(good, HOURLY, spec).first()["n_mismatch"] == 0
    bad = good.withColumn("l", F.col("l") + F.when(F.col("actual_load_mw") == 30, 1).otherwise(0))
    assert gaps.lag_spot_check(bad, HOURLY, spec).first()["n_mismatch"] == 1


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from loadweave.sources import adapters, readers

    path = str(tmp_path)
    spark.sql("select timestamp_ntz'1996-05-01' as o_orderdate, 1.0 as o_totalprice, 'x' as o_orderpriority, 'y' as o_orderstatus"
              ).write.parquet(f"{path}/orders.parquet")
    load = adapters.daily_load(spark, path)
    text = readers.between_dates(load, "1996-01-01", "1996-12-31")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "o_orderstatus" not in scan
    assert "GreaterThanOrEqual(o_orderdate" in scan and "LessThan(o_orderdate" in scan


def test_long_series_spread_over_blocks(spark, hourly):
    """No lag or frame puts a whole series into one partition key."""
    df = hourly([("a", h, h) for h in range(10)])
    plans = [
        blocks.time_lags(df, HOURLY, {"l": ("actual_load_mw", 2)}),
        blocks.on_rows(df, HOURLY, 3, {"c": blocks.change_from("actual_load_mw", 2)}),
        gaps.gap_fill(df, HOURLY, aligned=True),
    ]
    for out in plans:
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "_blk" in text or "_tb" in text
        assert "SinglePartition" not in text
