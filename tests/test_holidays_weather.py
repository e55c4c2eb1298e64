import numpy as np
import pandas as pd
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from loadweave.config import CITIES, HOURLY, POPULATION
from loadweave.operators import align, features as feat, holidays, weather


def test_calendar_equals_pandas(spark):
    got = {r[0]: r[1] for r in holidays.federal_holidays_between(spark, "1980-01-01", "2030-12-31").collect()}
    want = USFederalHolidayCalendar().holidays("1980-01-01", "2030-12-31", return_name=True)
    assert got == {k.date(): v for k, v in want.items()}


def test_flag_ignores_a_holiday_that_began_before_the_series(spark, hourly):
    # 2024-01-01 06:00 UTC is local midnight; starting one hour later misses New Year's Day.
    for start, expected in ((6, 18), (7, 0)):
        df = hourly([("a", h, 0) for h in range(start, 24)])
        flagged = feat.holiday_flag(df, HOURLY).agg(F.sum("is_holiday")).first()[0]
        assert flagged == expected


def test_names_come_from_the_train_span_only(spark, hourly):
    df = hourly([("a", h, 0) for h in range(24 * 60)])  # MLK day 15 Jan, Washington's birthday 19 Feb
    train = df.where("timestamp < '2024-02-01'")
    scoped = feat.attach_holiday_names(df, train, HOURLY)
    full = feat.attach_holiday_names(df, train, HOURLY, calendar_scope="full")
    names = lambda d: {r[0] for r in d.select("holiday_name").distinct().collect()}
    january = {None, "New Year's Day", "Birthday of Martin Luther King, Jr."}
    assert names(scoped) == january
    assert names(full) == january | {"Washington's Birthday"}


def test_weights_interpolate_and_sum_to_one(spark):
    got = weather.yearly_weights_between(spark, 2014, 2027).toPandas().pivot(index="year", columns="city", values="weight")
    years, anchors = list(range(2014, 2028)), sorted(POPULATION)
    pops = pd.DataFrame({c: np.interp(years, anchors, [POPULATION[y][c] for y in anchors]) for c in CITIES}, index=years)
    np.testing.assert_allclose(got[CITIES].to_numpy(), pops.div(pops.sum(axis=1), axis=0).to_numpy(), rtol=1e-12)
    np.testing.assert_allclose(got.sum(axis=1), 1.0)


def readings(spark, missing=None, null=None):
    rows = []
    for h in range(30):
        for i, c in enumerate(CITIES):
            if (h, c) == missing:
                continue
            ts = pd.Timestamp("2016-12-31 20:00") + pd.Timedelta(hours=h)
            rows.append((ts.to_pydatetime(), c, None if (h, c) == null else float(h + i), 50.0 + i, float(i)))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, temp_c double, humidity_pct double, precip_mm double")


def test_long_and_wide_weighting_agree(spark):
    long = readings(spark, missing=(3, "austin"), null=(5, "round_rock"))
    a = weather.weigh_long(long).orderBy("timestamp").toPandas()
    wide = weather.stations_wide(long)
    b = weather.weigh_wide(wide).select(*a.columns).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 29 and a["temp_c"].isna().sum() == 1  # a null city makes the hour null, it is not skipped
    assert weather.stations_long(wide).count() == 29 * 4
    merged = weather.merge_stations([
        long.where(F.col("city") == c).select("timestamp", F.col("temp_c").alias(f"t_{c}")) for c in CITIES])
    assert merged.count() == 29
    counts = {r["city"]: (r["n_hours"], r["n_merged"]) for r in weather.station_counts(long).collect()}
    assert counts["austin"] == (29, 29) and counts["san_marcos"] == (30, 29)


def test_extremes_use_local_days(spark):
    ts = pd.date_range("2024-03-09 12:00", "2024-03-12 12:00", freq="h")
    pdf = pd.DataFrame({"timestamp": ts, "temp_c": np.arange(len(ts)) * 1.0})
    pdf.loc[3, "temp_c"] = np.nan
    df = spark.createDataFrame(pdf).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                                           F.nanvl("temp_c", F.lit(None)).alias("temp_c"))
    got = weather.daily_extremes(df).orderBy("timestamp").toPandas()
    day = pdf["timestamp"].dt.tz_localize("UTC").dt.tz_convert("America/Chicago").dt.date
    g = pdf.groupby(day)["temp_c"]
    for name, how in (("tmax", "max"), ("tmin", "min"), ("tavg", "mean")):
        np.testing.assert_allclose(got[name], g.transform(how))
    assert weather.daily_table(df).count() == day.nunique()


def test_alignment_and_null_reports(spark, hourly):
    load = hourly([("a", h, h) for h in range(5)])
    sky = hourly([("w", h, None if h == 3 else 1) for h in range(2, 9)], ["temp_c"])
    assert align.alignment_report(load, sky).first().asDict() == {
        "n_left": 5, "n_right": 7, "n_common": 3, "only_left": 2, "only_right": 4}
    assert align.only_in(load, sky).count() == 2 and align.common(load, sky).count() == 3
    nulls = {r["column_name"]: r["n_null"] for r in align.null_report(sky, ["timestamp", "temp_c"]).collect()}
    assert nulls == {"timestamp": 0, "temp_c": 1}
    assert align.null_rows(sky, ["temp_c"], ["timestamp"]).count() == 1
