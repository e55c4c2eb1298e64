"""Queries over regular series: completeness, calendar, lags, rolling features, profiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loadweave.catalog.ctes import local, sql
from loadweave.catalog.registry import query, rounded
from loadweave.catalog.tables import daily, daily_base, daily_core, daily_joined, hourly_core
from loadweave.config import CORE_COLUMNS, DAILY, HOURLY, TARGET, Layout
from loadweave.functions.timefn import to_local
from loadweave.operators import blocks, features as feat, gaps, profile
from loadweave.operators.folds import split_at
from loadweave.session import materialise
from loadweave.sources import adapters

CITY_SERIES = Layout(keys=("city",))


def stored_load(spark, sf, series="user_id"):
    """Hourly load as a stored table, so that the events are scanned once however often it is read."""
    return materialise(adapters.hourly_load(spark, sf, series), "load")


@query("hourly_gap_fill", sql(
    f"select b.series_id, b.timestamp, {local('b.timestamp')} as timestamp_central, actual_load_mw from "
    "(select series_id, unnest(generate_series(min(timestamp), max(timestamp), interval 1 hour)) as timestamp from ml group by 1) b "
    "left join ml on ml.series_id = b.series_id and ml.timestamp = b.timestamp", "ml"))
def hourly_gap_fill(spark, sf):
    """Every meter's hours from its first to its last, absent ones with nulls."""
    return gaps.gap_fill(stored_load(spark, sf), HOURLY, aligned=True)


@query("null_target_rows", sql(
    "select b.series_id, b.timestamp from (select series_id, unnest(generate_series(min(timestamp), max(timestamp), interval 1 hour)) "
    "as timestamp from hl group by 1) b anti join hl on hl.series_id = b.series_id and hl.timestamp = b.timestamp", "hl"))
def null_target_rows(spark, sf):
    """The hours that gap filling brought in."""
    filled = gaps.gap_fill(stored_load(spark, sf, "event_type"), HOURLY, local_name=None)
    return filled.where(F.col(TARGET).isNull()).select("series_id", "timestamp")


@query("gap_report", sql(
    "select series_id, prev_ts, timestamp, delta_seconds, delta_seconds // 3600 - 1 as n_missing from (select *, "
    "cast(epoch(timestamp) - epoch(prev_ts) as bigint) as delta_seconds from (select series_id, timestamp, "
    "lag(timestamp) over (partition by series_id order by timestamp) as prev_ts from ml)) where delta_seconds <> 3600", "ml"))
def gap_report(spark, sf):
    return gaps.gap_report(stored_load(spark, sf), HOURLY)


@query("duplicate_report", """
    select series_id, cast(sum(n) as bigint) as n_rows, cast(sum(n - 1) as bigint) as n_duplicates from
    (select event_type as series_id, date_trunc('hour', ts) as h, count(*) as n from events group by 1, 2) group by 1""")
def duplicate_report(spark, sf):
    raw = adapters.table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), adapters.hour_of_event().alias("timestamp"))
    return gaps.duplicate_report(raw, HOURLY)


@query("calendar_central", sql(
    "select series_id, timestamp, c as timestamp_central, cast(hour(c) as int) as hour, cast(isodow(c) - 1 as int) as dayofweek, "
    "cast(month(c) as int) as month, cast(isodow(c) in (6, 7) as int) as is_weekend "
    f"from (select *, {local('timestamp')} as c from ml)", "ml"))
def calendar_central(spark, sf):
    load = adapters.hourly_load(spark, sf, "user_id").drop(TARGET)
    return feat.calendar_features(load.withColumn("timestamp_central", to_local(F.col("timestamp"))))


@query("holiday_flag", sql(
    f"select d.series_id, d.timestamp, cast(h.holiday_date is not null as int) as is_holiday from dl d join (select series_id, min({local('timestamp')}) as a, "
    f"max({local('timestamp')}) as z from dl group by 1) s on s.series_id = d.series_id left join hol h on "
    f"h.holiday_date = cast({local('d.timestamp')} as date) and cast(h.holiday_date as timestamp) between s.a and s.z", "dl", "hol"))
def holiday_flag(spark, sf):
    return feat.holiday_flag(materialise(adapters.daily_load(spark, sf).drop(TARGET), "load"), DAILY)


@query("load_lags", sql(
    "select j.series_id, j.timestamp, a.actual_load_mw as load_lag_24, b.actual_load_mw as load_lag_168 from ml j "
    "left join ml a on a.series_id = j.series_id and a.timestamp = j.timestamp - interval 24 hour "
    "left join ml b on b.series_id = j.series_id and b.timestamp = j.timestamp - interval 168 hour", "ml"))
def load_lags(spark, sf):
    return blocks.time_lags(adapters.hourly_load(spark, sf, "user_id"), HOURLY, feat.HOUR_LAGS).drop(TARGET)


@query("load_features", sql(
    "select l.series_id, l.timestamp, c as timestamp_central, l.actual_load_mw, cast(hour(c) as int) as hour, "
    "cast(isodow(c) - 1 as int) as dayofweek, cast(month(c) as int) as month, cast(isodow(c) in (6, 7) as int) as is_weekend, "
    "a.actual_load_mw as load_lag_24, b.actual_load_mw as load_lag_168 "
    f"from (select *, {local('timestamp')} as c from sys) l join sys a on a.timestamp = l.timestamp - interval 24 hour "
    "join sys b on b.timestamp = l.timestamp - interval 168 hour", "sys"))
def load_features(spark, sf):
    """System load: gaps made visible, calendar, lags, then rows without a full history dropped."""
    filled = gaps.gap_fill(stored_load(spark, sf, None), HOURLY, aligned=True)
    lagged = blocks.time_lags(filled, HOURLY, feat.HOUR_LAGS)
    return feat.calendar_features(lagged).dropna(subset=[TARGET, *feat.HOUR_LAGS])


@query("lag_spot_check", sql(
    "select lag_name, count(*) as n_rows, count(v) as n_known, cast(0 as bigint) as n_mismatch from (select 'load_lag_24' as lag_name, a.actual_load_mw as v "
    "from ml j left join ml a on a.series_id = j.series_id and a.timestamp = j.timestamp - interval 24 hour union all "
    "select 'load_lag_168', a.actual_load_mw from ml j left join ml a on a.series_id = j.series_id "
    "and a.timestamp = j.timestamp - interval 168 hour) group by 1", "ml"))
def lag_spot_check(spark, sf):
    lagged = materialise(blocks.time_lags(adapters.hourly_load(spark, sf, "user_id"), HOURLY, feat.HOUR_LAGS), "lagged")
    return gaps.lag_spot_check(lagged, HOURLY, feat.HOUR_LAGS)


@query("rolling_std", sql(
    "select city, timestamp, round(case when count(temp_c) over w >= 24 then stddev_samp(temp_c) over w end, 4) as roll_std, "
    "round(temp_c - lag(temp_c, 24) over (partition by city order by timestamp), 10) as temp_change from sw "
    "window w as (partition by city order by timestamp rows between 71 preceding and current row)", "sw"))
def rolling_std(spark, sf):
    """Frames counted in rows, over each station's readings with their holes."""
    out = blocks.on_rows(materialise(adapters.station_weather(spark, sf), "readings"), CITY_SERIES, 71, {
        "roll_std": blocks.rolling_std("temp_c", 72, 24), "temp_change": blocks.change_from("temp_c", 24)})
    return rounded(rounded(out.select("city", "timestamp", "roll_std", "temp_change"), 4, "roll_std"), 10, "temp_change")


@query("rolling_std_clock", sql(
    "select city, timestamp, round(case when count(temp_c) over w >= 24 then stddev_samp(temp_c) over w end, 4) as roll_std, "
    "round(temp_c - first(temp_c) over b, 10) as temp_change from sw window w as (partition by city order by timestamp "
    "range between interval 71 hour preceding and current row), b as (partition by city order by timestamp "
    "range between interval 24 hour preceding and interval 24 hour preceding)", "sw"))
def rolling_std_clock(spark, sf):
    """Frames counted in hours of the clock."""
    out = blocks.on_clock(adapters.station_weather(spark, sf), CITY_SERIES, 71, {
        "roll_std": blocks.rolling_std("temp_c", 72, 24, rows=False),
        "temp_change": blocks.change_from("temp_c", 24, rows=False)})
    return rounded(rounded(out.select("city", "timestamp", "roll_std", "temp_change"), 4, "roll_std"), 10, "temp_change")


@query("trend_idx", sql(
    "select series_id, timestamp, round((epoch_us(timestamp) - min(epoch_us(timestamp)) over (partition by series_id))::double "
    "/ 1e6 / 31536000.0, 9) as trend_idx from ml", "ml"))
def trend_idx(spark, sf):
    out = feat.with_trend_idx(stored_load(spark, sf), HOURLY).drop(TARGET)
    return rounded(out, 9, "trend_idx")


_W = ["temp_c", "humidity_pct", "precip_mm", "tmax", "tmin", "tavg"]
_CORE = ", ".join(["series_id"] + [f"round({c}, 6) as {c}" if c in _W else c for c in CORE_COLUMNS])


@query("core_features", sql(f"select {_CORE} from hjcore", "hjcore", "hol"))
def core_features(spark, sf):
    """Flagship: load and weighted weather joined, calendar, holidays and lags, per zone."""
    return rounded(hourly_core(spark, sf), 6, *_W)


@query("core_features_filled", sql(f"select {_CORE} from djcore", "djcore", "hol"))
def core_features_filled(spark, sf):
    """The same steps with gap rows inserted first, on daily data."""
    return rounded(feat.core_features_filled(materialise(daily_joined(spark, sf), "joined"), DAILY, feat.DAY_LAGS), 6, *_W)


@query("daily_core_features", sql(f"select {_CORE} from djcore", "djcore", "hol"))
def daily_core_features(spark, sf):
    return rounded(daily_core(spark, sf), 6, *_W)


@query("core_features_off_grid", sql(f"select {_CORE} from djcore", "djcore", "hol"))
def core_features_off_grid(spark, sf):
    """Each day also reported half an hour late, with another load: rows off the grid change nothing."""
    joined = materialise(daily_joined(spark, sf), "joined")
    late = joined.withColumns({DAILY.ts: F.col(DAILY.ts) + F.expr("interval 30 minutes"), TARGET: F.col(TARGET) + 1})
    return rounded(feat.core_features(joined.unionByName(late), DAILY, feat.DAY_LAGS), 6, *_W)


@query("base_features", sql(
    "select series_id, timestamp, round(trend_idx, 9) as trend_idx, round(hour_x_temp, 6) as hour_x_temp, "
    "round(temp_c_roll_std_72, 4) as temp_c_roll_std_72, round(temp_change_vs_lag24, 6) as temp_change_vs_lag24 from dbase",
    "dbase", "hol"))
def base_features(spark, sf):
    out = daily_base(spark, sf).select(
        "series_id", "timestamp", "trend_idx", "hour_x_temp", "temp_c_roll_std_72", "temp_change_vs_lag24")
    return rounded(rounded(rounded(out, 9, "trend_idx"), 6, "hour_x_temp", "temp_change_vs_lag24"), 4, "temp_c_roll_std_72")


@query("flag_balance", sql(
    "select is_holiday, is_weekend, count(*) as n_rows from djcore group by 1, 2", "djcore", "hol"))
def flag_balance(spark, sf):
    return daily_core(spark, sf).groupBy("is_holiday", "is_weekend").agg(F.count(F.lit(1)).alias("n_rows"))


@query("attach_holiday_names", sql(
    "select series_id, timestamp, holiday_name from dtrain union all select series_id, timestamp, holiday_name from dtest",
    "dtrain", "dtest", "hol"))
def attach_holiday_names(spark, sf):
    d = daily(spark, sf)
    return d.train.unionByName(d.test).select("series_id", "timestamp", "holiday_name")


@query("purged_split_counts", sql(
    "select 'train' as part, count(*) as n_rows, min(timestamp) as first_ts, max(timestamp) as last_ts from dtrain union all "
    "select 'test', count(*), min(timestamp), max(timestamp) from dtest", "dtrain", "dtest", "hol"))
def purged_split_counts(spark, sf):
    d = daily(spark, sf)
    marked = d.train.select(F.lit("train").alias("part"), "timestamp").unionByName(
        d.test.select(F.lit("test").alias("part"), "timestamp"))
    return marked.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts"),
                                      F.max("timestamp").alias("last_ts"))


@query("unpurged_split_counts", sql(
    "select 'train' as part, count(*) as n_rows from dl where timestamp <= timestamp '2000-12-31' union all "
    "select 'test', count(*) from dl where timestamp >= timestamp '2001-01-01'", "dl"))
def unpurged_split_counts(spark, sf):
    """The exploratory split: explicit bounds, no purge."""
    split = split_at(adapters.daily_load(spark, sf), datetime(2000, 12, 31), datetime(2001, 1, 1))
    marked = split.train.select(F.lit("train").alias("part")).unionByName(split.test.select(F.lit("test").alias("part")))
    return marked.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))


# --- Exploration ------------------------------------------------------------------------------

@query("describe_core", sql(
    "select column_name, count(v) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, round(min(v), 4) as min, "
    "round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50, round(quantile_cont(v, 0.75), 4) as p75, "
    "round(max(v), 4) as max from (unpivot (select actual_load_mw, temp_c, humidity_pct, precip_mm, tmax, tmin, tavg, load_lag_24, "
    "dayofweek::double as dayofweek from djcore) on columns(*) into name column_name value v) group by 1", "djcore", "hol"))
def describe_core(spark, sf):
    out = profile.describe(materialise(daily_core(spark, sf), "core"), [
        TARGET, "temp_c", "humidity_pct", "precip_mm", "tmax", "tmin", "tavg", "load_lag_24", "dayofweek"])
    return rounded(out, 4, "mean", "std", "min", "p25", "p50", "p75", "max")


_EDGES = "select feature, lo, hi, b, lo + b * ((hi - lo) / {n}) as e0, case when b = {m} then hi else lo + (b + 1) * ((hi - lo) / {n}) end as e1"


@query("target_histogram", sql(
    "select cast(b as int) as bin, round(e0, 6) as bin_lo, round(e1, 6) as bin_hi, count(v) as n_rows, round(mean, 4) as mean, round(std, 4) as std "
    "from (select *, lo + b * ((hi - lo) / 100) as e0, case when b = 99 then hi else lo + (b + 1) * ((hi - lo) / 100) end as e1 from "
    "(select min(actual_load_mw) as lo, max(actual_load_mw) as hi, avg(actual_load_mw) as mean, stddev_samp(actual_load_mw) as std from djcore), range(100) t(b)) "
    "left join (select actual_load_mw as v from djcore) on v >= e0 and (v < e1 or (b = 99 and v <= e1)) group by all", "djcore", "hol"))
def target_histogram(spark, sf):
    out = profile.target_histogram(materialise(daily_core(spark, sf), "core"), TARGET, 100)
    return rounded(rounded(out, 6, "bin_lo", "bin_hi"), 4, "mean", "std")


@query("target_mean_std", sql(
    "select series_id, round(avg(actual_load_mw), 8) as mean, round(stddev_samp(actual_load_mw), 8) as std from ml group by 1", "ml"))
def target_mean_std(spark, sf):
    out = adapters.hourly_load(spark, sf, "user_id").groupBy("series_id").agg(
        F.avg(TARGET).alias("mean"), F.stddev_samp(TARGET).alias("std"))
    return rounded(out, 8, "mean", "std")


@query("feature_target_profile", sql(
    "u as (unpivot (select actual_load_mw as y, temp_c, humidity_pct, tmax, dayofweek::double as dayofweek from dtrain) "
    "on temp_c, humidity_pct, tmax, dayofweek into name feature value x), "
    "st as (select feature, count(distinct x) as k, min(x) as lo, max(x) as hi from u group by 1), "
    "byv as (select u.feature, 'value' as mode, x as bin_lo, x as bin_hi, count(*) as n_rows, avg(y) as mean_target from u join st "
    "on st.feature = u.feature where k <= 20 or k < 10 group by all), "
    f"ed as ({_EDGES.format(n=10, m=9)} from st, range(10) t(b) where k > 20), "
    "byb as (select ed.feature, 'histogram' as mode, e0 as bin_lo, e1 as bin_hi, count(x) as n_rows, "
    "avg(y) filter (where x < hi) as mean_target from ed left join u on u.feature = ed.feature and x >= e0 "
    "and (x < e1 or (b = 9 and x <= e1)) group by ed.feature, e0, e1) "
    "select feature, mode, round(bin_lo, 6) as bin_lo, round(bin_hi, 6) as bin_hi, n_rows, round(mean_target, 3) as mean_target, "
    "k as n_unique, cast(0 as bigint) as n_null from (select * from byv union all select * from byb) join st using (feature)",
    "dtrain", "hol").replace(") u as", "), u as"))
def feature_target_profile(spark, sf):
    d = daily(spark, sf)
    out = profile.feature_profile(d.train, ["temp_c", "humidity_pct", "tmax", "dayofweek"], TARGET, n_bins=10)
    return rounded(rounded(out.drop("category"), 6, "bin_lo", "bin_hi"), 3, "mean_target")


@query("profile_with_nulls", sql(
    "u as (unpivot (select actual_load_mw as y, case when dayofweek <> 6 then load_lag_168 end as load_lag_168, dayofweek::double as dayofweek from djcore) "
    "on load_lag_168, dayofweek into name feature value x), "
    "st as (select feature, count(distinct x) as k, min(x) as lo, max(x) as hi from u group by 1), "
    "holes as (select count(*) as h from djcore where dayofweek = 6 or load_lag_168 is null), "
    f"ed as ({_EDGES.format(n=10, m=9)} from st, range(10) t(b) where feature = 'load_lag_168') "
    "select 'series_id' as feature, 'category' as mode, null::double as bin_lo, null::double as bin_hi, series_id as category, count(*) as n_rows, "
    "round(avg(actual_load_mw), 3) as mean_target, (select count(distinct series_id) from djcore) as n_unique, 0::bigint as n_null from djcore group by 5 "
    "union all select 'dayofweek', 'value', x, x, null, count(*), round(avg(y), 3), any_value(k), 0 from u join st using (feature) "
    "where feature = 'dayofweek' group by x "
    "union all select 'load_lag_168', 'histogram', round(e0, 6), round(e1, 6), null, count(x), round(avg(y) filter (where x < ed.hi), 3), any_value(k), any_value(h) "
    "from holes, ed left join (select x, y from u where feature = 'load_lag_168') on x >= e0 and (x < e1 or (b = 9 and x <= e1)), "
    "(select k from st where feature = 'load_lag_168') group by e0, e1",
    "djcore", "hol").replace(") u as", "), u as"))
def profile_with_nulls(spark, sf):
    """A feature that is unknown on one day of the week, one of few values and a text."""
    core = daily_core(spark, sf).withColumn("load_lag_168", F.when(F.col("dayofweek") != 6, F.col("load_lag_168")))
    out = profile.feature_profile(core, ["load_lag_168", "dayofweek", "series_id"], TARGET, n_bins=10)
    return rounded(rounded(out, 6, "bin_lo", "bin_hi"), 3, "mean_target")


@query("category_order", sql(
    "select category, n_rows, round(mean_target, 4) as mean_target, case category when '5-LOW' then 1 when '1-URGENT' then 2 "
    "else 3 end as preferred from (select series_id as category, count(*) as n_rows, "
    "avg(actual_load_mw) as mean_target from djcore group by 1)", "djcore", "hol"))
def category_order(spark, sf):
    """Zones profiled as a text feature, two of them in a given order and the rest by count."""
    out = profile.category_profile(daily_core(spark, sf), "series_id", TARGET, ["5-LOW", "1-URGENT"])
    return rounded(out, 4, "mean_target")


@query("train_test_distribution", sql(
    "u as (select 0 as t, feature, x from (unpivot (select temp_c, tmax, precip_mm from dtrain) on columns(*) into name feature value x) "
    "union all select 1, feature, x from (unpivot (select temp_c, tmax, precip_mm from dtest) on columns(*) into name feature value x)), "
    "st as (select feature, min(x) as lo, max(x) as hi from u group by 1), "
    f"ed as ({_EDGES.format(n=15, m=14)} from st, range(15) t(b)) "
    "select ed.feature, cast(null as varchar) as category, cast(b as int) as bin, round(e0, 6) as bin_lo, "
    "count(*) filter (where t = 0) as n_train, count(*) filter (where t = 1) as n_test from ed left join u on u.feature = ed.feature "
    "and x >= e0 and (x < e1 or (b = 14 and x <= e1)) group by ed.feature, b, e0 union all "
    "select 'holiday_name', holiday_name, cast(null as int), cast(null as double), count(*) filter (where t = 0), count(*) filter (where t = 1) "
    "from (select 0 as t, holiday_name from dtrain union all select 1, holiday_name from dtest) where holiday_name is not null group by 2",
    "dtrain", "dtest", "hol").replace(") u as", "), u as"))
def train_test_distribution(spark, sf):
    d = daily(spark, sf)
    out = profile.train_test_distribution(
        d.train, d.test, ["temp_c", "tmax", "precip_mm", "holiday_name", "not_there"], n_bins=15)
    return rounded(out, 6, "bin_lo")
