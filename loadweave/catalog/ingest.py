"""Queries over landed data: scans, stations, alignment and the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadweave.catalog.ctes import REBASED, local, sql, weight
from loadweave.catalog.registry import query, rounded
from loadweave.catalog.tables import hourly_joined
from loadweave.config import CITIES, GATE_COLUMNS, HOURLY, JOINED_VALUES, TARGET
from loadweave.functions.timefn import gate_text
from loadweave.operators import align, gaps, holidays, profile, quality, weather
from loadweave.session import materialise, scratch_path
from loadweave.sources import adapters, readers, sinks

WEATHER_SQL = "temp_c, humidity_pct, precip_mm"


@query("weather_json_explode", sql(
    f"select city, timestamp, {WEATHER_SQL} from sw", "sw"))
def weather_json_explode(spark, sf):
    """Readings packed into per-city, per-day payloads as a service returns them, then unpacked."""
    parsed = packed_readings(spark, sf).select("city", F.from_json("body", readers.PAYLOAD).alias("payload"))
    return readers.explode_payload(parsed, F.col("payload.hourly"), ["city"])


def packed_readings(spark, sf):
    readings = adapters.station_weather(spark, sf)
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm")
    hours = F.array_sort(F.collect_list(F.struct(
        stamp.alias("time"), F.col("temp_c").alias("t"), F.col("humidity_pct").alias("h"), F.col("precip_mm").alias("p"))))
    return readings.groupBy("city", F.to_date("timestamp").alias("day")).agg(hours.alias("rows")).select(
        "city", "day", F.to_json(F.struct(F.struct(
            F.col("rows.time").alias("time"), F.col("rows.t").alias("temperature_2m"),
            F.col("rows.h").alias("relative_humidity_2m"), F.col("rows.p").alias("precipitation"),
        ).alias("hourly"))).alias("body"))


_KEPT = "day(timestamp) % 7"


@query("weather_json_files", sql(
    f"select city, timestamp, {WEATHER_SQL}, null::varchar as problem, cast(1 as bigint) as n from sw where {_KEPT} > 1 union all "
    f"select city, null, null, null, null, case {_KEPT} when 0 then 'json' else 'hourly' end, count(distinct cast(timestamp as date)) "
    f"from sw where {_KEPT} <= 1 group by city, {_KEPT}", "sw"))
def weather_json_files(spark, sf):
    """Payload files as they land, a folder per city. One day in seven is cut short, one holds no readings: those
    records are refused and counted, the others unpacked."""
    kept = F.dayofmonth("day") % 7
    body = F.when(kept == 0, F.expr("substring(body, 1, length(body) - 9)")).when(kept == 1, "{}").otherwise(F.col("body"))
    path = scratch_path(spark, "payloads")
    packed_readings(spark, sf).select("city", body.alias("body")).write.partitionBy("city").text(path)
    good, refused = readers.read_weather_payloads(spark, path)
    rows = readers.explode_payload(good, "hourly", ["city"]).withColumns({
        "problem": F.lit(None).cast("string"), "n": F.lit(1).cast("long")})
    counted = refused.groupBy("city", "problem").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(counted, allowMissingColumns=True)


@query("quality_verdict", sql(
    "select 'as landed' as part, null::varchar as problem, (select count(*) from (select timestamp - lag(timestamp) over "
    "(partition by series_id order by timestamp) as d from hl) where d > interval 1 hour) as n_gaps union all "
    "select 'fifth hour twice', cast(count(*) as varchar) || ' duplicate timestamp(s)', null from hl where hour(timestamp) = 5", "hl"))
def quality_verdict(spark, sf):
    """The check that stops a run: the load as it landed, and with one hour of each day repeated."""
    load = materialise(adapters.hourly_load(spark, sf), "load")
    verdicts = []
    for part, rows in (("as landed", load), ("fifth hour twice", load.unionByName(load.where(F.hour("timestamp") == 5)))):
        try:
            verdicts.append((part, None, gaps.quality_check(rows, HOURLY).count()))
        except ValueError as problem:
            verdicts.append((part, str(problem), None))
    return spark.createDataFrame(verdicts, "part string, problem string, n_gaps long")


@query("positional_rename", sql(
    "select 'renamed' as part, series_id, timestamp, actual_load_mw from hl union all "
    "select 'passed through', series_id, timestamp, actual_load_mw from hl", "hl"))
def positional_rename(spark, sf):
    """Columns take names by position where their number agrees; a wider table keeps its own."""
    load = adapters.hourly_load(spark, sf).select("series_id", "timestamp", "actual_load_mw")
    renamed = quality.rename_if_same_width(load.toDF("x", "y", "z"), load.columns)
    kept = quality.rename_if_same_width(load.withColumn("more", F.lit(1)), ["x", "y", "z"]).drop("more")
    return renamed.withColumn("part", F.lit("renamed")).unionByName(kept.withColumn("part", F.lit("passed through")))


def wide_load(hourly):
    """A landed table with a column for each zone there is."""
    return hourly.groupBy(F.col("timestamp").alias("interval_start_utc")).pivot("series_id").agg(F.max(TARGET))


@query("load_zones", sql(
    "select series_id, timestamp, actual_load_mw from hl", "hl"))
def load_zones(spark, sf):
    """A landed wide table with a column per zone, turned into one series per zone."""
    hourly = adapters.hourly_load(spark, sf)
    wide = wide_load(hourly)
    return readers.normalise_all_zones(wide, wide.columns[1:]).where(F.col(TARGET).isNotNull())


@query("load_one_zone", sql(
    "select timestamp, actual_load_mw from hl where series_id = 'click'", "hl"))
def load_one_zone(spark, sf):
    wide = wide_load(adapters.hourly_load(spark, sf))
    return readers.normalise_load(wide, "click").where(F.col(TARGET).isNotNull())


@query("csv_series_scan", sql(
    f"select series_id, timestamp, {local('timestamp')} as timestamp_central, actual_load_mw from hl", "hl"))
def csv_series_scan(spark, sf):
    """Load written as CSV with UTC text in both time columns, read back with a declared schema."""
    load = adapters.hourly_load(spark, sf)
    stamp = gate_text(F.col("timestamp"))
    path = scratch_path(spark, "csv")
    sinks.write_csv(load.select("series_id", stamp.alias("timestamp"), stamp.alias("timestamp_central"), TARGET), path)
    return readers.read_series_csv(spark, path, [TARGET], ["timestamp", "timestamp_central"], keys=["series_id"])


@query("parquet_series_scan", sql(
    "select series_id, timestamp, actual_load_mw from dl where timestamp >= timestamp '1999-11-15' and timestamp < timestamp '2000-02-16'", "dl"))
def parquet_series_scan(spark, sf):
    """Load stored by year, then one period read back: other years' files are not opened."""
    path = scratch_path(spark, "series")
    sinks.write_series(adapters.daily_load(spark, sf), path)
    stored = readers.read_features(spark, path).where(F.col("year").between(1999, 2000))
    return readers.between_dates(stored, "1999-11-15", "2000-02-15").drop("year")


@query("date_range_scan", """
    select o_orderpriority as series_id, count(*) as n_orders, sum(cast(round(o_totalprice * 100) as bigint))::double / 100.0 as total
    from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1998-03-01' group by 1""")
def date_range_scan(spark, sf):
    """Whole days between two dates, both included; the bounds reach the Parquet scan."""
    orders = adapters.table(spark, sf, "orders")
    return readers.between_dates(orders, "1996-03-01", "1998-02-28", "o_orderdate").groupBy(
        F.col("o_orderpriority").alias("series_id")).agg(
        F.count(F.lit(1)).alias("n_orders"), (F.sum(adapters.cents("o_totalprice")) / 100.0).alias("total"))


_WIDE_COLUMNS = ", ".join(f"{f}_{c}" for c in CITIES for f in ("temp_c", "humidity_pct", "precip_mm"))


@query("city_inner_join", sql(f"select timestamp, {_WIDE_COLUMNS} from wide", "wide"))
def city_inner_join(spark, sf):
    """One frame per station, joined on the hour."""
    readings = adapters.station_weather(spark, sf)
    frames = [readers.with_weather_names(readings.where(F.col("city") == c).drop("city"), c) for c in CITIES]
    return weather.merge_stations(frames)


@query("city_pivot", sql(f"select timestamp, {_WIDE_COLUMNS} from wide", "wide"))
def city_pivot(spark, sf):
    return weather.stations_wide(adapters.station_weather(spark, sf))


@query("station_counts", sql(
    "select city, count(*) as n_hours, count(w.timestamp) as n_merged from sw "
    "left join wide w on w.timestamp = sw.timestamp group by 1", "sw", "wide"))
def station_counts(spark, sf):
    return weather.station_counts(adapters.station_weather(spark, sf))


@query("yearly_weights", sql(
    "select year, city, round(w, 9) as weight from (select cast(y.year as int) as year, u.city, case u.city "
    + " ".join(f"when '{c}' then {weight('y.year', c, REBASED)}" for c in CITIES)
    + " end as w from (select unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) as year from orders) y, "
    + "(values " + ", ".join(f"('{c}')" for c in CITIES) + ") u(city))"))
def yearly_weights(spark, sf):
    years = weather.years_covered(adapters.table(spark, sf, "orders"), "o_orderdate")
    return rounded(weather.yearly_weights(years, anchors=REBASED), 9, "weight")


_WEIGHED = ", ".join(f"round({f}, 6) as {f}" for f in ("temp_c", "humidity_pct", "precip_mm"))


@query("weighted_weather", sql(f"select timestamp, {_WEIGHED} from ww", "ww"))
def weighted_weather(spark, sf):
    """Weighted fields from long station rows."""
    out = weather.weigh_long(adapters.station_weather(spark, sf))
    return rounded(out, 6, "temp_c", "humidity_pct", "precip_mm")


@query("weighted_weather_wide", sql(f"select timestamp, {_WEIGHED} from ww", "ww"))
def weighted_weather_wide(spark, sf):
    out = weather.weigh_wide(weather.stations_wide(adapters.station_weather(spark, sf)))
    return rounded(out.select("timestamp", "temp_c", "humidity_pct", "precip_mm"), 6, "temp_c", "humidity_pct", "precip_mm")


@query("daily_extremes", sql(
    "select timestamp, round(tmax, 6) as tmax, round(tmin, 6) as tmin, round(tavg, 6) as tavg from wx", "wx"))
def daily_extremes(spark, sf):
    out = weather.daily_extremes(weather.weigh_wide(weather.stations_wide(adapters.station_weather(spark, sf))))
    return rounded(out.select("timestamp", "tmax", "tmin", "tavg"), 6, "tmax", "tmin", "tavg")


@query("daily_table", sql(
    f"select cast({local('timestamp')} as date) as day, round(max(temp_c), 6) as tmax, round(min(temp_c), 6) as tmin, "
    "round(avg(temp_c), 6) as tavg from ww group by 1", "ww"))
def daily_table(spark, sf):
    out = weather.daily_table(weather.weigh_wide(weather.stations_wide(adapters.station_weather(spark, sf))))
    return rounded(out, 6, "tmax", "tmin", "tavg")


_JOINED = "series_id, timestamp, timestamp_central, actual_load_mw, " + ", ".join(
    f"round({c}, 6) as {c}" for c in JOINED_VALUES[1:])


@query("align_join", sql(f"select {_JOINED} from hj", "hj"))
def align_join(spark, sf):
    return rounded(hourly_joined(spark, sf), 6, *JOINED_VALUES[1:])


@query("alignment_report", sql(
    "select count(l) as n_left, count(r) as n_right, count(*) filter (where l is not null and r is not null) as n_common, "
    "count(*) filter (where r is null) as only_left, count(*) filter (where l is null) as only_right "
    "from (select distinct timestamp as l from hl) a full join (select timestamp as r from wide) b on l = r", "hl", "wide"))
def alignment_report(spark, sf):
    wide = weather.stations_wide(adapters.station_weather(spark, sf))
    return align.alignment_report(adapters.hourly_load(spark, sf), wide)


@query("only_in_load", sql(
    "select timestamp from hl except select timestamp from wide", "hl", "wide"))
def only_in_load(spark, sf):
    return align.only_in(adapters.hourly_load(spark, sf), weather.stations_wide(adapters.station_weather(spark, sf)))


@query("common_timestamps", sql(
    "select timestamp from hl intersect select timestamp from wide", "hl", "wide"))
def common_timestamps(spark, sf):
    return align.common(adapters.hourly_load(spark, sf), weather.stations_wide(adapters.station_weather(spark, sf)))


# Lines put beside load without dropping days: the outer table has nulls to report.
@query("null_report", sql(
    "select column_name, cast(n_null as bigint) as n_null, n_rows from (select count(*) as n_rows, "
    "count(*) - count(temp_c) as a, count(*) - count(tmax) as b, count(*) - count(actual_load_mw) as c "
    "from (select * from dl full join dw on dl.timestamp = dw.timestamp)), "
    "lateral (values ('temp_c', a), ('tmax', b), ('actual_load_mw', c)) v(column_name, n_null)", "dl", "dw"))
def null_report(spark, sf):
    outer = adapters.daily_load(spark, sf).join(adapters.daily_weather(spark, sf), "timestamp", "full")
    return align.null_report(outer, ["temp_c", "tmax", TARGET])


@query("null_rows", sql(
    "select coalesce(dl.timestamp, dw.timestamp) as timestamp, series_id, actual_load_mw, round(tmax, 6) as tmax "
    "from dl full join dw on dl.timestamp = dw.timestamp where actual_load_mw is null or tmax is null "
    "order by timestamp, series_id nulls first limit 10", "dl", "dw"))
def null_rows(spark, sf):
    outer = adapters.daily_load(spark, sf).join(adapters.daily_weather(spark, sf), "timestamp", "full")
    hit = align.null_rows(outer, [TARGET, "tmax"], ["timestamp", "series_id"])
    return rounded(hit.select("timestamp", "series_id", TARGET, "tmax"), 6, "tmax")


def gate_table(spark, sf):
    joined = hourly_joined(spark, sf)
    return joined.withColumn("timestamp", gate_text(F.col("timestamp"))).select(*GATE_COLUMNS)


GATE_ROWS = 3000
_LO, _HI = int(GATE_ROWS * 0.97), int(GATE_ROWS * 1.03)
_DQ = f"""
    g as (select strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '+00:00' as timestamp, actual_load_mw, temp_c, humidity_pct,
        precip_mm from hj),
    a as (select count(*) as n, count(*) filter (where actual_load_mw not between 500 and 30000) as b1,
        count(*) filter (where temp_c not between -20 and 50) as b2,
        count(*) filter (where humidity_pct not between 0 and 100) as b3,
        count(*) filter (where precip_mm < 0) as b4,
        count(*) filter (where not regexp_full_match(timestamp, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}\\+00:00')) as b5,
        count(*) - count(timestamp) as z1, count(*) - count(actual_load_mw) as z2, count(*) - count(temp_c) as z3,
        count(*) - count(humidity_pct) as z4, count(*) - count(precip_mm) as z5 from g),
    res as (select cast(check_no as int) as check_no, expectation, column_name, cast(observed as bigint) as observed, pct as unexpected_pct, success
    from a, lateral (values
        (1, 'column_count', null, 5, null, true), (2, 'column_set', null, 0, null, true),
        (3, 'row_count', null, n, null, n between {_LO} and {_HI}),
        (4, 'not_null', 'timestamp', z1, 100.0 * z1 / n, z1 = 0), (5, 'not_null', 'actual_load_mw', z2, 100.0 * z2 / n, z2 = 0),
        (6, 'not_null', 'temp_c', z3, 100.0 * z3 / n, z3 = 0), (7, 'not_null', 'humidity_pct', z4, 100.0 * z4 / n, z4 = 0),
        (8, 'not_null', 'precip_mm', z5, 100.0 * z5 / n, z5 = 0),
        (9, 'between', 'actual_load_mw', b1, 100.0 * b1 / (n - z2), b1 = 0), (10, 'between', 'temp_c', b2, 100.0 * b2 / (n - z3), b2 = 0),
        (11, 'between', 'humidity_pct', b3, 100.0 * b3 / (n - z4), b3 = 0), (12, 'between', 'precip_mm', b4, 100.0 * b4 / (n - z5), b4 = 0),
        (13, 'matches', 'timestamp', b5, 100.0 * b5 / (n - z1), b5 = 0)
    ) v(check_no, expectation, column_name, observed, pct, success))"""


@query("dq_results", sql("select 1", "hj").replace("select 1", "") .rstrip() + ", " + _DQ.strip()
       + " select check_no, expectation, column_name, observed, round(unexpected_pct::double, 6) as unexpected_pct, success from res")
def dq_results(spark, sf):
    results = quality.evaluate(gate_table(spark, sf), quality.gate_suite(rows=GATE_ROWS))
    return rounded(results.drop("params"), 6, "unexpected_pct")


@query("dq_gate", sql("select 1", "hj").replace("select 1", "").rstrip() + ", " + _DQ.strip()
       + " select count(*) as n_checks, count(*) filter (where not success) as n_failed, bool_and(success) as passed from res")
def dq_gate(spark, sf):
    return quality.verdict(quality.evaluate(gate_table(spark, sf), quality.gate_suite(rows=GATE_ROWS)))


@query("dq_csv_gate", sql("select 1", "hj").replace("select 1", "").rstrip() + ", " + _DQ.strip()
       + " select check_no, expectation, observed, success from res")
def dq_csv_gate(spark, sf):
    """The gate over a landed CSV whose first column stays raw text."""
    path = scratch_path(spark, "gate")
    sinks.write_csv(gate_table(spark, sf), path)
    results = quality.evaluate(readers.read_gate_csv(spark, path), quality.gate_suite(rows=GATE_ROWS))
    return results.select("check_no", "expectation", "observed", "success")


@query("federal_holidays", sql(
    "select holiday_date, holiday_name from hol, (select min(o_orderdate) as a, max(o_orderdate) as z from orders) "
    "where holiday_date between cast(a as date) and cast(z as date)", "hol"))
def federal_holidays(spark, sf):
    """The holidays of the period the orders cover."""
    span = adapters.table(spark, sf, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return holidays.federal_holidays(span, F.col("a"), F.col("z"))


@query("head_tail", sql(
    "select * from (select 'head' as part, series_id, timestamp, actual_load_mw from hl order by timestamp, series_id limit 5) "
    "union all select * from (select 'tail', series_id, timestamp, actual_load_mw from hl order by timestamp desc, series_id limit 5)", "hl"))
def head_tail(spark, sf):
    load = adapters.hourly_load(spark, sf).select("series_id", "timestamp", TARGET)
    head = load.orderBy("timestamp", "series_id").limit(5).select(F.lit("head").alias("part"), "*")
    tail = load.orderBy(F.col("timestamp").desc(), "series_id").limit(5).select(F.lit("tail").alias("part"), "*")
    return head.unionByName(tail)


@query("load_range_report", sql(
    "select series_id, min(timestamp) as first_ts, max(timestamp) as last_ts, count(*) as n_rows from hl group by 1", "hl"))
def load_range_report(spark, sf):
    from loadweave.operators.gaps import series_bounds
    return series_bounds(adapters.hourly_load(spark, sf), HOURLY)


@query("seeded_sample", sql(
    f"select {_JOINED} from hj order by md5(concat(series_id, '|', strftime(timestamp, '%Y-%m-%d %H:%M:%S'), '|42')), series_id, timestamp limit 20",
    "hj"))
def seeded_sample(spark, sf):
    """Twenty rows drawn by hash, then in time order: the same rows on every run."""
    joined = hourly_joined(spark, sf)
    draw = F.md5(F.concat("series_id", F.lit("|"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("|42")))
    drawn = joined.orderBy(draw, "series_id", "timestamp").limit(20)
    return rounded(drawn.orderBy("timestamp", "series_id"), 6, *JOINED_VALUES[1:])


@query("describe_joined", sql(
    "select column_name, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min, "
    "round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75, "
    "round(max(v), 6) as max from (unpivot (select actual_load_mw, temp_c, humidity_pct, tmax from hj) "
    "on columns(*) into name column_name value v) group by 1", "hj"))
def describe_joined(spark, sf):
    out = profile.describe(materialise(hourly_joined(spark, sf), "joined"), [TARGET, "temp_c", "humidity_pct", "tmax"])
    return rounded(out, 6, "mean", "std", "min", "p25", "p50", "p75", "max")
