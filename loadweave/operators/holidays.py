"""United States federal holidays as an expression of the date, so no lookup join is needed."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.config import LOCAL_ZONE, Layout
from loadweave.functions.timefn import to_local

MON, THU, FRI = 0, 3, 4

# Month, day and name of holidays kept on the nearest workday, with the date the
# calendar starts listing them (None: always).
FIXED_DAYS = [
    (1, 1, "New Year's Day", None),
    (6, 19, "Juneteenth National Independence Day", "2021-06-18"),
    (7, 4, "Independence Day", None),
    (11, 11, "Veterans Day", None),
    (12, 25, "Christmas Day", None),
]
# Month, weekday, first possible day of month, name, start date.
FLOATING_DAYS = [
    (1, MON, 15, "Birthday of Martin Luther King, Jr.", "1986-01-01"),
    (2, MON, 15, "Washington's Birthday", None),
    (5, MON, 25, "Memorial Day", None),
    (9, MON, 1, "Labor Day", None),
    (10, MON, 8, "Columbus Day", None),
    (11, THU, 22, "Thanksgiving Day", None),
]


def _case_text() -> str:
    """SQL ``case`` over ``_md`` (month * 100 + day), ``_wd`` (0 = Monday) and ``_day``.

    A fixed holiday on a Saturday is observed the Friday before, on a Sunday the Monday after.
    """
    def quoted(name: str) -> str:
        return "'" + name.replace("'", "\\'") + "'"

    branches = []
    for month, dom, name, since in FIXED_DAYS:
        day = date(2001, month, dom)
        before, after = day - timedelta(days=1), day + timedelta(days=1)
        hit = (f"((_wd <= {FRI} and _md = {month * 100 + dom})"
               f" or (_wd = {FRI} and _md = {before.month * 100 + before.day})"
               f" or (_wd = {MON} and _md = {after.month * 100 + after.day}))")
        branches.append((hit, name, since))
    for month, weekday, first, name, since in FLOATING_DAYS:
        at = month * 100 + first
        branches.append((f"(_wd = {weekday} and _md between {at} and {at + 6})", name, since))
    whens = [
        f"when {hit}{f' and _day >= date {since!r}' if since else ''} then {quoted(name)}"
        for hit, name, since in branches]
    return f"case {' '.join(whens)} end"


def add_holiday_name(df: DataFrame, day: Column, out: str = "holiday_name") -> DataFrame:
    """Name of the holiday observed on a date, else null."""
    parts = df.withColumn("_day", day).withColumns({
        "_md": F.month("_day") * 100 + F.dayofmonth("_day"), "_wd": F.weekday("_day")})
    return parts.withColumn(out, F.expr(_case_text())).drop("_day", "_md", "_wd")


def federal_holidays(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """Table of holidays between two dates of each input row (one row per range)."""
    days = spans.select(F.explode(F.sequence(start.cast("date"), end.cast("date"))).alias("holiday_date")).distinct()
    return add_holiday_name(days, F.col("holiday_date")).where(F.col("holiday_name").isNotNull())


def federal_holidays_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    return federal_holidays(spark.range(1), F.lit(start), F.lit(end))


def calendar_bounds(df: DataFrame, layout: Layout, zone: str = LOCAL_ZONE) -> DataFrame:
    """Local first and last instant of each series: the span a holiday calendar is drawn for."""
    local = to_local(F.col(layout.ts), zone)
    return df.groupBy(*layout.keys).agg(F.min(local).alias("cal_start"), F.max(local).alias("cal_end"))


def with_holiday_name(df: DataFrame, layout: Layout, bounds: DataFrame, zone: str = LOCAL_ZONE,
                      out: str = "holiday_name") -> DataFrame:
    """Attach the holiday whose midnight lies within the calendar span, else null.

    A series that starts partway through a holiday does not see that day, since its midnight came
    before the span began.
    """
    named = add_holiday_name(df, F.to_date(to_local(F.col(layout.ts), zone)), "_name")
    midnight = F.to_date(to_local(F.col(layout.ts), zone)).cast("timestamp_ntz")
    return (
        named.join(bounds, list(layout.keys), "left")
        .withColumn(out, F.when(midnight.between(F.col("cal_start"), F.col("cal_end")), F.col("_name")))
        .drop("cal_start", "cal_end", "_name")
    )
