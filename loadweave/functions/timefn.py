"""Clock and calendar expressions. Timestamps are UTC, stored without a zone."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadweave.config import LOCAL_ZONE, TREND_YEAR_SECONDS, Layout


def parse_utc(text: Column) -> Column:
    """Text with or without an offset -> UTC instant; unreadable text becomes null."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock of a UTC instant; follows daylight saving time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(to_local(ts, zone))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def tick(layout: Layout) -> Column:
    """Whole steps since the epoch: an integer clock that frames and blocks can count in."""
    seconds = F.unix_seconds(F.col(layout.ts).cast("timestamp"))
    return F.floor(seconds / F.lit(layout.step)).cast("long")


def years_since(ts: Column, origin: Column) -> Column:
    """Elapsed time in years of exactly 365 days."""
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))
    return micros / F.lit(1e6) / F.lit(float(TREND_YEAR_SECONDS))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def gate_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+00:00'")


def weekday_of(local: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(local)


def is_weekend(local: Column) -> Column:
    return F.weekday(local).isin(5, 6).cast("int")


def local_midnight_utc(text: str, zone: str = LOCAL_ZONE) -> datetime:
    """A local wall-clock time as a naive UTC datetime, for literals in plans."""
    local = datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone))
    return local.astimezone(timezone.utc).replace(tzinfo=None)


def ntz(moment: datetime | str) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")
