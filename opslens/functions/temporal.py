"""Times are zone-free UTC (``TIMESTAMP_NTZ``), so results do not depend on the session time zone."""

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens import values as V


def instant(as_of: str | datetime) -> Column:
    """A literal for an explicit ``as_of``; a datetime with a zone is taken to UTC first."""
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
        as_of = as_of.isoformat()
    return F.lit(as_of).cast("timestamp_ntz")


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a time with its zone dropped; NULL if it does not parse."""
    return text.try_cast("timestamp_ntz")


def window_start(as_of: str | datetime, days: int = V.WINDOW_DAYS) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(days))


def in_trailing_window(time: Column, as_of: str | datetime, days: int = V.WINDOW_DAYS) -> Column:
    """Inclusive lower bound, no upper bound; NULL never passes. Written so that a filter reaches the scan."""
    return time.isNotNull() & (time >= window_start(as_of, days))


def in_date_range(day: Column, as_of: str | datetime, days: int = V.WINDOW_DAYS) -> Column:
    """Half-open range of whole days that ends before the day of ``as_of``."""
    end = instant(as_of).cast("date")
    return (day >= F.date_sub(end, days)) & (day < end)


def iso_format(time: Column) -> Column:
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def day_format(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")
