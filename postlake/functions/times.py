"""Publish times, months and the freshness window; none depends on the session time zone."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions.text import _col

_ISO = (r"\A(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?"
        r"(Z|[+-]\d{2}(?::?\d{2})?)?\z")


def iso_instant(c) -> Column:
    """Instant of an ISO string; without an offset it is UTC, unreadable text is null."""
    c = _col(c)
    day, clock, offset = (F.regexp_extract(c, _ISO, i) for i in (1, 2, 3))
    clock = F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))
                                                 ).otherwise(clock)
    hours, minutes = F.substring(offset, 1, 3), F.regexp_extract(offset, r"\d{2}:?(\d{2})\z", 1)
    zone = (F.when(offset.isin("", "Z"), "Z")
            .otherwise(F.concat(hours, F.lit(":"), F.when(minutes == "", "00").otherwise(minutes))))
    return F.when(day != "", F.concat(day, F.lit("T"), clock, zone).try_cast("timestamp"))


def iso_month(c) -> Column:
    """First day of the month as written in the string, whatever its offset."""
    return F.trunc(F.substring(_col(c), 1, 10).try_cast("date"), "MM")


def epoch_instant(c) -> Column:
    return F.timestamp_seconds(_col(c).try_cast("bigint"))


def utc_month(c) -> Column:
    """First day of the UTC month of an instant."""
    days = F.floor(F.unix_micros(_col(c).cast("timestamp")) / F.lit(86_400_000_000)).cast("int")
    return F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), days), "MM")


def instant(value) -> Column:
    """Literal instant from a datetime or ISO text (UTC when it has no offset)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    micros = (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def cutoff(as_of, days=vocab.WINDOW_DAYS) -> Column:
    """Oldest instant that still counts as fresh at ``as_of``."""
    return instant(as_of) - F.expr(f"INTERVAL {int(days) * 24} HOURS")
