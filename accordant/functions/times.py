"""Time expressions. `as_of` is always given; nothing reads the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: datetime | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp")


def parse_ts(c: Column) -> Column:
    """ISO timestamp, else the first ten characters as a date, else null."""
    text = F.replace(F.trim(c), F.lit("Z"), F.lit("+00:00"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}|$)"), F.try_to_timestamp(text))
    return F.coalesce(iso, F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def strict_date(c: Column) -> Column:
    return F.when(
        c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    )


def within(ts: Column, as_of: datetime | str | Column, days: float) -> Column:
    """At or after the cut-off: the exact boundary is still fresh."""
    return ts >= moment(as_of) - F.make_dt_interval(secs=F.lit(float(days) * 86400.0))


def older_than(ts: Column, as_of: datetime | str | Column, days: float) -> Column:
    """Strictly before the cut-off."""
    return ts < moment(as_of) - F.make_dt_interval(secs=F.lit(float(days) * 86400.0))


def is_fresh(ts: Column, as_of: datetime | str | Column, days: float) -> Column:
    return F.coalesce(within(ts, as_of, days), F.lit(False))


def deadline_within(c: Column, as_of: datetime | str | Column, days: int) -> Column:
    """Strict dates from today up to n days ahead; free text is excluded."""
    today = moment(as_of).cast("date")
    return F.coalesce(strict_date(c).between(today, F.date_add(today, days)), F.lit(False))
