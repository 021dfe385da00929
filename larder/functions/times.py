"""Durations, relative times and expiry dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"(?i)^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?)?$"


def iso_minutes(c: Column) -> Column:
    """Whole minutes of an ISO 8601 duration; null for none and for what isn't one."""
    t = F.trim(c)
    part = lambda i: F.coalesce(F.regexp_extract(t, ISO, i).try_cast("long"), F.lit(0))
    total = part(1) * 10080 + part(2) * 1440 + part(3) * 60 + part(4)
    return F.when(t.rlike(ISO) & (total > 0), total)


def duration_text(c: Column) -> Column:
    """``1 hr 15 min`` of an ISO 8601 duration; empty for none."""
    m = iso_minutes(c)
    hours, rest = F.floor(m / 60), m % 60
    h, r = F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" hr"))), F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" min")))
    return F.concat_ws(" ", h, r)


def relative_time(stamp: Column, now: Column) -> Column:
    """How long ago, as a feed says it; text that isn't a time stays as it is."""
    t, n = F.try_to_timestamp(stamp), F.try_to_timestamp(now)
    s = F.timestamp_diff("SECOND", t, n)
    days = F.when(F.year(t) == F.year(n), F.date_format(t, "MMM d")).otherwise(F.date_format(t, "MMM d, yyyy"))
    said = F.when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d"))).otherwise(days)
    return F.when(stamp.isNull(), "").when(t.isNull(), stamp).otherwise(said)


def expiry(c: Column) -> Column:
    """A date or time as fixed-width text; null for what is neither."""
    return F.date_format(F.try_to_timestamp(F.replace(F.trim(c), F.lit("T"), F.lit(" "))), "yyyy-MM-dd HH:mm:ss")
