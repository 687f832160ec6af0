"""Whole-day dates and seconds of a day, with their parts and roundings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idate(x: Column) -> Column:
    return F.to_date(x)


def itime(x: Column, ms: str = "truncate") -> Column:
    """Seconds since midnight as an integer."""
    micros = F.hour(x).cast("long") * 3_600_000_000 + F.minute(x).cast("long") * 60_000_000 + (F.date_format(x, "ss.SSSSSS").cast("decimal(8,6)") * 1_000_000).cast("long")
    seconds = {"truncate": F.floor(micros / 1e6), "nearest": F.round(micros / 1e6), "ceil": F.ceil(micros / 1e6)}[ms]
    return seconds.cast("int")


def date_time(date: Column, seconds: Column) -> Column:
    """The moment, without time zone, of a date and its second."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


year, month, mday, yday, quarter, wday = F.year, F.month, F.dayofmonth, F.dayofyear, F.quarter, F.dayofweek
isoweek, hour, minute, second = F.weekofyear, F.hour, F.minute, F.second


def week(x: Column, sequential: bool = False) -> Column:
    """Weeks of seven days from 1 January; the customary count begins its second week on day 7, not 8."""
    return (F.floor((F.dayofyear(x) - (1 if sequential else 0)) / 7) + 1).cast("int")


def isoyear(x: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), x)


def yearmon(x: Column, text: bool = False) -> Column:
    return F.format_string("%dM%02d", F.year(x), F.month(x)) if text else F.year(x) + (F.month(x) - 1) / F.lit(12.0)


def yearqtr(x: Column, text: bool = False) -> Column:
    return F.format_string("%dQ%d", F.year(x), F.quarter(x)) if text else F.year(x) + (F.quarter(x) - 1) / F.lit(4.0)


def round_date(x: Column, to: str) -> Column:
    """The first day of the date's unit; weeks are counted from 1 January."""
    if to == "weeks":
        start = F.trunc(x, "year")
        return F.date_add(start, (F.floor(F.dayofyear(x) / 7) * 7).cast("int"))
    return F.trunc(x, {"months": "month", "quarters": "quarter", "years": "year"}[to])


def round_itime(seconds: Column, to: str, truncate: bool = False) -> Column:
    unit = {"hours": 3600, "minutes": 60}[to]
    return ((F.floor(seconds / unit) if truncate else F.round(seconds / unit)) * unit).cast("int")


def format_itime(seconds: Column) -> Column:
    a = F.abs(seconds)
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d", F.floor(a / 3600), F.floor(a / 60) % 60, a % 60))


def mean_date(x: Column) -> Column:
    """Mean of whole-day dates, in whole days; missing without any. ``F.min`` and ``F.max`` do for the others."""
    return F.date_from_unix_date(F.avg(F.unix_date(x)).cast("int"))


def date_seq(start: Column, end: Column, by: str = "1 day") -> Column:
    """Dates from start to end, both included, as an array; ``by`` is a number of days, weeks, months or years."""
    return F.sequence(start, end, F.expr(f"interval {by}"))


def date_cut(x: Column, unit: str) -> Column:
    """The first day of the date's week (Monday), month, quarter or year."""
    return F.trunc(x, {"weeks": "week", "months": "month", "quarters": "quarter", "years": "year"}[unit])
