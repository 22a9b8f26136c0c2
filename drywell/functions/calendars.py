"""Calendar expressions: no-leap and Gregorian day-of-year dates, month ends, month ranges, periods."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALENDARS = ("noleap_365", "gregorian")


def noleap_date(year: Column, doy: Column) -> Column:
    """The date of day 1..365 in a calendar without 29 February; else null."""
    at = F.date_add(F.lit("2001-01-01").cast("date"), F.when(doy.between(1, 365), doy - 1).otherwise(F.lit(0)).cast("int"))
    return F.when(doy.between(1, 365) & year.between(1, 9999), F.make_date(F.when(year.between(1, 9999), year).otherwise(F.lit(2001)), F.month(at), F.dayofmonth(at)))


def gregorian_date(year: Column, doy: Column) -> Column:
    """The date of a day of the year; null where the year has no such day."""
    first = F.make_date(F.when(year.between(1, 9999), year).otherwise(F.lit(2001)), F.lit(1), F.lit(1))
    at = F.date_add(first, F.when(doy.between(1, 366), doy - 1).otherwise(F.lit(0)).cast("int"))
    return F.when(year.between(1, 9999) & doy.between(1, 366) & (F.year(at) == year), at)


def doy_date(year: Column, doy: Column, calendar: str) -> Column:
    if calendar not in CALENDARS:
        raise ValueError(f"calendar must be one of {CALENDARS}, not {calendar}")
    return noleap_date(year, doy) if calendar == "noleap_365" else gregorian_date(year, doy)


def month_end(date: Column, calendar: str) -> Column:
    """The last day of a date's month; 28 February in every year of the no-leap calendar."""
    last = F.last_day(date)
    if calendar == "noleap_365":
        return F.when((F.month(last) == 2) & (F.dayofmonth(last) == 29), F.date_sub(last, 1)).otherwise(last)
    return last


def month_index(year: Column, month: Column) -> Column:
    """Months since year 0, for differences and ranges."""
    return year.cast("int") * 12 + month.cast("int") - 1


def month_hours(date: Column) -> Column:
    """Hours in a date's month."""
    return F.dayofmonth(F.last_day(date)) * 24


def monthly_total(value: Column, date: Column, variable: Column | str) -> Column:
    """Rates per hour of precipitation to totals of the month; other variables stay."""
    name = F.lit(variable) if isinstance(variable, str) else variable
    return F.when(F.lower(name) == "prec", value * month_hours(date)).otherwise(value)


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(month 'yyyy-MM', year, month_of_year, position from 0) of all months from start to end, both 'yyyy-MM'."""
    first, last = (F.to_date(F.lit(f"{m}-01")) for m in (start, end))
    months = spark.range(1).select(F.posexplode(F.sequence(first, last, F.expr("interval 1 month"))).alias("position", "d"))
    return months.select(F.date_format("d", "yyyy-MM").alias("month"), F.year("d").alias("year"), F.month("d").alias("month_of_year"), "position")


def band_of_month(month: Column, first: str = "1979-01") -> Column:
    """1 for the first month of a stack of monthly bands, by 'yyyy-MM'."""
    year, m = map(int, first.split("-"))
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - (year * 12 + m) + 1


def parse_period(text: str) -> tuple[int, int]:
    """'1999-2003' to (1999, 2003)."""
    found = re.fullmatch(r"\s*(\d{4})\s*-\s*(\d{4})\s*", text)
    if not found or int(found[1]) > int(found[2]):
        raise ValueError(f"a period is START-END with START at most END, not {text!r}")
    return int(found[1]), int(found[2])


#: Seconds of the units that time axes count in.
SECONDS = {"second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86_400, "d": 86_400}
SINCE = re.compile(r"\s*(\w+?)s?\s+since\s+(-?\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?\s*(?:Z|UTC|[+-]0?0:?00)?\s*$", re.IGNORECASE)
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def _days_before(year: int, kind: str) -> int:
    """Days from 0000-01-01 to a year's first day."""
    if kind == "standard":
        return 365 * year + -(-year // 4) - -(-year // 100) + -(-year // 400)
    return year * {"noleap": 365, "all_leap": 366, "360_day": 360}[kind]


def _month_days(year: int, kind: str) -> list[int]:
    if kind == "360_day":
        return [30] * 12
    long = kind == "all_leap" or kind == "standard" and _leap(year)
    return [d + (long and k == 1) for k, d in enumerate(MONTH_DAYS)]


def time_axis(values, units: str, calendar: str = "standard") -> list[tuple[int, int, int]]:
    """(year, month, day) of values in 'units since a date' of a calendar; also 'months since' and 'years since', in whole ones.

    The standard calendar is taken as proleptic Gregorian; a calendar or unit that isn't known is an error.
    """
    kind = {"standard": "standard", "gregorian": "standard", "proleptic_gregorian": "standard", "noleap": "noleap", "365_day": "noleap", "all_leap": "all_leap", "366_day": "all_leap", "360_day": "360_day"}.get(calendar.lower())
    found = SINCE.match(units)
    if kind is None or not found:
        raise ValueError(f"time axis in {units!r} of calendar {calendar!r}")
    unit, (year, month, day) = found[1].lower(), map(int, found.groups()[1:4])
    if unit in ("month", "year"):
        at = [year * 12 + month - 1 + int(v) * (12 if unit == "year" else 1) for v in values]
        return [(m // 12, m % 12 + 1, day) for m in at]
    if unit not in SECONDS:
        raise ValueError(f"unit {unit!r} of a time axis")
    first = _days_before(year, kind) + sum(_month_days(year, kind)[: month - 1]) + day - 1
    begin = int(found[5] or 0) * 3600 + int(found[6] or 0) * 60 + float(found[7] or 0)
    out = []
    for v in values:
        days = first + int((begin + float(v) * SECONDS[unit]) // 86_400)
        year = int(days // 365.2425) if kind == "standard" else days // {"noleap": 365, "all_leap": 366, "360_day": 360}[kind]
        while _days_before(year, kind) > days:
            year -= 1
        while _days_before(year + 1, kind) <= days:
            year += 1
        left, m = days - _days_before(year, kind), 0
        for n in _month_days(year, kind):
            if left < n:
                break
            left, m = left - n, m + 1
        out.append((year, m + 1, left + 1))
    return out


def season_angle(month: Column) -> Column:
    return F.lit(2 * 3.141592653589793) * month / 12.0


def target_months(spark: SparkSession, scale: int, first: str = "1979-01", start: str | None = None, end: str = "2018-12") -> DataFrame:
    """Months of a grid for which the scale's window is complete, within start..end; position counts from `first`."""
    months = month_range(spark, first, end).where(F.col("position") >= scale - 1)
    return months if start is None else months.where(F.col("month") >= start)


def scale_label(scale: Column) -> Column:
    """3 to 'SPEI-3'."""
    return F.format_string("SPEI-%d", scale)


def scale_code(scale: Column) -> Column:
    """3 to 'spei03'."""
    return F.format_string("spei%02d", scale)
