"""Decimal years: one function per convention, since they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def year_length(y: Column) -> Column:
    return F.when(leap(y), 366).otherwise(365)


def day_midpoint(d: Column) -> Column:
    """Middle of the day: year + (day of year - 1/2) / length of the year."""
    return F.year(d) + (F.dayofyear(d) - 0.5) / year_length(F.year(d))


def month_midpoint(y: Column, m: Column) -> Column:
    """Middle of the month, in days of that year."""
    first = F.make_date(y, m, F.lit(1))
    return y + (F.dayofyear(first) - 1 + F.day(F.last_day(first)) / 2) / year_length(y)


def year_start_of_day(y: Column, m: Column, d: Column) -> Column:
    """Start of the day; a day past the month's end is held at its end."""
    last = F.day(F.last_day(F.make_date(y, m, F.lit(1))))
    day = F.make_date(y, m, F.greatest(F.lit(1), F.least(d, last)))
    return y + (F.dayofyear(day) - 1) / year_length(y)


def text_start_of_day(s: Column) -> Column:
    """`YYYY`, `YYYY-MM` or `YYYY-MM-DD` (also with /): a year alone means its middle, a month
    its middle day, a day its start; decimal years stay; null otherwise."""
    s = F.replace(F.trim(s), F.lit("/"), F.lit("-"))
    part = lambda k: F.regexp_extract(s, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", k)
    y, m, d = (F.when(part(k) != "", part(k).cast("int")) for k in (1, 2, 3))
    ok = (m.isNull() | m.between(1, 12)) & (d.isNull() | d.between(1, 31)) & y.between(1, 9999)
    whole = F.when(m.isNull(), y + 0.5).when(d.isNull(), year_start_of_day(y, m, F.lit(15))).otherwise(year_start_of_day(y, m, d))
    return F.when(s.rlike(r"^\d{4}\.\d+$"), s.cast("double")).when(ok, whole)


def header_token(s: Column, last: bool) -> Column:
    """First or last token between `|`, `_`, `.` or blanks that is a year from 1900 to 2099."""
    years = F.regexp_extract_all(s, F.lit(r"(?:^|[|_. ])((?:19|20)\d\d)(?=$|[|_. ])"), F.lit(1))
    return F.when(F.size(years) > 0, F.element_at(years, -1 if last else 1).cast("int"))
