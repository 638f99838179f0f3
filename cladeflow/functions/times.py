"""Times without zone as numbers and months, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(name: str) -> Column:
    """Microseconds since 1970 of a time read as it stands."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{name}` as timestamp_ntz))")


def month(name: str) -> Column:
    return F.date_format(F.to_date(F.col(name)), "yyyy-MM")
