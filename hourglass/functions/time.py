"""Time expressions that do not depend on the session time zone.

All timestamps in hourglass are ``timestamp_ntz`` (wall clock, no zone), the
type the parquet inputs carry. Spark's ``date_trunc`` returns a zoned
timestamp, so flooring is written as "NTZ midnight + an interval of whole
hours", which is exact in any session zone and stays inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The datetime layouts of the raw trip files, in the order they
# are tried. Single letters also take two digits, and bracketed parts may be
# missing, so these cover ISO times with and without a fraction and US times
# with one- or two-digit months, days and hours, with and without seconds.
TRIP_TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "M/d/yyyy H:mm[:ss][.SSSSSS]",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_ntz(c) -> Column:
    """Cast any date / timestamp column to ``timestamp_ntz``."""
    return _col(c).cast("timestamp_ntz")


def day_start(c) -> Column:
    """Midnight of the row's day, as ``timestamp_ntz``."""
    return F.to_date(_col(c)).cast("timestamp_ntz")


def hour_floor(c) -> Column:
    """Truncate a timestamp to the start of its hour (NTZ)."""
    c = _col(c)
    return day_start(c) + F.make_dt_interval(hours=F.hour(c))


def hour_bucket(c, hours: int) -> Column:
    """Start of the ``hours``-wide block of the day that holds ``c``.

    Blocks restart at midnight: block i covers hours [i*k, (i+1)*k) of the
    day, the last one possibly shorter when 24 is not a multiple of k.
    """
    if hours < 1 or hours > 24:
        raise ValueError("bucket width must be between 1 and 24 hours")
    c = _col(c)
    if hours == 1:
        return hour_floor(c)
    block = F.floor(F.hour(c) / F.lit(hours)).cast("int") * F.lit(hours)
    return day_start(c) + F.make_dt_interval(hours=block)


def whole_days_between(start, end) -> Column:
    """Calendar days from ``start``'s date to ``end``'s date."""
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start)))


def day_of_week(c) -> Column:
    """Day of week with Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(_col(c))


def parse_timestamps(c, formats=TRIP_TIME_FORMATS) -> Column:
    """First format that parses wins; unparseable text gives NULL (NTZ)."""
    c = _col(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz")
                        for f in formats])
