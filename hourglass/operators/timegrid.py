"""Calendars, hourly periods and the US holiday table (pipeline A dims).

The calendar is derived from the stations table in one lazy chain: the two
bounds are a one-row aggregate and the dates come from ``sequence``; nothing
goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.time import day_start


# A calendar over more years is a fault of the data (a trip dated 9999), not a span.
MAX_YEARS = 200


def calendar_bounds(stations: DataFrame, extend_days: int = 10, max_years: int = MAX_YEARS) -> DataFrame:
    """One row: ``first_date`` (earliest start) and ``last_date``.

    ``last_date`` is midnight of the latest end date plus ``extend_days - 1``
    days, so the calendar holds ``extend_days`` dates after the data (the
    reference's day count is exclusive of its upper end). Raises where the
    data span more than ``max_years``: every later step is sized by the span.
    """
    too_long = F.datediff("last_data_date", "first_date") > 366 * max_years
    return stations.agg(
        F.min(day_start("start_date")).alias("first_date"),
        F.max(day_start("end_date")).alias("last_data_date"),
    ).select(
        "first_date",
        F.when(too_long, F.raise_error(F.lit(f"the data span more than {max_years} years")).cast("timestamp_ntz"))
        .otherwise(F.col("last_data_date") + F.make_dt_interval(days=F.lit(extend_days - 1))).alias("last_date"),
    )


def calendar(stations: DataFrame, extend_days: int = 10) -> DataFrame:
    """Dates (midnight, ``timestamp_ntz``) from the first start to last end + extension."""
    b = calendar_bounds(stations, extend_days)
    return b.select(F.explode(F.sequence("first_date", "last_date",
                                         F.expr("INTERVAL 1 DAY"))).alias("date"))


def hourly_calendar(dates: DataFrame) -> DataFrame:
    """Every hour of every calendar date (the ``periods`` table)."""
    return dates.select(F.explode(F.sequence(
        F.col("date"), F.col("date") + F.expr("INTERVAL 23 HOURS"),
        F.expr("INTERVAL 1 HOUR"))).alias("hour"))


def periods(stations: DataFrame, extend_days: int = 10) -> DataFrame:
    """Shortcut: ``hourly_calendar(calendar(stations, extend_days))``."""
    return hourly_calendar(calendar(stations, extend_days))


def calendar_years(dates: DataFrame) -> DataFrame:
    """Distinct years covered by a calendar (bounded by its span)."""
    return dates.select(F.year("date").alias("year")).distinct()


def holiday_hours(holidays: DataFrame, hours: DataFrame) -> DataFrame:
    """Every calendar hour that falls on a holiday: (ds, holiday)."""
    h = holidays.select(F.to_date("date").alias("__d"), "holiday")
    return (hours.join(h, F.to_date(hours["hour"]) == h["__d"])
            .select(hours["hour"].alias("ds"), "holiday"))
