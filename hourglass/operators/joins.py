"""A binned range (theta) join and hour explosion, without nested loops or hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.time import day_start

# Ways each day of the interval side is spread; the points are repeated as often.
SALTS = 8


def range_join(points: DataFrame, intervals: DataFrame, point_col: str,
               start_col: str, end_col: str, salts: int = SALTS) -> DataFrame:
    """``points JOIN intervals ON point BETWEEN start AND end`` (inner) without a nested loop.

    Each interval is split into the calendar days it touches (one row per
    day), each point gets its day, and the two meet on an equi-join on (day,
    salt) with the BETWEEN kept as a residual filter. Work scales with the
    output, not with points x intervals. The salt is a hash of the interval:
    a day on which every interval is alive spreads over ``salts`` tasks, and
    a point row is repeated once per salt. No size is assumed and no hint is
    given: adaptive execution broadcasts a side that turns out small.
    """
    day, salt = "__rj_day", "__rj_salt"
    iv = (intervals.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in intervals.columns]), F.lit(salts)))
          .withColumn(day, F.explode(F.sequence(F.to_date(F.col(start_col)), F.to_date(F.col(end_col))))))
    pt = (points.withColumn(day, F.to_date(F.col(point_col)))
          .withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
    joined = iv.join(pt, on=[day, salt])
    return joined.filter(F.col(point_col).between(F.col(start_col), F.col(end_col))).drop(day, salt)


def explode_hours(intervals: DataFrame, start_col: str, end_col: str,
                  out_col: str = "hour", spread_partitions: int | None = None,
                  key_col: str | None = None) -> DataFrame:
    """One row per whole hour in [start, end] for each interval row.

    Intervals are first split into days and (optionally) hash-spread on
    (key, day) so that a handful of long intervals does not make a handful
    of tasks generate every row; each day piece then expands to its hours.
    """
    day_col = "__eh_day"
    days = intervals.withColumn(
        day_col, F.explode(F.sequence(day_start(start_col), day_start(end_col),
                                      F.expr("INTERVAL 1 DAY"))))
    if spread_partitions:
        keys = [key_col, day_col] if key_col else [day_col]
        days = days.repartition(spread_partitions, *keys)
    lo = F.greatest(F.col(day_col), F.col(start_col))
    hi = F.least(F.col(day_col) + F.expr("INTERVAL 23 HOURS"), F.col(end_col))
    hours = days.withColumn(out_col, F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR"))))
    return hours.drop(day_col)
