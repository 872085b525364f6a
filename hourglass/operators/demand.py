"""Hourly demand per entity: counts, lifecycles, activity and sparsity.

Pipeline A's first stage. Inputs are trips ``(station_id, start_time)``;
everything downstream is an aggregate over the hourly counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.time import (day_start, hour_bucket, hour_floor,
                                      parse_timestamps, whole_days_between)

SPARSITY_COL = "Percent_Hours_With_No_Rentals"


def trip_columns(raw: DataFrame, *keep: str, station_col: str = "start_station_id",
                 time_col: str = "start_time") -> DataFrame:
    """``(station_id int, start_time timestamp_ntz, *keep)`` of raw all-string trips; a bad id or time is NULL."""
    return raw.select(F.col(station_col).try_cast("int").alias("station_id"),
                      parse_timestamps(F.col(time_col)).alias("start_time"), *keep)


def clean_trips(raw: DataFrame, station_col: str = "start_station_id",
                time_col: str = "start_time") -> DataFrame:
    """Raw all-string trips -> ``(station_id int, start_time timestamp_ntz)``.

    Bad ids or times become NULL (``try_cast`` / ``try_to_timestamp``) and
    those rows are dropped, as the reference's "remove bad records" filter.
    """
    out = trip_columns(raw, station_col=station_col, time_col=time_col)
    return out.filter(F.col("station_id").isNotNull() & F.col("start_time").isNotNull())


def hourly_rentals(trips: DataFrame) -> DataFrame:
    """COUNT(*) of trips per station and hour: ``(station_id, hour, rentals int)``.

    Hash aggregate with a map-side partial count, so a hot station is
    reduced before the shuffle.
    """
    return (trips.groupBy("station_id", hour_floor("start_time").alias("hour"))
            .agg(F.count(F.lit(1)).cast("int").alias("rentals")))


def stations(rentals: DataFrame) -> DataFrame:
    """Station lifecycle: midnight of the first rental day to 23:00 of the last."""
    d = day_start("hour")
    return rentals.groupBy("station_id").agg(
        F.min(d).alias("start_date"),
        F.max(d + F.expr("INTERVAL 23 HOURS")).alias("end_date"),
    )


def stations_active(stations_df: DataFrame, min_history_days: int = 30) -> DataFrame:
    """Stations still open at the latest end date with more than N days of history.

    The latest end date is a one-row aggregate joined back by broadcast
    (a scalar subquery), so the stations table is not shuffled.
    """
    latest = F.broadcast(stations_df.agg(F.max("end_date").alias("__latest")))
    return (stations_df.join(latest, stations_df["end_date"] == latest["__latest"], "left_semi")
            .filter(whole_days_between("start_date", "end_date") > min_history_days))


def _bucket_index(c, hours: int):
    return F.floor(F.hour(c) / F.lit(hours)).cast("long")


def sparsity(rentals: DataFrame, active: DataFrame, bucket_hours: int = 1,
             keep_dates: bool = False) -> DataFrame:
    """Per active station: ``100 * periods / SUM(COALESCE(rentals per period, 1))``.

    Same value as the reference's dense (station x period) LEFT JOIN, but
    without building the grid: the number of periods between start and end
    is arithmetic, and only the periods that do have rentals are aggregated.

        denominator = sum of rentals over the station's periods
                      + (periods in range - periods with rentals)

    Periods are ``bucket_hours``-wide blocks that restart at midnight.
    Work is one partial/final aggregate over the rentals plus a join with
    the active stations on ``station_id``.
    """
    k = bucket_hours
    per_day = -(-24 // k)  # blocks per day, last one may be short
    a = active.select("station_id", "start_date", "end_date")
    b = hour_bucket("hour", k)
    # One shuffle of the rentals (on station_id); both aggregates below are
    # clustered by station_id already, so they add no exchange of the big side.
    in_range = (rentals.join(a, "station_id")
                .filter(b.between(hour_bucket("start_date", k), hour_bucket("end_date", k)))
                .groupBy("station_id", b.alias("__b"))
                .agg(F.sum("rentals").alias("__r")))
    agg = in_range.groupBy("station_id").agg(
        F.sum("__r").alias("__rentals"), F.count(F.lit(1)).alias("__busy"))
    n_periods = (whole_days_between("start_date", "end_date").cast("long") * per_day
                 + _bucket_index(F.col("end_date"), k) - _bucket_index(F.col("start_date"), k) + 1)
    out = a.join(agg, "station_id", "left").select(
        "station_id", "start_date", "end_date",
        n_periods.alias("__n"),
        F.coalesce("__rentals", F.lit(0)).alias("__rentals"),
        F.coalesce("__busy", F.lit(0)).alias("__busy"))
    pct = (F.lit(100) * F.col("__n")) / (F.col("__rentals") + F.col("__n") - F.col("__busy"))
    cols = ["station_id"] + (["start_date", "end_date"] if keep_dates else [])
    return out.select(*cols, pct.alias(SPARSITY_COL))


def stations_most_active(rentals: DataFrame, active: DataFrame, n: int = 200) -> DataFrame:
    """Top-n active stations by the sparsity ratio (lowest first).

    Ties are broken by ``station_id`` so the result is deterministic; Spark
    plans ``orderBy(...).limit(n)`` as a per-partition top-n and a final
    merge (TakeOrderedAndProject), never a global sort.
    """
    s = sparsity(rentals, active, 1, keep_dates=True)
    return s.orderBy(SPARSITY_COL, "station_id").limit(n)
