"""Dense (entity x hour) model inputs: history plus a forecast horizon.

Only the selected entities (the top-n most active; at most n rows) are
expanded, so the panel is bounded by n x calendar hours. The per-entity
hours come from the binned range join, never from a nested loop; joins carry
no hints, adaptive execution broadcasts what turns out small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.time import day_of_week
from hourglass.operators.joins import range_join


def forecast_panel(selected: DataFrame, rentals: DataFrame, hours: DataFrame,
                   horizon: int = 36, extend_days: int = 10) -> DataFrame:
    """``(station_id, ds, y, is_historical)`` for every calendar hour from a
    station's start to its end plus ``horizon`` hours.

    y = rentals in the hour, 0 when none; is_historical = ds <= end_date.
    ``extend_days`` is what the calendar of ``hours`` was extended by; it must
    hold the horizon.
    """
    if horizon > 24 * (extend_days - 1):
        raise ValueError(f"a horizon of {horizon} h needs a calendar extended by {-(-horizon // 24) + 1} days")
    sel = selected.select("station_id", "start_date", "end_date",
                          (F.col("end_date") + F.make_dt_interval(hours=F.lit(horizon))).alias("__until"))
    grid = range_join(hours, sel, "hour", "start_date", "__until")
    r = rentals.join(selected.select("station_id"), "station_id", "left_semi")
    p = grid.join(r, ["station_id", "hour"], "left")
    return p.select("station_id", F.col("hour").alias("ds"),
                    F.coalesce(F.col("rentals"), F.lit(0)).alias("y"),
                    F.when(F.col("hour") <= F.col("end_date"), 1).otherwise(0).alias("is_historical"))


def with_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Adds temp_f (average temperature, NULL kept) and precip_in (NULL -> 0).

    An hour listed twice in the weather table (local time repeats one each
    autumn) counts once, with the larger values, so no panel row is repeated.
    """
    w = weather.groupBy(F.col("hour").alias("__wh")).agg(F.max("avg_temp_f").alias("avg_temp_f"),
                                                        F.max("precip_in").alias("precip_in"))
    j = panel.join(w, panel["ds"] == w["__wh"], "left")
    return j.select("station_id", "ds", "y", F.col("avg_temp_f").alias("temp_f"),
                    F.coalesce(F.col("precip_in"), F.lit(0.0)).alias("precip_in"), "is_historical")


def _holiday_flag(panel: DataFrame, holidays: DataFrame) -> DataFrame:
    h = holidays.select(F.to_date("date").alias("__hd")).distinct()
    j = panel.join(h, F.to_date(panel["ds"]) == h["__hd"], "left")
    return j.withColumn("is_holiday", F.when(F.col("__hd").isNull(), 0).otherwise(1)).drop("__hd")


def time_features(panel: DataFrame, holidays: DataFrame) -> DataFrame:
    """Calendar features for the time-only forest: year, month, dayofweek,
    hour, is_holiday (holidays joined on the date)."""
    j = _holiday_flag(panel, holidays)
    return j.select("station_id", "ds", F.year("ds").alias("year"), F.month("ds").alias("month"),
                    day_of_week("ds").alias("dayofweek"), F.hour("ds").alias("hour"),
                    "is_holiday", "y", "is_historical")


def time_weather_features(panel: DataFrame, holidays: DataFrame, weather: DataFrame) -> DataFrame:
    """Calendar + weather features (no month): year, dayofweek, hour,
    is_holiday, precip_in (NULL -> 0), avg_temp_f (NULL kept)."""
    pw = with_weather(panel, weather)
    j = _holiday_flag(pw, holidays)
    return j.select("station_id", "ds", F.year("ds").alias("year"), day_of_week("ds").alias("dayofweek"),
                    F.hour("ds").alias("hour"), "is_holiday", "precip_in",
                    F.col("temp_f").alias("avg_temp_f"), "y", "is_historical")
