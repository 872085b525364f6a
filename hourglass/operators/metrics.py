"""Forecast accuracy metrics and the single-entity forecast extract.

Metric names keep the reference's meaning: MAE is the mean *signed* error
(bias), MAD the mean absolute error, MAPE divides by y with y = 0 terms
skipped (``try_divide`` gives NULL, which SUM ignores; the row still counts
in n). Rows are in-sample: ds <= the station's end date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _error_aggs() -> list[Column]:
    y = F.coalesce(F.col("y"), F.lit(0)).cast("double")
    y_corr = F.coalesce(F.col("y"), F.lit(1)).cast("double")
    err = F.col("yhat") - y
    return [F.count(F.lit(1)).alias("__n"),
            F.sum(err).alias("__e"),
            F.sum(F.abs(err)).alias("__abs"),
            F.sum(F.pow(err, 2)).alias("__sq"),
            F.sum(F.abs(F.try_divide(err, y_corr))).alias("__pct")]


def _metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("__n")
    return df.select(*keys,
                     (F.col("__e") / n).alias("MAE"),
                     (F.col("__abs") / n).alias("MAD"),
                     (F.col("__sq") / n).alias("MSE"),
                     F.pow(F.col("__sq") / n, 0.5).alias("RMSE"),
                     (F.col("__pct") / n).alias("MAPE"))


def _in_sample(forecast: DataFrame, stations: DataFrame) -> DataFrame:
    s = stations.select(F.col("station_id").alias("__sid"), "end_date")
    return forecast.join(s, (forecast["station_id"] == s["__sid"]) & (forecast["ds"] <= s["end_date"]))


def forecast_errors_by_entity(forecast: DataFrame, stations: DataFrame) -> DataFrame:
    """Per station: MAE, MAD, MSE, RMSE, MAPE."""
    g = _in_sample(forecast, stations).groupBy("station_id").agg(*_error_aggs())
    return _metrics(g, ["station_id"]).orderBy("station_id")


def forecast_errors(forecast: DataFrame, stations: DataFrame) -> DataFrame:
    """All stations together: one row of MAE, MAD, MSE, RMSE, MAPE."""
    return _metrics(_in_sample(forecast, stations).agg(*_error_aggs()), [])


def entity_forecast(forecast: DataFrame, active: DataFrame, station_id) -> DataFrame:
    """One station's forecast for display: future y masked to NULL, by time.

    A point filter on the station: with files sorted by station on write it
    skips row groups by their statistics.
    """
    a = active.filter(F.col("station_id") == station_id).select(
        F.col("station_id").alias("__sid"), "end_date")
    f = forecast.filter(F.col("station_id") == station_id)
    j = f.join(F.broadcast(a), f["station_id"] == a["__sid"])
    return j.select("ds", F.when(F.col("ds") > F.col("end_date"), F.lit(None)).otherwise(F.col("y")).alias("y"),
                    "yhat", "yhat_lower", "yhat_upper").orderBy("ds")
