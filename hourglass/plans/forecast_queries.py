"""Registered queries of the forecasting stage (panels, models, metrics)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourglass.operators import demand, forecast, metrics, panel
from hourglass.plans import demand_queries as dq
from hourglass.plans.prepared import base_table
from hourglass.sources import fixtures

HORIZON = 36
INTERVAL_WIDTH = 0.80
ENSEMBLE_MEMBERS = 10
PLACES = 8
TIME_FEATURES = ["year", "month", "dayofweek", "hour", "is_holiday"]
TIME_WEATHER_FEATURES = ["year", "dayofweek", "hour", "is_holiday", "precip_in", "avg_temp_f"]
ERROR_COLS = ["MAE", "MAD", "MSE", "RMSE", "MAPE"]


def weather(spark, sf):
    """The hourly weather table (built once where the build step is run)."""
    return base_table(spark, sf, "weather", lambda: fixtures.weather(spark, sf))


def most_active(spark, sf):
    return base_table(spark, sf, "most_active", lambda: demand.stations_most_active(
        dq.rentals(spark, sf), dq.stations_active(spark, sf), dq.MOST_ACTIVE_N))


def base_panel(spark, sf):
    return panel.forecast_panel(most_active(spark, sf), dq.rentals(spark, sf), dq.periods(spark, sf), HORIZON)


def baseline_forecast(spark, sf):
    return forecast.profile_forecast(base_panel(spark, sf), PLACES)


def _rounded(df, cols):
    return df.select(*[F.round(c, PLACES).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_forecast_panel(spark, sf):
    return base_panel(spark, sf)


def q_forecast_panel_weather(spark, sf):
    p = panel.with_weather(base_panel(spark, sf), weather(spark, sf))
    return _rounded(p, ["temp_f", "precip_in"])


def q_time_features(spark, sf):
    return panel.time_features(base_panel(spark, sf), dq.holidays(spark, sf))


def q_time_weather_features(spark, sf):
    f = panel.time_weather_features(base_panel(spark, sf), dq.holidays(spark, sf), weather(spark, sf))
    return _rounded(f, ["precip_in", "avg_temp_f"])


def q_forecast_baseline(spark, sf):
    return baseline_forecast(spark, sf)


def q_forecast_errors_by_entity(spark, sf):
    m = metrics.forecast_errors_by_entity(baseline_forecast(spark, sf), dq.stations(spark, sf))
    return _rounded(m, ERROR_COLS)


def q_forecast_errors(spark, sf):
    m = metrics.forecast_errors(baseline_forecast(spark, sf), dq.stations(spark, sf))
    return _rounded(m, ERROR_COLS)


def q_entity_forecast(spark, sf):
    """The first station of the most-active ranking (a data-derived point filter)."""
    pick = most_active(spark, sf).limit(1).select("station_id").scalar()
    return metrics.entity_forecast(baseline_forecast(spark, sf), dq.stations_active(spark, sf), pick)


def q_ensemble_interval(spark, sf):
    """Members y + (i - 5) * 0.1, i = 0..9, around every panel row."""
    p = base_panel(spark, sf)
    members = F.transform(F.sequence(F.lit(0), F.lit(ENSEMBLE_MEMBERS - 1)),
                          lambda i: F.col("y") + (i - 5) * F.lit(0.1))
    e = forecast.ensemble_interval(p.select("station_id", "ds", "y", members.alias("members")),
                                   "members", INTERVAL_WIDTH)
    return _rounded(e.drop("members"), ["yhat", "yhat_lower", "yhat_upper"])


def q_forecast_forest_time(spark, sf):
    feats = panel.time_features(base_panel(spark, sf), dq.holidays(spark, sf))
    return forecast.forest_forecast(feats, TIME_FEATURES, interval_width=INTERVAL_WIDTH)


def q_forecast_forest_weather(spark, sf):
    feats = panel.time_weather_features(base_panel(spark, sf), dq.holidays(spark, sf),
                                        weather(spark, sf))
    return forecast.forest_forecast(feats, TIME_WEATHER_FEATURES, interval_width=INTERVAL_WIDTH)


def q_forecast_additive(spark, sf):
    return forecast.additive_forecast(base_panel(spark, sf), dq.holidays(spark, sf),
                                      interval_width=INTERVAL_WIDTH)


def q_forecast_additive_weather(spark, sf):
    pw = panel.with_weather(base_panel(spark, sf), weather(spark, sf))
    # The test tables hold no weather after the last event, so future hours take the mean.
    return forecast.additive_forecast(pw, dq.holidays(spark, sf), regressors=("temp_f", "precip_in"),
                                      interval_width=INTERVAL_WIDTH, missing_future="mean")


def _rows_of(model):
    """What SQL can say of a model's output: its rows, the masked y, a forecast and an ordered band."""
    def q(spark, sf):
        return model(spark, sf).select("station_id", "ds", F.col("y").cast("double").alias("y"),
                                       F.col("yhat").isNotNull().alias("has_yhat"),
                                       (F.col("yhat_lower") <= F.col("yhat_upper")).alias("band_ordered"))
    return q


def q_forecast_errors_forest(spark, sf):
    """Accuracy of the time-only forest per station (the reference's metrics
    query, run on that model's forecast table)."""
    m = metrics.forecast_errors_by_entity(q_forecast_forest_time(spark, sf), dq.stations(spark, sf))
    return _rounded(m, ERROR_COLS)


def q_forecast_errors_additive(spark, sf):
    """Accuracy of the additive model, all stations together."""
    m = metrics.forecast_errors(q_forecast_additive(spark, sf), dq.stations(spark, sf))
    return _rounded(m, ERROR_COLS)


# Noise-free series over the panel's rows, which the models must give back.
SERIES_START = "2024-01-01 00:00:00"


def _course(p):
    """The panel with y = 50 + station_id % 7 + 0.1 * hours + 4 * sin(2 pi * hour of day / 24) in place of the counts."""
    hours = F.expr(f"timestampdiff(HOUR, timestamp_ntz'{SERIES_START}', ds)")
    y = F.lit(50) + F.col("station_id") % 7 + F.lit(0.1) * hours + F.lit(4) * F.sin(F.lit(2 * math.pi) * F.hour("ds") / 24)
    return p.withColumn("y", y.cast("double"))


def q_additive_recovers(spark, sf):
    """The additive model fitted to a trend with a daily cycle: its fit and forecast, to one place."""
    f = forecast.additive_forecast(_course(base_panel(spark, sf)), dq.holidays(spark, sf), interval_width=INTERVAL_WIDTH, yearly=False)
    return f.select("station_id", "ds", F.round("yhat", 1).alias("yhat"), F.round("trend", 1).alias("trend"), F.round("daily", 1).alias("daily"),
                    (F.col("trend_upper") - F.col("trend_lower") < 0.1).alias("narrow"))


def q_additive_weather_recovers(spark, sf):
    """The additive model fitted to a trend times a standardised regressor: its multiplicative terms, to three places."""
    p = _course(panel.with_weather(base_panel(spark, sf), weather(spark, sf)))
    known = F.when((F.col("is_historical") == 1) & F.col("temp_f").isNotNull(), F.col("temp_f"))
    w = Window.partitionBy("station_id")
    z = F.coalesce((F.col("temp_f") - F.avg(known).over(w)) / F.stddev_pop(known).over(w), F.lit(0.0))
    hours = F.expr(f"timestampdiff(HOUR, timestamp_ntz'{SERIES_START}', ds)")
    p = p.withColumn("z", z).withColumn("y", F.lit(50) + F.lit(0.1) * hours * 1.0).withColumn("y", F.col("y") * (1 + F.lit(0.2) * F.col("z")))
    f = forecast.additive_forecast(p, dq.holidays(spark, sf), regressors=("temp_f",), interval_width=INTERVAL_WIDTH, yearly=False, missing_future="mean")
    expected = p.select("station_id", "ds", F.col("y").alias("expected"), F.round("z", 6).alias("z"))
    return (f.join(expected, ["station_id", "ds"]).select(
        "station_id", "ds", "z", (F.abs(F.col("yhat") - F.col("expected")) < 0.2).alias("yhat_right"),
        (F.abs(F.col("multiplicative_terms") - 0.2 * F.col("z")) < 0.005).alias("terms_right")))


def q_forest_recovers(spark, sf):
    """The time forest fitted to a series of the hour of the day: its band, and whether its mean is right."""
    feats = panel.time_features(base_panel(spark, sf), dq.holidays(spark, sf))
    y = (10 + F.pmod(F.col("hour") * 7, F.lit(24))).cast("double")
    f = forecast.forest_forecast(feats.withColumn("y", y), TIME_FEATURES, interval_width=INTERVAL_WIDTH)
    expected = 10 + F.pmod(F.hour("ds") * 7, F.lit(24))
    return f.select("station_id", "ds", F.round("yhat_lower", 6).alias("yhat_lower"), F.round("yhat_upper", 6).alias("yhat_upper"),
                    (F.abs(F.col("yhat") - expected) < 1).alias("yhat_right"))


QUERIES = {
    "forecast_panel": q_forecast_panel,
    "forecast_panel_weather": q_forecast_panel_weather,
    "time_features": q_time_features,
    "time_weather_features": q_time_weather_features,
    "forecast_baseline": q_forecast_baseline,
    "forecast_errors_by_entity": q_forecast_errors_by_entity,
    "forecast_errors": q_forecast_errors,
    "entity_forecast": q_entity_forecast,
    "ensemble_interval": q_ensemble_interval,
    "forecast_forest_time": q_forecast_forest_time,
    "forecast_forest_weather": q_forecast_forest_weather,
    "forecast_additive": q_forecast_additive,
    "forecast_additive_weather": q_forecast_additive_weather,
    "forecast_errors_forest": q_forecast_errors_forest,
    "forecast_errors_additive": q_forecast_errors_additive,
    "forest_time_rows": _rows_of(q_forecast_forest_time),
    "forest_weather_rows": _rows_of(q_forecast_forest_weather),
    "additive_rows": _rows_of(q_forecast_additive),
    "additive_weather_rows": _rows_of(q_forecast_additive_weather),
    "additive_recovers": q_additive_recovers,
    "additive_weather_recovers": q_additive_weather_recovers,
    "forest_recovers": q_forest_recovers,
}
