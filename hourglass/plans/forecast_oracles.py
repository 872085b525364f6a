"""DuckDB oracles of the forecasting-stage queries.

The panel is a generated hourly series per station; errors are one row per
forecast, then one aggregate. The fitted values of the models have no SQL
equivalent: their rows, masked y and bands are checked, their quality by
tests.
"""

from __future__ import annotations

from hourglass.plans.demand_oracles import ACTIVE, BASE, DATES, RANKING, holidays_ctes, with_
from hourglass.plans.demand_queries import MOST_ACTIVE_N
from hourglass.plans.forecast_queries import ENSEMBLE_MEMBERS, HORIZON, PLACES, SERIES_START

MOST_ACTIVE = f"most_active AS (SELECT * FROM ranking ORDER BY Percent_Hours_With_No_Rentals, station_id LIMIT {MOST_ACTIVE_N})"
PANEL = (
    "hours AS (SELECT station_id, end_date, "
    f"unnest(generate_series(start_date, end_date + INTERVAL {HORIZON} HOUR, INTERVAL 1 HOUR)) AS ds FROM most_active), "
    "panel AS (SELECT h.station_id, h.ds, COALESCE(r.rentals, 0) AS y, CAST(h.ds <= h.end_date AS INTEGER) AS is_historical "
    "FROM hours h LEFT JOIN rentals r ON r.station_id = h.station_id AND r.hour = h.ds)")
WEATHER = ("weather AS (SELECT date_trunc('hour', ts) AS hour, MAX(value) AS max_temp_f, "
           "AVG(value) AS avg_temp_f, SUM(CASE WHEN event_type = 'error' THEN value END) AS precip_in "
           "FROM events GROUP BY 1)")
FC = ("fc AS (SELECT station_id, ds, CASE WHEN is_historical = 1 THEN CAST(y AS DOUBLE) END AS y, "
      f"round(AVG(CASE WHEN is_historical = 1 THEN y END) OVER w, {PLACES}) AS yhat, "
      "CAST(MIN(CASE WHEN is_historical = 1 THEN y END) OVER w AS DOUBLE) AS yhat_lower, "
      "CAST(MAX(CASE WHEN is_historical = 1 THEN y END) OVER w AS DOUBLE) AS yhat_upper "
      "FROM panel WINDOW w AS (PARTITION BY station_id, hour(ds)))")
HOLIDAY_DATES = "holiday_dates AS (SELECT DISTINCT CAST(date AS DATE) AS day FROM holidays)"
P = BASE + [DATES, ACTIVE, RANKING, MOST_ACTIVE, PANEL]


def _errors(by_station: bool) -> str:
    key, group = ("station_id, ", " GROUP BY station_id") if by_station else ("", "")
    off = ("off AS (SELECT station_id, yhat - COALESCE(y, 0) AS d, "
           "abs(yhat - COALESCE(y, 0)) / NULLIF(abs(COALESCE(y, 1)), 0) AS relative "
           "FROM fc JOIN stations USING (station_id) WHERE ds <= end_date)")
    mean = lambda x: f"SUM({x}) / COUNT(*)"
    return with_(P + [FC, off], f"SELECT {key}" + ", ".join(
        f"round({v}, {PLACES}) AS {name}" for name, v in (
            ("MAE", mean("d")), ("MAD", mean("abs(d)")), ("MSE", mean("d * d")),
            ("RMSE", f"sqrt({mean('d * d')})"), ("MAPE", mean("relative")))) + f" FROM off{group}")


def _model_rows(where: str = "", ctes: list[str] | None = None) -> str:
    return with_(P + (ctes or []), "SELECT p.station_id, p.ds, CASE WHEN p.is_historical = 1 THEN CAST(p.y AS DOUBLE) END AS y, "
                 f"TRUE AS has_yhat, TRUE AS band_ordered FROM panel p {where}")


ORACLES = {
    "forecast_panel": with_(P, "SELECT * FROM panel"),
    "forecast_panel_weather": with_(P + [WEATHER], f"""
SELECT p.station_id, p.ds, p.y, round(w.avg_temp_f, {PLACES}) AS temp_f,
       round(COALESCE(w.precip_in, 0), {PLACES}) AS precip_in, p.is_historical
FROM panel p LEFT JOIN weather w ON w.hour = p.ds"""),
    "time_features": with_(P + holidays_ctes() + [HOLIDAY_DATES], """
SELECT station_id, ds, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month,
       CAST(dayofweek(ds) + 1 AS INTEGER) AS dayofweek, CAST(hour(ds) AS INTEGER) AS hour,
       CAST(CAST(ds AS DATE) IN (SELECT day FROM holiday_dates) AS INTEGER) AS is_holiday, y, is_historical
FROM panel"""),
    "time_weather_features": with_(P + [WEATHER] + holidays_ctes() + [HOLIDAY_DATES], f"""
SELECT p.station_id, p.ds, CAST(year(p.ds) AS INTEGER) AS year,
       CAST(dayofweek(p.ds) + 1 AS INTEGER) AS dayofweek, CAST(hour(p.ds) AS INTEGER) AS hour,
       CAST(CAST(p.ds AS DATE) IN (SELECT day FROM holiday_dates) AS INTEGER) AS is_holiday,
       round(COALESCE(w.precip_in, 0), {PLACES}) AS precip_in, round(w.avg_temp_f, {PLACES}) AS avg_temp_f,
       p.y, p.is_historical
FROM panel p LEFT JOIN weather w ON w.hour = p.ds"""),
    "forecast_baseline": with_(P + [FC], "SELECT * FROM fc"),
    "forecast_errors_by_entity": _errors(True),
    "forecast_errors": _errors(False),
    "entity_forecast": with_(P + [FC], """
SELECT ds, CASE WHEN ds <= end_date THEN y END AS y, yhat, yhat_lower, yhat_upper
FROM fc JOIN stations_active USING (station_id)
WHERE station_id = (SELECT station_id FROM most_active ORDER BY Percent_Hours_With_No_Rentals, station_id LIMIT 1)"""),
    "ensemble_interval": with_(P, f"""
SELECT station_id, ds, y, round(AVG(m), {PLACES}) AS yhat,
       round(quantile_cont(m, 0.1), {PLACES}) AS yhat_lower, round(quantile_cont(m, 0.9), {PLACES}) AS yhat_upper
FROM (SELECT station_id, ds, y, y + (r.range - 5) * CAST(0.1 AS DOUBLE) AS m
      FROM panel, range({ENSEMBLE_MEMBERS}) r) x
GROUP BY station_id, ds, y"""),
    "forest_time_rows": _model_rows(),
    "forest_weather_rows": _model_rows("JOIN weather w ON w.hour = p.ds WHERE w.avg_temp_f IS NOT NULL", [WEATHER]),
    "additive_rows": _model_rows(),
    "additive_weather_rows": _model_rows("LEFT JOIN weather w ON w.hour = p.ds WHERE p.is_historical = 0 OR w.avg_temp_f IS NOT NULL", [WEATHER]),
    "additive_recovers": with_(P, f"""
SELECT station_id, ds, round(level + 4 * sin(2 * pi() * hour(ds) / 24), 1) AS yhat, round(level, 1) AS trend,
       round(4 * sin(2 * pi() * hour(ds) / 24), 1) AS daily, TRUE AS narrow
FROM (SELECT station_id, ds, 50 + station_id % 7 + CAST(0.1 AS DOUBLE) * date_diff('hour', TIMESTAMP '{SERIES_START}', ds) AS level FROM panel) x"""),
    "additive_weather_recovers": with_(P + [WEATHER], f"""
SELECT station_id, ds, round(COALESCE((temp - avg(known) OVER s) / stddev_pop(known) OVER s, 0), 6) AS z, TRUE AS yhat_right, TRUE AS terms_right
FROM (SELECT p.station_id, p.ds, p.is_historical, w.avg_temp_f AS temp, CASE WHEN p.is_historical = 1 THEN w.avg_temp_f END AS known
      FROM panel p LEFT JOIN weather w ON w.hour = p.ds) x
WINDOW s AS (PARTITION BY station_id)
QUALIFY is_historical = 0 OR temp IS NOT NULL"""),
    "forest_recovers": with_(P, """
SELECT station_id, ds, CAST(10 + (hour(ds) * 7) % 24 AS DOUBLE) AS yhat_lower, CAST(10 + (hour(ds) * 7) % 24 AS DOUBLE) AS yhat_upper,
       TRUE AS yhat_right FROM panel"""),
}
