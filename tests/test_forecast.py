"""Panels, metrics, ensemble bands and the two model families."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from conftest import SF_SMALL
from hourglass.operators import additive, forecast, metrics, panel
from hourglass.plans import demand_queries as dq
from hourglass.plans import forecast_queries as fq


def test_panel_is_dense_and_unique(spark):
    p = fq.base_panel(spark, SF_SMALL)
    assert p.groupBy("station_id", "ds").count().filter("count > 1").count() == 0
    sel = fq.most_active(spark, SF_SMALL).collect()
    expected = sum(int((r.end_date - r.start_date).total_seconds() // 3600) + 1 + fq.HORIZON for r in sel)
    assert p.count() == expected
    assert p.filter("is_historical = 0").count() == len(sel) * fq.HORIZON


def test_metrics_identities(spark):
    m = metrics.forecast_errors_by_entity(fq.baseline_forecast(spark, SF_SMALL), dq.stations(spark, SF_SMALL))
    for r in m.collect():
        assert abs(r.RMSE ** 2 - r.MSE) < 1e-9 and abs(r.MAE) <= r.MAD + 1e-12


def test_ensemble_interval_matches_numpy(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=7 + i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, m array<double>")
    out = forecast.ensemble_interval(df, "m", 0.8).collect()
    for r in out:
        assert abs(r.yhat_lower - np.percentile(r.m, 10)) < 1e-12
        assert abs(r.yhat_upper - np.percentile(r.m, 90)) < 1e-12
        assert abs(r.yhat - np.mean(r.m)) < 1e-12


def test_forest_band_is_ordered_and_future_y_is_null(spark):
    feats = panel.time_features(fq.base_panel(spark, SF_SMALL), dq.holidays(spark, SF_SMALL))
    f = forecast.forest_forecast(feats, fq.TIME_FEATURES, num_trees=10).collect()
    assert f and all(r.yhat_lower <= r.yhat_upper + 1e-12 for r in f)
    assert all(r.y is None for r in f if r.ds > dt.datetime(2024, 1, 30, 23))


def test_forest_sees_the_given_features_alone(spark):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h % 24), 1, 1) for h in range(480)]
    feats = spark.createDataFrame(rows, "station_id int, ds timestamp_ntz, y double, year int, is_historical int")
    out = forecast.forest_forecast(feats, ["year"], num_trees=10).collect()     # nothing tells the hours apart
    assert len({r.yhat for r in out}) == 1 and abs(out[0].yhat - 11.5) < 1.5


def test_forest_learns_every_stations_daily_cycle(spark):
    hours = 24 * 21
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 10 + 8 * math.sin(2 * math.pi * (h % 24) / 24 + s) * ((s % 5) + 1) / 5,
             h % 24, (h // 24) % 7, int(h < hours - 36)) for s in range(30) for h in range(hours)]
    feats = spark.createDataFrame(rows, "station_id int, ds timestamp_ntz, y double, hour int, dayofweek int, is_historical int")
    out = forecast.forest_forecast(feats, ["hour", "dayofweek"], num_trees=10).collect()
    truth = {(r[0], r[1]): r[2] for r in rows}
    assert np.mean([abs(r.yhat - truth[r.station_id, r.ds]) for r in out]) < 1e-3


def test_forest_learns_weather_and_weekday_of_each_station(spark):
    rng = np.random.default_rng(5)
    temps = rng.integers(30, 90, size=24 * 28)
    rows = []
    for s, days in ((1, 28), (2, 28), (3, 9)):               # station 3 is small
        for h in range(24 * (28 - days), 24 * 28):
            weekday, sign = (h // 24) % 7, 1 if s != 2 else -1
            y = 50 + 10 * s + sign * (8 * (weekday >= 5) + 12 * (temps[h] > 60))
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(y), h % 24, weekday, float(temps[h]), int(h < 24 * 28 - 36)))
    feats = spark.createDataFrame(rows, "station_id int, ds timestamp_ntz, y double, hour int, dayofweek int, avg_temp_f double, is_historical int")
    out = forecast.forest_forecast(feats, ["hour", "dayofweek", "avg_temp_f"], num_trees=20).collect()
    truth = {(r[0], r[1]): r[2] for r in rows}
    assert len(out) == len(rows)
    for s in (1, 2, 3):
        assert np.mean([abs(r.yhat - truth[s, r.ds]) for r in out if r.station_id == s and r.y is None]) < 0.5


def test_forest_trees_part_every_drawn_row():
    from hourglass.operators.forest import forest_members
    rng = np.random.default_rng(6)
    x, y = np.c_[rng.normal(size=400), rng.integers(0, 3, 400)], rng.normal(size=400)
    x[7], y[8], y[9] = x[6], 1e3, -1e3
    m = forest_members(x, y, x, 60, 0.6, [1])
    seen = np.random.default_rng([1]).integers(0, 400, size=(60, 240))
    for t in range(60):
        for i in np.unique(seen[t]):
            same = np.isin(seen[t], (6, 7)) if i in (6, 7) else seen[t] == i
            assert abs(m[i, t] - y[seen[t][same]].mean()) < 1e-9


def test_horizon_beyond_the_calendar_raises(spark):
    with pytest.raises(ValueError, match="extended"):
        panel.forecast_panel(fq.most_active(spark, SF_SMALL), dq.rentals(spark, SF_SMALL), dq.periods(spark, SF_SMALL), 217)


def test_repeated_weather_hours_do_not_repeat_panel_rows(spark):
    p = fq.base_panel(spark, SF_SMALL)
    w = fq.weather(spark, SF_SMALL)
    assert panel.with_weather(p, w.unionByName(w)).count() == p.count()


def test_missing_future_regressors_give_no_forecast_unless_asked():
    ds = pd.date_range("2020-01-01", periods=200, freq="h")
    pdf = pd.DataFrame({"station_id": 1, "ds": ds, "y": np.arange(200.0), "temp": np.r_[np.arange(180.0), [np.nan] * 20],
                        "is_historical": (np.arange(200) < 180).astype(int)})
    out = additive.fit_predict(pdf, regressors=("temp",), seasonalities=())
    assert out["yhat"].isna().sum() == 20
    assert additive.fit_predict(pdf, regressors=("temp",), seasonalities=(), missing_future="mean")["yhat"].notna().all()


def test_additive_recovers_trend_and_daily_cycle():
    ds = pd.date_range("2020-01-01", periods=24 * 60, freq="h")
    t = np.arange(len(ds))
    y = 10 + 0.01 * t + 3 * np.sin(2 * np.pi * t / 24)
    hist = len(ds) - 36
    pdf = pd.DataFrame({"station_id": 1, "ds": ds, "y": y, "is_historical": (t < hist).astype(int)})
    out = additive.fit_predict(pdf, seasonalities=additive.SEASONALITIES[:2])
    err = np.abs(out["yhat"].to_numpy() - y)
    assert err[:hist].max() < 0.5 and err[hist:].max() < 1.0
    assert (out["yhat_lower"] <= out["yhat"]).all() and (out["yhat"] <= out["yhat_upper"]).all()
    assert out["y"].isna().sum() == 36


def test_additive_forecast_on_panel(spark):
    f = fq.q_forecast_additive(spark, SF_SMALL)
    assert len(f.columns) == 27
    rows = f.collect()
    assert rows and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in rows)
    fw = fq.q_forecast_additive_weather(spark, SF_SMALL).collect()
    assert fw and not any(math.isnan(r.yhat) for r in fw)


def test_model_error_queries(spark):
    e = fq.q_forecast_errors_additive(spark, SF_SMALL).collect()
    assert len(e) == 1 and e[0].MAD >= abs(e[0].MAE) - 1e-9
