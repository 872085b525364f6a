"""The additive model's bands: horizon, coverage, closed forms, and the grouped map by Arrow tables."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa

from conftest import SF_SMALL
from hourglass.operators import additive
from hourglass.plans import forecast_queries as fq

HORIZON = 36


def _frame(y, hist, station=1, **more):
    ds = pd.date_range("2020-01-01", periods=len(y), freq="h")
    return pd.DataFrame({"station_id": station, "ds": ds, "y": y, "is_historical": (np.arange(len(y)) < hist).astype(int), **more})


def _walk(seed, hours, rate=25, size=0.6):
    """A daily cycle on a trend whose slope changes by Laplace steps, with noise: the model's own process, in which
    the last fifth of the history has no changes."""
    rng = np.random.default_rng(seed)
    t = np.arange(hours) / (hours - HORIZON)
    at = np.r_[rng.uniform(0, 0.8, rate), rng.uniform(1, t[-1], rng.poisson(rate * (t[-1] - 1)))]
    trend = 5 + t + np.maximum(0, t[:, None] - at) @ rng.laplace(0, size, len(at))
    return 10 * (trend + 0.2 * np.sin(2 * np.pi * np.arange(hours) / 24) + rng.normal(0, 0.1, hours))


def test_bands_widen_with_the_horizon():
    hours = 24 * 40
    out = additive.fit_predict(_frame(_walk(1, hours, size=6), hours - HORIZON), seasonalities=additive.SEASONALITIES[:1])
    for c, times in (("yhat", 1.1), ("trend", 2)):
        width = (out[f"{c}_upper"] - out[f"{c}_lower"]).to_numpy()
        ahead = width[-HORIZON:]
        assert ahead[-1] > times * ahead[0] and ahead[18:].mean() > ahead[:18].mean()
        assert ahead[-1] > np.median(width[:-HORIZON])
    assert list(out.columns) == additive.OUTPUT_COLUMNS and len(out.columns) == 27


def test_held_out_hours_are_covered_as_often_as_asked():
    hours, inside = 24 * 40, []
    for seed in range(60):
        y = _walk(seed, hours, size=2)
        out = additive.fit_predict(_frame(y, hours - HORIZON, seed), seasonalities=additive.SEASONALITIES[:1])
        inside.append(((out["yhat_lower"] <= y) & (y <= out["yhat_upper"])).to_numpy()[-HORIZON:])
    assert 0.75 <= np.mean(inside) <= 0.85


def test_seeded_by_station_alone():
    hours = 24 * 20
    y = _walk(3, hours)
    a, b, c = (additive.fit_predict(_frame(y, hours - HORIZON, s)) for s in (5, 5, 6))
    assert a["yhat_upper"].equals(b["yhat_upper"]) and not a["yhat_upper"].equals(c["yhat_upper"])
    assert np.allclose(a["yhat"], c["yhat"])


def test_blocks_of_steps_carry_level_and_slope(monkeypatch):
    t = np.linspace(0.01, 1, 100)
    rng = lambda: np.random.default_rng(1)
    whole = np.concatenate([c for _, c in additive.future_changes(t, 50.0, 0.3, rng(), 20000)], axis=1)
    monkeypatch.setattr(additive, "BLOCK_STEPS", 7)
    parts = np.concatenate([c for _, c in additive.future_changes(t, 50.0, 0.3, rng(), 20000)], axis=1)
    # Level after time t: changes at rate r of variance 2 s^2, each with time t - u to act: 2 r s^2 t^3 / 3.
    for course in (whole, parts):
        assert abs(course.mean()) < 0.05
        assert abs(course[:, -1].var() / (2 * 50 * 0.3 ** 2 / 3) - 1) < 0.1


def test_trend_band_is_that_of_a_straight_line():
    rng = np.random.default_rng(7)
    n = 400
    y = 3 + 0.02 * np.arange(n) + rng.normal(0, 1, n)
    out = additive.fit_predict(_frame(y, n), seasonalities=())
    t = np.arange(n)
    line = np.polyfit(t, y, 1)
    sigma = np.sqrt(np.mean((y - np.polyval(line, t)) ** 2))
    half = 1.2815515655446004 * sigma * np.sqrt(1 / n + (t - t.mean()) ** 2 / ((t - t.mean()) ** 2).sum())
    got = ((out["trend_upper"] - out["trend_lower"]) / 2).to_numpy()
    assert np.abs(got / half - 1).max() < 0.15
    assert np.abs(out["trend"] - np.polyval(line, t)).max() < 0.3
    assert (out["daily_upper"] == out["daily_lower"]).all()


def test_covariance_is_the_ridge_posterior():
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    cov = additive.covariance(x.T @ x, 0.5 * np.array([2.0, 4.0]), 0.5)
    assert np.allclose(cov, np.diag([0.5 / (2 + 1), 0.5 / (4 + 2)]))
    assert np.allclose(additive.spread(x, cov), [0.5 / 3, 0.5 / 3, 4 * 0.5 / 6])


def test_slope_changes_are_sparse():
    hours = 24 * 50
    t = np.arange(hours)
    y = 100 + 0.1 * t + 0.4 * np.maximum(0, t - 480) + np.random.default_rng(2).normal(0, 0.5, hours)
    rows = np.arange(hours) / (hours - 1)
    cps = rows[np.unique(np.linspace(0, int(0.8 * (hours - 1)), 26).round().astype(int)[1:])]
    x = np.column_stack([np.ones(hours), rows, np.maximum(0, rows[:, None] - cps)])
    fit = additive.Fit(x, np.zeros((hours, 0)), np.zeros(0), np.zeros((hours, 0)), y / y.max())
    size = np.sort(np.abs(fit.change))[::-1]
    assert size[:2].sum() > 0.75 * size.sum()
    assert abs(cps[np.argmax(np.abs(fit.change))] - 480 / hours) < 0.04


def test_regressor_band_shrinks_with_more_rows():
    def width(n):
        rng = np.random.default_rng(4)
        temp = rng.normal(60, 10, n)
        y = (50 + 0.01 * np.arange(n)) * (1 + 0.1 * (temp - 60) / 10) + rng.normal(0, 1, n)
        out = additive.fit_predict(_frame(y, n, temp=temp), regressors=("temp",), seasonalities=())
        assert np.abs(out["multiplicative_terms"] - 0.1 * (temp - temp.mean()) / temp.std()).max() < 0.05
        return np.median(out["multiplicative_terms_upper"] - out["multiplicative_terms_lower"])
    assert 1.7 < width(300) / width(1200) < 2.6


def test_arrow_groups_hold_nulls_and_order():
    y = _walk(8, 200)
    frame = _frame(y, 164).sample(frac=1, random_state=1)
    table = pa.Table.from_pandas(frame, preserve_index=False)
    out = additive.fit_table(table).to_pandas()
    assert out["ds"].is_monotonic_increasing and out["y"].isna().sum() == HORIZON and out["yhat"].notna().all()
    short = additive.fit_table(table.slice(0, 1))
    assert short.num_rows == 1 and short.column("yhat").null_count == 1


def test_rows_of_the_panel_come_back_once(spark):
    out = fq.q_forecast_additive(spark, SF_SMALL)
    assert out.count() == fq.base_panel(spark, SF_SMALL).count() == out.select("station_id", "ds").distinct().count()
    wide = out.filter("y IS NULL").groupBy("station_id").agg({"ds": "max"}).count()
    assert wide > 0 and math.isfinite(out.agg({"yhat_upper": "max"}).first()[0])
