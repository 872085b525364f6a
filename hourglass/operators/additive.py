"""Per-entity additive time-series model, fitted with ``applyInArrow``.

Spark shuffles the panel by station and hands each station's rows (at most
one per calendar hour, so a bounded group) to one call as an Arrow table, of
which only the columns the fit needs become numpy arrays. The model follows
the public description of the additive forecasting model (Taylor & Letham,
"Forecasting at Scale", 2018):

    yhat = trend(t) * (1 + regressors) + daily + weekly + yearly + holidays

* trend: piecewise linear, hinges at 25 changepoints in the first 80 % of
  the history, with sparse (Laplace) priors on the changes of slope;
* seasonalities: Fourier series (orders 4 / 3 / 10 for periods of 1, 7 and
  365.25 days) on absolute time;
* holidays: one effect per holiday name for every hour of its dates;
* regressors (optional): standardised, multiplicative on the trend.

Fit: the posterior mode in closed form, the Laplace priors by reweighted ridge
rounds, the multiplicative part by alternating least squares.

Bands hold ``interval_width`` of the posterior. Around the mode it is normal
with covariance sigma^2 (X'X + sigma^2 P)^-1 (P: prior precisions), which gives
every component a band of its own; the regressors' is taken given the trend.
After the history the trend may change again: changes come at the
history's rate, with Laplace sizes of the history's mean absolute change.
``SIMULATIONS`` courses are drawn per station, with a seed of the station, and
the trend's and the forecast's bands are percentiles of them, so they widen
with the horizon. Only numpy and Arrow are used; the module is shipped to
executors by value.
"""

from __future__ import annotations

import sys
import zlib
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Model settings (defaults of the published model).
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0
HOLIDAY_PRIOR = 10.0
REGRESSOR_PRIOR = 10.0
TREND_PRIOR = 5.0
SEASONALITIES = (("daily", 1.0, 4), ("weekly", 7.0, 3), ("yearly", 365.25, 10))
SIMULATIONS = 1000

ROUNDS = 12                  # of reweighting and of alternating least squares
SMALLEST_CHANGE = 1e-4       # a slope change below it counts as none in the next round's weight
BLOCK_STEPS = 512            # future steps simulated at once
SEED = 42

COMPONENTS = ["trend", "multiplicative_terms", "daily", "weekly", "yearly", "additive_terms", "holidays"]
OUTPUT_COLUMNS = (["station_id", "ds", "y", "yhat", "yhat_lower", "yhat_upper"]
                  + [f"{c}{s}" for c in COMPONENTS for s in ("", "_lower", "_upper")])
OUTPUT_SCHEMA = ", ".join(["station_id int", "ds timestamp_ntz"]
                          + [f"{c} double" for c in OUTPUT_COLUMNS[2:]])


def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    ang = 2.0 * np.pi * np.outer(days, k) / period
    return np.column_stack([np.sin(ang), np.cos(ang)])


def ridge(gram: np.ndarray, moment: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    a = gram + np.diag(penalty)
    try:
        return np.linalg.solve(a, moment)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, moment, rcond=None)[0]


def covariance(gram: np.ndarray, penalty: np.ndarray, sigma2: float) -> np.ndarray:
    """The posterior covariance of ridge coefficients; ``penalty`` is sigma^2 times the prior precisions."""
    return sigma2 * np.linalg.pinv(gram + np.diag(penalty), hermitian=True)


def spread(x: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """The variance of each row's linear combination."""
    return np.maximum(np.einsum("ij,jk,ik->i", x, cov, x, optimize=True), 0.0)


def future_changes(t: np.ndarray, rate: float, size: float, rng: np.random.Generator, n: int = SIMULATIONS):
    """Simulated departures from the trend at the future times ``t`` (ascending, in history lengths after its end).

    Yields (first step, n x steps) blocks; level and slope are carried from block to block.
    """
    steps = np.diff(np.r_[0.0, t])
    level, slope = np.zeros(n), np.zeros(n)
    for start in range(0, len(t), BLOCK_STEPS):
        dt = steps[start:start + BLOCK_STEPS]
        changes = rng.poisson(rate * dt, (n, len(dt))).astype(float)
        some = changes > 0                  # a sum of k Laplace draws is a difference of two gamma draws of shape k
        changes[some] = rng.gamma(changes[some], size) - rng.gamma(changes[some], size)
        slopes = slope[:, None] + np.cumsum(changes, axis=1)
        course = level[:, None] + np.cumsum(slopes * dt, axis=1)
        yield start, course
        level, slope = course[:, -1], slopes[:, -1]


class Fit:
    """Coefficients, noise and posterior of one station's history (the first ``n`` rows)."""

    def __init__(self, trend_x: np.ndarray, add_x: np.ndarray, add_pen: np.ndarray, reg_x: np.ndarray, y: np.ndarray):
        n, n_trend = len(y), trend_x.shape[1]
        self.beta_r = np.zeros(reg_x.shape[1])
        change, sigma2 = np.full(n_trend - 2, CHANGEPOINT_PRIOR), max(float(np.var(y)), 1e-6)
        gram = None
        reg_pen = np.full(reg_x.shape[1], 1 / REGRESSOR_PRIOR ** 2)
        for _ in range(ROUNDS):
            if gram is None or reg_x.shape[1]:
                x = np.column_stack([trend_x[:n] * (1.0 + reg_x[:n] @ self.beta_r)[:, None], add_x[:n]])
                gram, moment = x.T @ x, x.T @ y
            # |d| / b has the ridge d^2 / (2 b |d0|) as its bound at d0.
            precision = np.r_[[1 / TREND_PRIOR ** 2] * 2, 1 / (CHANGEPOINT_PRIOR * np.maximum(np.abs(change), SMALLEST_CHANGE)), add_pen]
            beta = ridge(gram, moment, sigma2 * precision)
            change = beta[2:n_trend]
            trend, additive = trend_x[:n] @ beta[:n_trend], add_x[:n] @ beta[n_trend:]
            if reg_x.shape[1]:
                z = trend[:, None] * reg_x[:n]
                self.beta_r = ridge(z.T @ z, z.T @ (y - additive - trend), sigma2 * reg_pen)
                trend = trend * (1.0 + reg_x[:n] @ self.beta_r)
            last, sigma2 = sigma2, max(float(np.mean((y - trend - additive) ** 2)), 1e-9)
        self.beta_t, self.beta_a, self.sigma2, self.change = beta[:n_trend], beta[n_trend:], sigma2, change
        self.cov = covariance(gram, last * precision, sigma2)
        self.cov_r = covariance(z.T @ z, last * reg_pen, sigma2) if reg_x.shape[1] else np.zeros((0, 0))


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _holiday_columns(table: pa.Table) -> tuple[np.ndarray, int]:
    """0/1 columns of the holiday names. A station's rows hold few different sets of names: one row a set, picked by code."""
    if "holiday_names" not in table.column_names:
        return np.zeros((table.num_rows, 0)), 0
    sets = [tuple(h) if h else () for h in table.column("holiday_names").to_pylist()]
    code = {s: i for i, s in enumerate(dict.fromkeys(sets))}
    names = sorted({n for s in code for n in s})
    return np.array([[float(n in s) for n in names] for s in code]).reshape(len(code), len(names))[[code[s] for s in sets]], len(names)


def fit_table(table: pa.Table, regressors: tuple = (), interval_width: float = 0.80,
              seasonalities: tuple = SEASONALITIES, missing_future: str = "null") -> pa.Table:
    """Fit on the historical rows (is_historical = 1, no NULLs), predict
    those rows and the panel's future rows.

    ``missing_future``: a future row without a regressor's value has no
    forecast (``"null"``) or takes the historical mean (``"mean"``).
    """
    if missing_future not in ("null", "mean"):
        raise ValueError(f"missing_future is 'null' or 'mean', not {missing_future!r}")
    past = _floats(table.column("is_historical"))
    known = np.isfinite(_floats(table.column("y")))
    for r in regressors:
        known &= np.isfinite(_floats(table.column(r)))
    at = table.column("ds").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
    order = np.argsort(at, kind="stable")
    hist, fut = order[(past[order] == 1) & known[order]], order[past[order] == 0]
    rows, nh = table.take(pa.array(np.r_[hist, fut])), len(hist)
    n = rows.num_rows
    out = dict.fromkeys(OUTPUT_COLUMNS[3:], np.full(n, np.nan))
    y = _floats(rows.column("y"))
    out["y"] = np.r_[y[:nh], np.full(n - nh, np.nan)]
    if nh >= 2:
        out |= _predict(rows, y[:nh], at[np.r_[hist, fut]] / 86_400e6, regressors, interval_width, seasonalities, missing_future)
    columns = [rows.column("station_id").cast(pa.int32()), rows.column("ds").cast(pa.timestamp("us"))]
    columns += [pa.array(out[c], mask=np.isnan(out[c])) for c in OUTPUT_COLUMNS[2:]]
    return pa.table(columns, names=OUTPUT_COLUMNS)


def _predict(rows: pa.Table, y: np.ndarray, days: np.ndarray, regressors: tuple, interval_width: float,
             seasonalities: tuple, missing_future: str) -> dict[str, np.ndarray]:
    n, nh = rows.num_rows, len(y)
    t = (days - days[0]) / max(days[nh - 1] - days[0], 1e-9)
    cp_idx = np.unique(np.linspace(0, int(CHANGEPOINT_RANGE * (nh - 1)), N_CHANGEPOINTS + 1).round().astype(int)[1:])
    trend_x = np.column_stack([np.ones_like(t), t, np.maximum(0.0, t[:, None] - t[cp_idx][None, :])])
    blocks = [(name, _fourier(days, period, order), SEASONALITY_PRIOR) for name, period, order in seasonalities]
    blocks.append(("holidays", _holiday_columns(rows)[0], HOLIDAY_PRIOR))
    add_x = np.column_stack([x for _, x, _ in blocks])
    owner = np.repeat([name for name, _, _ in blocks], [x.shape[1] for _, x, _ in blocks])
    add_pen = np.repeat([1 / prior ** 2 for _, _, prior in blocks], [x.shape[1] for _, x, _ in blocks])

    reg_x, unknown = np.zeros((n, 0)), np.zeros(n, bool)
    if regressors:
        r = np.column_stack([_floats(rows.column(c)) for c in regressors])
        deviation = r[:nh].std(axis=0)
        reg_x = np.nan_to_num((r - r[:nh].mean(axis=0)) / np.where(deviation == 0, 1.0, deviation))   # missing future values count as the mean
        unknown = np.isnan(r).any(axis=1) & (missing_future == "null")

    scale = max(float(np.abs(y).max()), 1.0)
    fit = Fit(trend_x, add_x, add_pen, reg_x, y / scale)
    k = trend_x.shape[1]
    trend, mult = trend_x @ fit.beta_t, reg_x @ fit.beta_r
    value = {"trend": trend * scale, "multiplicative_terms": mult}
    var = {"trend": spread(trend_x, fit.cov[:k, :k]), "multiplicative_terms": spread(reg_x, fit.cov_r)}
    for name in ("daily", "weekly", "yearly", "holidays"):
        own = np.flatnonzero(owner == name)
        value[name] = add_x[:, own] @ fit.beta_a[own] * scale
        var[name] = spread(add_x[:, own], fit.cov[np.ix_(k + own, k + own)])
    value["additive_terms"] = add_x @ fit.beta_a * scale
    var["additive_terms"] = spread(add_x, fit.cov[k:, k:])
    yhat = value["trend"] * (1.0 + mult) + value["additive_terms"]

    z = NormalDist().inv_cdf(0.5 + interval_width / 2.0)
    unit = {c: 1.0 if c == "multiplicative_terms" else scale for c in COMPONENTS}
    low = {c: -z * np.sqrt(var[c]) * unit[c] for c in COMPONENTS}
    high = {c: -low[c] for c in COMPONENTS}
    total = (spread(np.column_stack([trend_x * (1.0 + mult)[:, None], add_x]), fit.cov) + trend ** 2 * var["multiplicative_terms"] + fit.sigma2)
    low["yhat"], high["yhat"] = -z * np.sqrt(total) * scale, z * np.sqrt(total) * scale

    # After the history: percentiles of simulated courses around the mode.
    rng = np.random.default_rng([SEED, zlib.crc32(str(rows.column("station_id")[0].as_py()).encode())])
    tails = [(1 - interval_width) / 2, (1 + interval_width) / 2]
    size = float(np.abs(fit.change).mean()) + 1e-8 if len(fit.change) else 1e-8
    for start, course in future_changes(np.maximum(t[nh:] - 1.0, 0.0), float(len(cp_idx)), size, rng):
        steps = nh + start + np.arange(course.shape[1])
        noise = rng.standard_normal(course.shape)
        for name, drawn in (("trend", course + noise * np.sqrt(var["trend"][steps])),
                            ("yhat", course * (1.0 + mult[steps]) + noise * np.sqrt(total[steps]))):
            low[name][steps], high[name][steps] = np.quantile(drawn, tails, axis=0) * scale

    out = {"yhat": yhat, "yhat_lower": yhat + np.minimum(low["yhat"], 0.0), "yhat_upper": yhat + np.maximum(high["yhat"], 0.0)}
    for c in COMPONENTS:
        out |= {c: value[c], f"{c}_lower": value[c] + np.minimum(low[c], 0.0), f"{c}_upper": value[c] + np.maximum(high[c], 0.0)}
    return {c: np.where(unknown, np.nan, v) for c, v in out.items()}


def fit_predict(pdf: pd.DataFrame, **options) -> pd.DataFrame:
    """``fit_table`` of one station's rows held in pandas."""
    return fit_table(pa.Table.from_pandas(pdf, preserve_index=False), **options).to_pandas()
