"""Time series: numpy kernels on one series, and their grouped application.

A frame of series is long: (series id, time order, value). Every model works
on one series in order, so it runs as one task per series; series are
spread over the cluster. Decomposition and autocorrelation are also given as
window expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..operators.frame import over_rows


def check(y: Sequence[float], least: int = 1) -> np.ndarray:
    y = np.asarray(y, float)
    if len(y) < least or not np.isfinite(y).all():
        raise InvalidParameter(f"at least {least} finite values are needed")
    return y


# ---- decomposition and autocorrelation --------------------------------------------


def decompose(y: Sequence[float], period: int, kind: str = "additive") -> dict[str, np.ndarray]:
    """Classical decomposition: centred moving average, normalised means of
    the phases, NaN at the edges."""
    y = check(y, 2 * period)
    half, n = period // 2, len(y)
    kernel = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(y, kernel, "valid")
    rest = y - trend if kind == "additive" else y / trend
    means = np.array([np.nanmean(rest[p::period]) for p in range(period)])
    means = means - means.mean() if kind == "additive" else means / means.mean()
    seasonal = means[np.arange(n) % period]
    return {"trend": trend, "seasonal": seasonal, "residual": rest - seasonal if kind == "additive" else rest / seasonal}


def decompose_frame(df: DataFrame, value: str, order_by: str, period: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """Additive decomposition. Without ``partition_by`` the one series' moving
    averages run over chunks of numbered rows, and the means of the phases, one
    number each, are an aggregation."""
    half = period // 2

    def centred(over: WindowSpec) -> Column:
        if period % 2:
            return F.avg(value).over(over.rowsBetween(-half, half))
        return (F.avg(value).over(over.rowsBetween(-half, half - 1)) + F.avg(value).over(over.rowsBetween(1 - half, half))) / 2

    if not partition_by:
        n = df.count()
        rows = over_rows(df, order_by, (), lambda over, number: {"t": (number - 1).cast("int"), "_inner": centred(over)}, half, half)
        rows = rows.withColumn("trend", F.when((F.col("t") >= half) & (F.col("t") < n - half), F.col("_inner"))).drop("_inner")
        found = rows.groupBy((F.col("t") % period).alias("p")).agg(F.avg(F.col(value) - F.col("trend")).alias("m")).collect()
        means = {r["p"]: r["m"] for r in found if r["m"] is not None}
        level = sum(means.values()) / len(means) if means else 0.0
        seasons = F.array(*[F.lit(means[p] - level if p in means else None).cast("double") for p in range(period)])
        rows = rows.withColumn("seasonal", F.get(seasons, (F.col("t") % period).cast("int")))
        return rows.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
    over = W.partitionBy(*partition_by).orderBy(order_by)
    rows = df.withColumns({"t": F.row_number().over(over) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*partition_by))})
    rows = rows.withColumn("trend", F.when((F.col("t") >= half) & (F.col("t") < F.col("_n") - half), centred(over)))
    phase = W.partitionBy(*partition_by, "_p")
    rows = rows.withColumn("_p", F.col("t") % period).withColumn("_m", F.avg(F.col(value) - F.col("trend")).over(phase)).withColumn("_first", F.row_number().over(phase.orderBy("t")))
    rows = rows.withColumn("seasonal", F.col("_m") - F.avg(F.when(F.col("_first") == 1, F.col("_m"))).over(W.partitionBy(*partition_by)))
    return rows.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_n", "_p", "_m", "_first")


def acf(y: Sequence[float], lags: int) -> np.ndarray:
    y = check(y, 2)
    d = y - y.mean()
    return np.array([(d[: len(d) - k] * d[k:]).sum() for k in range(lags + 1)]) / ((d * d).sum() or 1)


def acf_frame(df: DataFrame, value: str, order_by: str, lags: int) -> DataFrame:
    """(lag, acf) of one series: one pass with lagged columns."""
    mean = df.agg(F.avg(value)).first()[0]
    rows = df.select(order_by, (F.col(value) - F.lit(mean)).alias("d"))
    rows = over_rows(rows, order_by, (), lambda over, _: {f"l{k}": F.lag("d", k).over(over) for k in range(1, lags + 1)}, lags).withColumn("l0", F.col("d"))
    sums = rows.agg(*[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(lags + 1)])
    return sums.select(F.posexplode(F.array(*[F.col(f"s{k}") / F.col("s0") for k in range(lags + 1)])).alias("lag", "acf"))


def pacf(y: Sequence[float], lags: int) -> np.ndarray:
    r = acf(y, lags)
    out = [1.0]
    for k in range(1, lags + 1):
        table = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        out.append(float(np.linalg.lstsq(table, r[1 : k + 1], rcond=None)[0][-1]))
    return np.array(out)


def adf_test(y: Sequence[float], lags: int = 1) -> dict[str, float]:
    """Augmented Dickey-Fuller with a constant; p by interpolating
    MacKinnon's asymptotic quantiles."""
    y = check(y, lags + 6)
    d = np.diff(y)
    x = np.column_stack([y[lags:-1], np.ones(len(d) - lags), *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    target = d[lags:]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    e = target - x @ beta
    se = np.sqrt((e @ e) / (len(target) - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0])
    t = float(beta[0] / se)
    return {"statistic": t, "p_value": float(np.interp(t, [-5.0, -3.43, -2.86, -2.57, -1.94, -1.57, -0.44, 0.6], [1e-4, 0.01, 0.05, 0.1, 0.3, 0.5, 0.9, 0.99]))}


def fft_decompose(y: Sequence[float], top: int = 3) -> dict[str, np.ndarray]:
    y = check(y, 4)
    mean = y.mean()
    spectrum = np.fft.rfft(y - mean)
    power = np.abs(spectrum)
    keep = 1 + np.argsort(-power[1:], kind="stable")[:top]
    mask = np.zeros_like(spectrum)
    mask[keep] = spectrum[keep]
    seasonal = np.fft.irfft(mask, len(y))
    return {"frequencies": keep / len(y), "amplitudes": 2 * power[keep] / len(y), "seasonal": seasonal, "residual": y - mean - seasonal}


def moving_average(y: Sequence[float], period: int) -> np.ndarray:
    return np.convolve(check(y, period), np.ones(period) / period, "valid")


# ---- exponential smoothing ----------------------------------------------------------


def _holt_winters(y: np.ndarray, a: float, b: float, g: float, period: int, phi: float = 1.0, trend: bool = True, season: str = "additive") -> tuple[np.ndarray, float, float, np.ndarray]:
    """One-step fitted values and the last state; period 0 has no season."""
    level, slope = float(y[:period].mean()) if period else float(y[0]), 0.0
    if trend:
        slope = float((y[period : 2 * period].mean() - level) / period) if period else float(y[1] - y[0])
    mult = season == "multiplicative"
    s = (y[:period] / level if mult else y[:period] - level) if period else np.zeros(1)
    s, fitted = s.copy(), np.empty(len(y))
    for t, v in enumerate(y):
        k = t % period if period else 0
        base = level + phi * slope
        fitted[t] = base * s[k] if period and mult else base + s[k]
        new = a * ((v / s[k] if mult else v - s[k]) if period else v) + (1 - a) * base
        slope = b * (new - level) + (1 - b) * phi * slope if trend else 0.0
        if period:
            s[k] = g * (v / new if mult else v - new) + (1 - g) * s[k]
        level = new
    return fitted, level, slope, s


def exponential_smoothing(y: Sequence[float], horizon: int, kind: str = "simple", period: int = 0, alpha: float | None = None, beta: float = 0.1, gamma: float = 0.1, season: str = "additive") -> dict[str, object]:
    """simple, double or holtWinters; alpha from a grid by squared error."""
    y = check(y, 2 * period if kind == "holtWinters" else 2)
    p, trend = period if kind == "holtWinters" else 0, kind != "simple"
    grid = [alpha] if alpha is not None else [k / 10 for k in range(1, 10)]
    best = min((float(((y - _holt_winters(y, a, beta, gamma, p, 1.0, trend, season)[0])[1:] ** 2).mean()), a) for a in grid)
    fitted, level, slope, s = _holt_winters(y, best[1], beta, gamma, p, 1.0, trend, season)
    h = np.arange(1, horizon + 1)
    out = level + h * slope
    if p:
        cycle = s[(len(y) + h - 1) % p]
        out = out * cycle if season == "multiplicative" else out + cycle
    return {"alpha": best[1], "mse": best[0], "fitted": fitted, "forecast": out}


def ets(y: Sequence[float], horizon: int, error: str = "A", trend: str = "N", season: str = "N", period: int = 0, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, phi: float = 0.98) -> dict[str, object]:
    """State space form (error A/M, trend N/A/Ad, season N/A/M) with given
    weights; the error type only decides how residuals are scaled."""
    p = period if season != "N" else 0
    y = check(y, max(2, 2 * p))
    damp = phi if trend == "Ad" else 1.0
    fitted, level, slope, s = _holt_winters(y, alpha, beta, gamma, p, damp, trend != "N", "multiplicative" if season == "M" else "additive")
    steps = np.cumsum(damp ** np.arange(1, horizon + 1))
    out = level + steps * slope
    if p:
        cycle = s[(len(y) + np.arange(horizon)) % p]
        out = out * cycle if season == "M" else out + cycle
    e = (y - fitted) / (np.where(np.abs(fitted) > 1e-12, fitted, 1) if error == "M" else 1)
    params = 1 + (trend != "N") + bool(p) + (trend == "Ad")
    return {"fitted": fitted, "forecast": out, "aic": len(y) * float(np.log(max((e[1:] ** 2).mean(), 1e-300))) + 2 * params}


def ets_auto(y: Sequence[float], horizon: int, period: int = 0) -> dict[str, object]:
    """The form of the smallest AIC over the whole series."""
    seasons = ("N", "A", *(("M",) if min(y) > 0 else ())) if period else ("N",)
    found = [(ets(y, horizon, "A", t, s, period), f"A{t}{s}") for t, s in product(("N", "A", "Ad"), seasons)]
    best = min(found, key=lambda f: f[0]["aic"])
    return best[0] | {"form": best[1]}


# ---- ARIMA, GARCH ---------------------------------------------------------------------


def _lags(y: np.ndarray, e: np.ndarray, ar: Sequence[int], ma: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    start = max([0, *ar, *ma])
    t = np.arange(start, len(y))
    return np.column_stack([np.ones(len(t)), *[y[t - k] for k in ar], *[e[t - k] for k in ma]]), t


def sarima(y: Sequence[float], horizon: int, order: tuple[int, int, int] = (1, 1, 1), seasonal: tuple[int, int, int, int] = (0, 0, 0, 0), exog: np.ndarray | None = None, exog_future: np.ndarray | None = None) -> dict[str, object]:
    """Two-stage least squares (Hannan and Rissanen): residuals of a long
    autoregression stand in for the innovations. Exogenous columns are taken
    out by a regression first."""
    p, d, q = order
    sp, sd, sq, s = seasonal
    raw = check(y, p + q + d + (sp + sq + sd) * s + 8)
    offset = np.zeros(horizon)
    if exog is not None:
        x = np.column_stack([np.ones(len(raw)), exog])
        coef = np.linalg.lstsq(x, raw, rcond=None)[0]
        raw = raw - x[:, 1:] @ coef[1:]
        if exog_future is not None:
            offset = np.asarray(exog_future) @ coef[1:]
    z, history = raw, []
    for step in [s] * sd + [1] * d:
        history.append((z, step))
        z = z[step:] - z[:-step]
    ar, ma = [*range(1, p + 1), *[s * k for k in range(1, sp + 1)]], [*range(1, q + 1), *[s * k for k in range(1, sq + 1)]]
    e = np.zeros(len(z))
    if ma:
        long = min(max(2 * max(ar + ma), 4), len(z) // 3)
        x, t = _lags(z, e, list(range(1, long + 1)), [])
        e[t] = z[t] - x @ np.linalg.lstsq(x, z[t], rcond=None)[0]
    x, t = _lags(z, e, ar, ma)
    beta = np.linalg.lstsq(x, z[t], rcond=None)[0]
    resid = z[t] - x @ beta
    path, shocks = list(z), list(e)
    for _ in range(horizon):
        path.append(float(beta @ np.r_[1.0, [path[-k] for k in ar], [shocks[-k] for k in ma]]))
        shocks.append(0.0)
    out = np.array(path[len(z) :])
    for before, step in reversed(history):
        back = list(before)
        for v in out:
            back.append(v + back[-step])
        out = np.array(back[len(before) :])
    sigma2 = float((resid @ resid) / len(resid))
    k = len(beta) + (0 if exog is None else np.asarray(exog).reshape(len(raw), -1).shape[1])
    return {"coefficients": beta, "sigma2": sigma2, "aic": len(resid) * float(np.log(max(sigma2, 1e-300))) + 2 * k, "forecast": out + offset}


def arima(y: Sequence[float], horizon: int, order: tuple[int, int, int] = (1, 1, 1), **more) -> dict[str, object]:
    return sarima(y, horizon, order, **more)


def garch(y: Sequence[float], horizon: int, p: int = 1, q: int = 1) -> dict[str, object]:
    """Gaussian likelihood by coordinate search; alpha + beta < 0.999. Returns
    variances."""
    e = check(y, 10) - np.mean(y)
    var = float(e.var()) or 1e-12

    def path(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        omega, h, m = var * (1 - a.sum() - b.sum()), np.full(len(e), var), max(p, q)
        for t in range(m, len(e)):
            h[t] = omega + a @ e[t - 1 : t - p - 1 if t > p else None : -1][:p] ** 2 + b @ h[t - 1 : t - q - 1 if t > q else None : -1][:q]
        return h

    def loss(x: np.ndarray) -> float:
        a, b = x[:p], x[p:]
        if (x < 0).any() or x.sum() >= 0.999:
            return np.inf
        h = path(a, b)
        return float((np.log(h) + e * e / h).sum())

    x = np.r_[np.full(p, 0.1 / p), np.full(q, 0.8 / max(q, 1))]
    best, step = loss(x), 0.1
    while step > 1e-4:
        moved = False
        for k, sign in product(range(len(x)), (1, -1)):
            y_ = x.copy()
            y_[k] += sign * step
            if (v := loss(y_)) < best - 1e-12:
                x, best, moved = y_, v, True
        step = step if moved else step / 2
    a, b = x[:p], x[p:]
    h, shock, out = list(path(a, b)), list(e * e), []
    for _ in range(horizon):
        nxt = var * (1 - x.sum()) + sum(a[k] * shock[-1 - k] for k in range(p)) + sum(b[k] * h[-1 - k] for k in range(q))
        out.append(nxt)
        h.append(nxt)
        shock.append(nxt)
    return {"alpha": a, "beta": b, "variance": np.array(h[: len(e)]), "forecast": np.array(out)}


# ---- state space, operators, trends -----------------------------------------------------


def kalman(y: np.ndarray, f: np.ndarray, h: np.ndarray, q: np.ndarray, r: np.ndarray, x0: np.ndarray, p0: np.ndarray, smooth: bool = False, horizon: int = 0) -> dict[str, np.ndarray]:
    """Linear filter with Joseph's update; Rauch-Tung-Striebel smoother."""
    x, p, eye = np.asarray(x0, float), np.asarray(p0, float), np.eye(len(x0))
    xs, ps, xp, pp = [], [], [], []
    for obs in np.asarray(y, float).reshape(len(y), -1):
        x, p = f @ x, f @ p @ f.T + q
        xp.append(x)
        pp.append(p)
        if np.isfinite(obs).all():
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            x = x + k @ (obs - h @ x)
            p = (eye - k @ h) @ p @ (eye - k @ h).T + k @ r @ k.T
        xs.append(x)
        ps.append(p)
    out = {"states": np.array(xs), "covariances": np.array(ps)}
    if smooth:
        sx, sp = list(xs), list(ps)
        for t in range(len(xs) - 2, -1, -1):
            c = ps[t] @ f.T @ np.linalg.inv(pp[t + 1])
            sx[t] = xs[t] + c @ (sx[t + 1] - xp[t + 1])
            sp[t] = ps[t] + c @ (sp[t + 1] - pp[t + 1]) @ c.T
        out |= {"smoothed": np.array(sx), "smoothed_covariances": np.array(sp)}
    ahead = []
    for _ in range(horizon):
        x = f @ x
        ahead.append(h @ x)
    return out | {"forecast": np.array(ahead)}


def kalman_1d(y: Sequence[float], process: float = 1e-3, noise: float = 1e-1, horizon: int = 0, smooth: bool = False) -> dict[str, np.ndarray]:
    one = np.eye(1)
    return kalman(np.asarray(y, float), one, one, one * process, one * noise, np.array([float(y[0])]), one, smooth, horizon)


def koopman(y: Sequence[float], horizon: int, delays: int = 4, dictionary: str = "identity", degree: int = 2, ridge: float = 1e-5, seed: int = 0) -> dict[str, np.ndarray]:
    """Extended dynamic mode decomposition of delay vectors with an identity,
    polynomial, rbf, fourier or combined dictionary."""
    y = check(y, delays + 3)
    z = np.stack([y[k : len(y) - delays + k + 1] for k in range(delays)], 1)
    centers = z[np.random.default_rng(seed).permutation(len(z))[:8]]
    width = float(np.median(((z[:, None] - centers) ** 2).sum(2))) or 1.0
    span = float(np.ptp(y)) or 1.0

    def lift(v: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(v), 1)), v]
        if dictionary in ("polynomial", "combined"):
            parts += [v**k for k in range(2, degree + 1)]
        if dictionary in ("rbf", "combined"):
            parts.append(np.exp(-((v[:, None] - centers) ** 2).sum(2) / width))
        if dictionary in ("fourier", "combined"):
            parts += [np.sin(2 * np.pi * v / span), np.cos(2 * np.pi * v / span)]
        return np.concatenate(parts, 1)

    a, b = lift(z[:-1]), lift(z[1:])
    k = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)
    state, out = z[-1:], []
    for _ in range(horizon):
        nxt = (lift(state) @ k)[:, 1 : delays + 1]
        out.append(float(nxt[0, -1]))
        state = np.concatenate([state[:, 1:], nxt[:, -1:]], 1)
    return {"forecast": np.array(out), "eigenvalues": np.linalg.eigvals(k), "operator": k}


def piecewise_trend(y: Sequence[float], horizon: int = 0, changepoints: int = 3, kind: str = "linear", capacity: float | None = None) -> dict[str, np.ndarray]:
    """Continuous piecewise line (of the logits for logistic) by least squares
    with hinges at evenly spaced points."""
    y = check(y, changepoints + 3)
    top = capacity or float(y.max()) * 1.1 + 1e-9
    z = np.log(np.clip(y, 1e-9, top - 1e-9) / (top - np.clip(y, 1e-9, top - 1e-9))) if kind == "logistic" else y
    t, at = np.arange(len(y) + horizon, dtype=float), np.linspace(0, len(y) - 1, changepoints + 2)[1:-1]
    x = np.column_stack([np.ones(len(t)), t, *[np.maximum(t - c, 0) for c in at]])
    beta = np.linalg.lstsq(x[: len(y)], z, rcond=None)[0]
    line = x @ beta
    line = top / (1 + np.exp(-line)) if kind == "logistic" else line
    return {"trend": line[: len(y)], "forecast": line[len(y) :], "changepoints": at, "slopes": np.cumsum(beta[1:])}


# ---- grouped application --------------------------------------------------------------


def forecast_frame(df: DataFrame, keys: Sequence[str], order_by: str, value: str, model: Callable[[np.ndarray, int], dict], horizon: int) -> DataFrame:
    """(keys, step, forecast) of each series; a series whose fit isn't possible
    gives no rows."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order_by)[value].to_numpy(float)
        try:
            out = np.asarray(model(y, horizon)["forecast"], float)
        except InvalidParameter:
            out = np.empty(0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(out) for k in keys}, "step": np.arange(1, len(out) + 1), "forecast": out})

    return df.select(*keys, order_by, value).groupBy(*keys).applyInPandas(run, f"{kinds}, step int, forecast double")
