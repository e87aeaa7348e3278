"""Peak fits on histograms. Rows are first counted into bins by Spark; a fit sees bins only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def least_squares(model: Callable, x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, ok: Callable, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Damped least squares with a numeric Jacobian; steps must satisfy `ok`. Parameters and chi2."""
    p = np.array(start, float)
    cost, damp = float((w * (y - model(x, p)) ** 2).sum()), 1e-3
    for _ in range(rounds):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        f = model(x, p)
        j = np.stack([(model(x, p + np.eye(len(p))[k] * h[k]) - f) / h[k] for k in range(len(p))], 1)
        a = j.T @ (w[:, None] * j)
        q = p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ (w * (y - f)), rcond=None)[0]
        c = float((w * (y - model(x, q)) ** 2).sum()) if ok(q) else np.inf
        if c < cost:
            small = cost - c < 1e-10 * cost
            p, cost, damp = q, c, damp / 5
            if small:
                break
        else:
            damp *= 5
    return p, cost


def gaussian(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2)


def crystal_ball(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Gaussian (amplitude, mean, sigma) whose left side turns into a power law at `alpha` sigma, power n."""
    amplitude, mean, sigma, alpha, n = p
    t = (x - mean) / sigma
    with np.errstate(all="ignore"):
        tail = np.exp(-0.5 * alpha**2) * np.maximum(1 - alpha / n * (alpha + t), 1e-9) ** -n
    return amplitude * np.where(t > -alpha, np.exp(-0.5 * t * t), tail)


def moments(centre: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    mean = float((centre * n).sum() / n.sum())
    return mean, float(np.sqrt(max((n * (centre - mean) ** 2).sum() / n.sum(), 1e-12)))


def gaussian_fit(centre: np.ndarray, n: np.ndarray, width: float = 2.0) -> tuple[float, float, float, float]:
    """amplitude, mean, sigma, chi2 per degree of freedom inside `width` rms of the fullest bin, with
    Poisson weights; the moments where fewer than four bins are there."""
    mean, rms = moments(centre, n)
    top = int(n.argmax())
    near = np.abs(centre - centre[top]) <= width * rms
    x, y = centre[near], n[near].astype(float)
    if len(x) < 4:
        return float(y.max()), mean, rms, float("nan")
    p, cost = least_squares(gaussian, x, y, 1 / np.maximum(y, 1.0), [y.max(), centre[top], max(rms, 1e-6)], lambda q: q[0] > 0 and q[2] > 0)
    return float(p[0]), float(p[1]), float(p[2]), cost / max(len(x) - 3, 1)


def crystal_ball_fit(centre: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """As gaussian_fit, with a power-law tail to the left, on the right-most peak of a spectrum: from the
    last bin that holds half of the fullest one, 6 sigma to the left."""
    top = int(np.flatnonzero(n >= 0.5 * n.max())[-1])
    a, m, s, chi2 = gaussian_fit(centre[max(top - 8, 0) :], n[max(top - 8, 0) :])
    near = (centre > m - 6 * s) & (centre < m + 3 * s)
    x, y = centre[near], n[near].astype(float)
    if len(x) < 7:
        return a, m, s, chi2
    ok = lambda q: q[0] > 0 and q[2] > 0 and 0.3 < q[3] < 5 and 1.01 < q[4] < 50
    p, cost = least_squares(crystal_ball, x, y, 1 / np.maximum(y, 1.0), [a, m, s, 1.5, 5.0], ok)
    return float(p[0]), float(p[1]), float(p[2]), cost / (len(x) - 5)


def fit_peaks(hist: DataFrame, keys: list[str], low: float, step: float, fit: Callable = gaussian_fit) -> DataFrame:
    """hist(keys, bin, n_rows) -> keys, n, amplitude, mean, sigma, chi2_dof; under- and overflow are left out."""
    schema = StructType([*(hist.schema[k] for k in keys), StructField("n", LongType()), *(StructField(c, DoubleType()) for c in ("amplitude", "mean", "sigma", "chi2_dof"))])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["bin"] >= 0].sort_values("bin")
        if pdf["n_rows"].sum() == 0:
            return pd.DataFrame(columns=schema.names)
        n = np.zeros(int(pdf["bin"].max()) + 1)
        n[pdf["bin"].to_numpy()] = pdf["n_rows"].to_numpy()
        return pd.DataFrame([(*key, int(n.sum()), *fit(low + (np.arange(len(n)) + 0.5) * step, n))], columns=schema.names)

    return hist.groupBy(*keys).applyInPandas(run, schema)
