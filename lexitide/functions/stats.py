"""Small numeric helpers for fits on a few points: least squares, p-values, local regression."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            c = 1 + n / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, dof: float) -> float:
    """Two-sided."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 and math.isfinite(t) else float("nan")


def ols(y: np.ndarray, x: np.ndarray) -> dict:
    """Coefficients, errors, t, p and R2; minimum norm if the columns depend on each other."""
    coef, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ coef
    dof = len(y) - x.shape[1]
    sse, sst = float(rest @ rest), float(((y - y.mean()) ** 2).sum())
    cov = np.linalg.pinv(x.T @ x) * (sse / dof if dof > 0 else np.nan)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
    return {"coef": coef, "se": se, "t": t, "p": np.array([t_p(v, dof) for v in t]), "r2": 1 - sse / sst if sst > 0 else 0.0, "cov": cov, "n": len(y), "rank": int(rank)}


def dummies(values) -> np.ndarray:
    """One column for each value but the first in order."""
    names = sorted(set(values))[1:]
    return np.array([[float(v == n) for n in names] for v in values]).reshape(len(values), len(names))


def quadratic(x: np.ndarray, y: np.ndarray, least: int = 10) -> dict | None:
    if len(x) < least:
        return None
    c = x - x.mean()
    fit = ols(y, np.column_stack([np.ones_like(c), c, c * c]))
    a, b = fit["coef"][2], fit["coef"][1]
    return fit | {"vertex": x.mean() - b / (2 * a) if a else float("nan")}


def piecewise(x: np.ndarray, y: np.ndarray, grid: np.ndarray, extra: np.ndarray | None = None, least: int = 20, side: int = 10) -> dict | None:
    """Two lines that meet at the grid's breakpoint with the best R2 (the first of equals)."""
    if len(x) < least:
        return None
    best, extra = None, extra if extra is not None else np.zeros((len(x), 0))
    for knee in grid:
        if min((x <= knee).sum(), (x > knee).sum()) < side:
            continue
        fit = ols(y, np.column_stack([np.ones_like(x), x - knee, np.maximum(x - knee, 0), extra]))
        if best is None or fit["r2"] > best["r2"]:
            best = fit | {"breakpoint": float(knee), "rise": float(fit["coef"][1]), "fall": float(fit["coef"][1] + fit["coef"][2])}
    return best


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """Local linear fits with tricube weights and robust rounds, at each x (ascending)."""
    n = len(x)
    k = max(2, min(n, int(frac * n + 1e-10)))
    fitted, robust = np.zeros(n), np.ones(n)
    for _ in range(rounds + 1):
        left = 0
        for i in range(n):
            while left + k < n and x[left + k] - x[i] < x[i] - x[left]:
                left += 1
            own = slice(left, left + k)
            reach = max(x[i] - x[left], x[left + k - 1] - x[i])
            d = np.abs(x[own] - x[i]) / reach if reach > 0 else np.zeros(k)
            w = np.where(d < 0.999, (1 - np.minimum(d, 1) ** 3) ** 3, 0) * robust[own]
            if w.sum() <= 0:
                fitted[i] = y[i]
                continue
            w = w / w.sum()
            mean = (w * x[own]).sum()
            spread = (w * (x[own] - mean) ** 2).sum()
            slope = (w * (x[own] - mean) * y[own]).sum() / spread if spread > (0.001 * (x[-1] - x[0])) ** 2 else 0.0
            fitted[i] = (w * y[own]).sum() + slope * (x[i] - mean)
        rest = np.abs(y - fitted)
        scale = 6 * np.median(rest)
        if scale <= 0:
            break
        robust = np.where(rest < scale, (1 - np.minimum(rest / scale, 1) ** 2) ** 2, 0)
    return fitted


def local_band(x: np.ndarray, y: np.ndarray, fitted: np.ndarray, window: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fitted -+ the deviation of the residuals in a moving window over the root of its size."""
    rest = y - fitted
    half = window // 2
    se = np.array([rest[max(0, i - half) : i + half + 1].std() / math.sqrt(len(rest[max(0, i - half) : i + half + 1])) for i in range(len(x))])
    return fitted - se, fitted + se


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2x2 table."""
    row, col, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(k + 1)
    chance = lambda k: math.exp(log(row) - log(k) - log(row - k) + log(n - row) - log(col - k) - log(n - row - col + k) - log(n) + log(col) + log(n - col))
    own = chance(a)
    return min(1.0, sum(p for k in range(max(0, row + col - n), min(row, col) + 1) if (p := chance(k)) <= own * (1 + 1e-7)))


def gini(values: np.ndarray) -> float:
    v = np.sort(np.asarray(values, dtype=float))
    return float((2 * np.arange(1, len(v) + 1) - len(v) - 1) @ v / (len(v) * v.sum())) if len(v) and v.sum() else 0.0
