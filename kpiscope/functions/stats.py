"""Numerical kernels for small collected aggregates: distribution tails, least squares,
covariances.  Plain numpy; no table of raw rows ever comes here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def t_sf2(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    if not math.isfinite(t):
        return 0.0 if not math.isnan(t) else math.nan
    return betainc(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else math.nan


def t_quantile(p: float, dof: float) -> float:
    """The t whose two-sided tail is 2 (1 - p), for p over one half; by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf2(mid, dof) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-square: the regularised upper incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


@dataclass
class Fit:
    beta: np.ndarray
    residual: np.ndarray
    bread: np.ndarray
    rank: int
    x: np.ndarray

    @property
    def dof(self) -> int:
        return len(self.residual) - self.rank

    def r2(self, y: np.ndarray) -> float:
        total = float(((y - y.mean()) ** 2).sum())
        return 1 - float((self.residual**2).sum()) / total if total else math.nan


def ols(x: np.ndarray, y: np.ndarray) -> Fit:
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return Fit(beta, y - x @ beta, np.linalg.pinv(x.T @ x), int(rank), x)


def covariance(fit: Fit, kind: str = "classic", clusters: np.ndarray | None = None, lags: int | None = None) -> np.ndarray:
    """classic, hc1, cluster, or hac (Bartlett weights) covariance of the coefficients."""
    n, k = len(fit.residual), fit.rank
    scores = fit.x * fit.residual[:, None]
    if kind == "classic":
        return fit.bread * float((fit.residual**2).sum()) / max(1, n - k)
    if kind == "hc1":
        return fit.bread @ (scores.T @ scores) @ fit.bread * n / max(1, n - k)
    if kind == "cluster":
        names, at = np.unique(clusters, return_inverse=True)
        sums = np.zeros((len(names), fit.x.shape[1]))
        np.add.at(sums, at, scores)
        g = len(names)
        return fit.bread @ (sums.T @ sums) @ fit.bread * g / max(1, g - 1) * (n - 1) / max(1, n - k)
    if kind == "hac":
        most = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
        meat = scores.T @ scores
        for j in range(1, most + 1):
            part = scores[j:].T @ scores[:-j]
            meat += (1 - j / (most + 1)) * (part + part.T)
        return fit.bread @ meat @ fit.bread * n / max(1, n - k)
    raise ValueError(f"unknown covariance {kind!r}")


def inference(b: float, var: float, dof: float, level: float = 0.95) -> dict[str, float]:
    se = math.sqrt(max(var, 0.0))
    t = b / se if se else math.nan
    half = t_quantile(1 - (1 - level) / 2, dof) * se if dof > 0 else math.nan
    return {"estimate": b, "se": se, "t": t, "p": t_sf2(t, dof), "low": b - half, "high": b + half}


def durbin_watson(u: np.ndarray) -> float:
    return float((np.diff(u) ** 2).sum() / (u**2).sum())


def ljung_box(u: np.ndarray, lags: int = 10) -> tuple[float, float]:
    n, c = len(u), u - u.mean()
    total = float((c**2).sum())
    q = n * (n + 2) * sum((float((c[k:] * c[:-k]).sum()) / total) ** 2 / (n - k) for k in range(1, min(lags, n - 1) + 1))
    return q, chi2_sf(q, min(lags, n - 1))


def orthonormal(x: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """An orthonormal basis of the columns; directions below the relative tolerance go."""
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > tol * (s[0] if len(s) else 1)]


def absorb(basis: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What of v (a column or several) the basis does not span."""
    return v - basis @ (basis.T @ v)
