"""Special functions and small-array statistics in numpy."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_cdf(x):
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def digamma(x):
    x = np.array(x, float, copy=True, ndmin=1)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x):
    x = np.array(x, float, copy=True, ndmin=1)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] += 1 / x[low] ** 2
        x[low] += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def trigamma_inverse(y: float) -> float:
    """Newton on 1 / trigamma, which is nearly linear."""
    if y > 1e7:
        return 1 / math.sqrt(y)
    if y < 1e-6:
        return 1 / y
    x = 0.5 + 1 / y
    for _ in range(50):
        t = float(trigamma(x)[0])
        d = 1e-5 * x
        slope = float((trigamma(x + d)[0] - trigamma(x - d)[0]) / (2 * d))
        step = t * (1 - t / y) / slope
        x += step
        if -step / x < 1e-10:
            break
    return x


def betainc(a, b, x):
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def t_two_sided(t, df):
    """P(|T| >= |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    big = df > 1e9
    return np.where(big, 2 * normal_cdf(-np.abs(t)), betainc(np.where(big, 1.0, df) / 2, 0.5, np.where(big, 1.0, df) / (np.where(big, 1.0, df) + t * t)))


def f_upper(f, d1, d2):
    f = np.maximum(np.asarray(f, float), 0)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def bh(p, weights=None):
    """Benjamini-Hochberg q-values, weighted on demand; NaN stays NaN and takes no weight."""
    p = np.asarray(p, float)
    w = np.ones_like(p) if weights is None else np.asarray(weights, float)
    out, ok = np.full_like(p, np.nan), ~np.isnan(p)
    if ok.any():
        order = np.argsort(p[ok], kind="stable")
        pw, ww = p[ok][order], w[ok][order]
        adj = np.minimum(1, np.minimum.accumulate((ww.sum() * pw / np.cumsum(ww))[::-1])[::-1])
        back = np.empty_like(adj)
        back[order] = adj
        out[ok] = back
    return out


def density_weights(norm_sums):
    """1 / log10(sum + 1); an empty landmark counts 1."""
    with np.errstate(divide="ignore"):
        w = 1 / np.log10(np.asarray(norm_sums, float) + 1)
    return np.where(np.isinf(w), 1.0, w)


def storey(p):
    """q-values with pi0 from the share of large p, median over lambda; plain BH where it fails."""
    p = np.asarray(p, float)
    lam = np.arange(0.1, 0.81, 0.05)
    pi0 = float(np.clip(np.median([(p >= x).mean() / (1 - x) for x in lam]), 0, 1))
    return bh(p) if pi0 <= 0 else np.minimum(1, bh(p) * pi0)


def average_rank(x):
    x = np.asarray(x, float)
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2)[inverse]


def spearman(x, y):
    return float(np.corrcoef(average_rank(x), average_rank(y))[0, 1])


def smoothing_spline(y, df: float):
    """Penalised fit (second differences) on equal steps with the given effective degrees of freedom."""
    y = np.asarray(y, float)
    n = len(y)
    d = np.diff(np.eye(n), 2, axis=0)
    values, vectors = np.linalg.eigh(d.T @ d)
    values = np.maximum(values, 0)
    low, high = -20.0, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + math.exp(mid) * values)).sum() > df else (low, mid)
    return vectors @ ((vectors.T @ y) / (1 + math.exp(low) * values))


def elbow(x, smooth: bool = True, descending: bool | None = None) -> int:
    """Position (from 0, in x) of the largest second difference of the sorted, scaled values."""
    x = np.asarray(x, float)
    if len(x) < 4:
        raise ValueError("an elbow takes four values at least")
    if np.ptp(x) == 0:
        raise ValueError("flat values have no elbow")
    descending = x[0] > x[-1] if descending is None else descending
    order = np.argsort(-x if descending else x, kind="stable")
    y = x[order]
    if smooth and len(y) > 6:
        y = smoothing_spline(y, min(max(min(0.7 * len(y), 10), 2), len(y) - 1))
    y = (y - y.min()) / np.ptp(y)
    return int(order[int(np.argmax(np.diff(y, 2))) + 1])


def mcc(truth, said) -> float:
    """Matthews correlation of two labelings, of any number of classes; 0 where it is undefined."""
    truth, said = np.asarray(truth), np.asarray(said)
    k = sorted({*truth.tolist(), *said.tolist()})
    c = np.array([[((truth == a) & (said == b)).sum() for b in k] for a in k], float)
    n, hit, t, p = c.sum(), np.trace(c), c.sum(1), c.sum(0)
    low = math.sqrt(max(n * n - (p * p).sum(), 0) * max(n * n - (t * t).sum(), 0))
    return float((n * hit - (t * p).sum()) / low) if low else 0.0
