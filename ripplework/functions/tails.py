"""Discrete tail distributions on value histograms: exponents, likelihood ratios, draws."""

from __future__ import annotations

import math

import numpy as np

from ripplework.functions.numeric import hurwitz_zeta, normal_cdf


def tail_distance(
    xmin: np.ndarray, alpha: np.ndarray, n_tail: np.ndarray, value: np.ndarray, n_ge: np.ndarray
) -> np.ndarray:
    """Largest gap between fitted and observed ``P(X < v)`` over ``value >= xmin``, per candidate.

    ``n_ge`` is the number of observations at or above each value.
    """
    out = np.zeros(xmin.size)
    for lo in range(0, xmin.size, 256):
        cut = slice(lo, lo + 256)
        a, x0, n = alpha[cut, None], xmin[cut, None], n_tail[cut, None]
        above = value[None, :] >= x0
        v = np.where(above, value[None, :], x0)
        fitted = hurwitz_zeta(a, v, x0) / hurwitz_zeta(a, x0, x0)
        observed = n_ge[None, :] / n
        out[cut] = np.where(above, np.abs(fitted - observed), 0.0).max(axis=1)
    return out


def draw_tail(rng: np.random.Generator, size: int, xmin: float, alpha: float) -> np.ndarray:
    """Discrete power-law draws by rounding the continuous ones (Clauset, Shalizi and Newman 2009)."""
    u = rng.random(size)
    return np.floor((xmin - 0.5) * (1.0 - u) ** (-1.0 / (alpha - 1.0)) + 0.5)


def _truncated_log_norm(alpha: float, rate: float, xmin: float) -> float:
    """``log sum_{k>=xmin} (k / xmin)^-alpha exp(-rate (k - xmin))``."""
    direct = xmin + np.arange(64)
    total = float(np.sum((direct / xmin) ** -alpha * np.exp(-rate * (direct - xmin))))
    m = xmin + 64.0
    reach = min(math.log1p(60.0 / (rate * m)), 60.0 / max(alpha - 1.0, 1e-3))
    node, weight = _LEGENDRE
    u = 0.5 * reach * (node + 1.0)
    inside = np.exp(u * (1.0 - alpha) - rate * m * np.expm1(u))
    scale = math.exp(-rate * (m - xmin))
    at_m = (m / xmin) ** -alpha * scale
    total += m * at_m * 0.5 * reach * float(weight @ inside)
    return math.log(total + 0.5 * at_m + at_m * (alpha / m + rate) / 12.0)


_LEGENDRE = np.polynomial.legendre.leggauss(160)


def _simplex_minimum(f, start: np.ndarray, scale: np.ndarray, steps: int = 400) -> np.ndarray:
    """Downhill simplex for two parameters."""
    points = [start, start + scale * [1, 0], start + scale * [0, 1]]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[2] - values[0]) <= 1e-12 * (1.0 + abs(values[0])):
            break
        centre = 0.5 * (points[0] + points[1])
        far = centre + (centre - points[2])
        f_far = f(far)
        if f_far < values[0]:
            further = centre + 2.0 * (centre - points[2])
            f_further = f(further)
            points[2], values[2] = (further, f_further) if f_further < f_far else (far, f_far)
        elif f_far < values[1]:
            points[2], values[2] = far, f_far
        else:
            near = centre + 0.5 * (points[2] - centre)
            f_near = f(near)
            if f_near < values[2]:
                points[2], values[2] = near, f_near
            else:
                points = [points[0]] + [0.5 * (points[0] + p) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def _log_power(x, alpha, xmin):
    return -alpha * np.log(x / xmin) - math.log(float(hurwitz_zeta(alpha, xmin, xmin)))


def _log_exponential(x, cnt, xmin):
    excess = float(cnt @ (x - xmin)) / float(cnt.sum())
    rate = math.log1p(1.0 / max(excess, 1e-300))
    return math.log(-math.expm1(-rate)) - rate * (x - xmin)


def _log_truncated(x, cnt, xmin, alpha0):
    def logs(p):
        alpha, rate = 1.0 + math.exp(min(p[0], 5.0)), math.exp(min(p[1], 5.0))
        return -alpha * np.log(x / xmin) - rate * (x - xmin) - _truncated_log_norm(alpha, rate, xmin)

    mean = float(cnt @ x) / float(cnt.sum())
    best = None
    for share in (0.01, 0.1, 1.0):
        start = np.array([math.log(max(alpha0 - 1.0, 0.05)), math.log(share / mean)])
        p = _simplex_minimum(lambda q: -float(cnt @ logs(q)), start, np.array([0.3, 0.7]))
        if best is None or cnt @ logs(p) > cnt @ logs(best):
            best = p
    return logs(best)


def _log_lognormal(x, cnt, xmin):
    lx, n = np.log(x), float(cnt.sum())
    m = float(cnt @ lx) / n
    s = math.sqrt(max(float(cnt @ (lx - m) ** 2) / n, 1e-6))
    edges = np.unique(np.concatenate([np.log(x - 0.5), np.log(x + 0.5), [math.log(xmin - 0.5)]]))
    low, high = np.searchsorted(edges, np.log(x - 0.5)), np.searchsorted(edges, np.log(x + 0.5))

    def logs(p):
        mu, sigma = p[0], math.exp(min(p[1], 10.0))
        # upper-tail probabilities keep their precision far right of the centre
        upper = normal_cdf(-(edges - mu) / sigma)
        if upper[0] < 1e-250:
            return np.full(x.size, -1e6)  # the whole tail is out of reach of the arithmetic
        mass = np.maximum(upper[low] - upper[high], 1e-300)
        return np.log(mass) - math.log(upper[0])

    p = _simplex_minimum(lambda q: -float(cnt @ logs(q)), np.array([m, math.log(s)]), np.array([0.5, 0.3]), 250)
    return logs(p)


def likelihood_ratios(value: np.ndarray, cnt: np.ndarray, xmin: float, alpha: float) -> dict:
    """``{name: (R, p)}``: normalised log-likelihood ratio of the power law against alternatives.

    Positive R favours the power law. The truncated power law contains the power law, so its p comes
    from the chi-square distribution; the others use Vuong's test.
    """
    tail = value >= xmin
    x, c = value[tail].astype(float), cnt[tail].astype(float)
    n = float(c.sum())
    power = _log_power(x, alpha, xmin)
    others = {
        "lognormal": _log_lognormal(x, c, xmin),
        "exponential": _log_exponential(x, c, xmin),
        "truncated_power_law": _log_truncated(x, c, xmin, alpha),
    }
    out = {}
    for name, logs in others.items():
        diff = power - logs
        total = float(c @ diff)
        variance = float(c @ (diff - total / n) ** 2) / n
        if variance <= 0.0:
            out[name] = (0.0, 1.0)
            continue
        if name == "truncated_power_law":
            p = math.erfc(math.sqrt(abs(total)))
        else:
            p = math.erfc(abs(total) / math.sqrt(2.0 * n * variance))
        out[name] = (total / math.sqrt(n * variance), p)
    return out
