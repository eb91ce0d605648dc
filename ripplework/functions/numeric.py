"""Vectorised numerical helpers that run inside Spark tasks."""

from __future__ import annotations

import math

import numpy as np

SCAN_CHUNK = 8192


def decayed_sums(
    gap: np.ndarray, beta: np.ndarray, weights: np.ndarray, carry: np.ndarray | None = None, count: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``out[i, s] = sum_k weights[s, k] * A[i, k]`` with ``A[i] = exp(-beta * gap[i]) * (A[i-1] + 1)``.

    ``gap`` is infinite at the first event of a stream. ``carry`` is ``A`` of the event just before
    the first row. Returns the contracted sums and ``A`` of the last row. With ``count`` a row stands for so many
    events at one time: it adds ``count`` where one event adds 1, and what is returned for the last row holds all but one.
    """
    out = np.empty((gap.size, weights.shape[0]))
    last = np.zeros(beta.size) if carry is None else carry
    for lo in range(0, gap.size, SCAN_CHUNK):
        block, last = _scan_chunk(gap[lo : lo + SCAN_CHUNK], beta, last, None if count is None else count[lo : lo + SCAN_CHUNK])
        out[lo : lo + SCAN_CHUNK] = block @ weights.T
    return out, last


def _scan_chunk(gap: np.ndarray, beta: np.ndarray, carry: np.ndarray, count: np.ndarray | None = None):
    n = gap.size
    width = max(1, int(math.sqrt(n)))
    rows = -(-n // width)
    padded = np.full(rows * width, np.inf)
    padded[:n] = gap
    decay = np.exp(-padded.reshape(rows, width)[:, :, None] * beta)
    added = np.ones(rows * width)
    if count is not None:
        added[:n] = count
    added = added.reshape(rows, width, 1)
    local = np.zeros_like(decay)
    for j in range(1, width):
        local[:, j] = decay[:, j] * (local[:, j - 1] + added[:, j - 1])
    through = np.cumprod(decay, axis=1)
    entering = np.empty((rows, beta.size))
    state = carry + 1.0
    for r in range(rows):
        entering[r] = state
        state = local[r, -1] + through[r, -1] * state + added[r, -1]
    local += through * entering[:, None, :]
    full = local.reshape(rows * width, beta.size)[:n]
    return full, full[-1] + (added.reshape(-1)[n - 1] - 1.0)


def stream_gaps(stream: np.ndarray, t: np.ndarray, last_stream=None, last_t: float = 0.0) -> np.ndarray:
    """Time since the event before in the same stream; infinite where a stream begins."""
    gap = np.empty(t.size)
    if t.size == 0:
        return gap
    gap[0] = t[0] - last_t if last_stream is not None and stream[0] == last_stream else np.inf
    same = stream[1:] == stream[:-1]
    gap[1:] = np.where(same, t[1:] - t[:-1], np.inf)
    return gap


def hurwitz_zeta(s: np.ndarray, q: np.ndarray, scale: np.ndarray = 1.0, terms: int = 10) -> np.ndarray:
    """``sum_{k>=0} ((q + k) / scale)^-s`` by Euler-Maclaurin summation after ``terms`` direct terms.

    A scale near ``q`` keeps steep exponents from underflowing.
    """
    s, q, scale = np.broadcast_arrays(*(np.asarray(x, float) for x in (s, q, scale)))
    direct = sum(((q + k) / scale) ** -s for k in range(terms))
    m = (q + terms) / scale
    tail = scale * m ** (1.0 - s) / (s - 1.0) + 0.5 * m**-s
    tail = tail + s / 12.0 * m ** (-s - 1.0) / scale
    tail = tail - s * (s + 1.0) * (s + 2.0) / 720.0 * m ** (-s - 3.0) / scale**3
    tail = tail + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) / 30240.0 * m ** (-s - 5.0) / scale**5
    return direct + tail


def normal_cdf(x: np.ndarray) -> np.ndarray:
    x = np.atleast_1d(np.asarray(x, float))
    flat = [0.5 * math.erfc(-v / math.sqrt(2.0)) for v in x.ravel()]
    return np.asarray(flat).reshape(x.shape)


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, for all elements at once."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    flip = x > (a + 1.0) / (a + b + 2.0)  # the fraction converges fast on one side of the mean
    x, a, b = np.where(flip, 1.0 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + _LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b)) / a
    # the fraction 1/(1+ d1/(1+ d2/(1+ ...))) by numerators and denominators, rescaled as they grow
    num0, num1, den0, den1 = np.zeros_like(x), np.ones_like(x), np.ones_like(x), np.ones_like(x)
    value = np.ones_like(x)
    for m in range(1, 20_000):
        for even in (False, True):
            j = (m if even else m - 1.0)
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + j) * (a + b + j) * x / ((a + 2 * j) * (a + 2 * j + 1))
            num0, num1 = num1, num1 + d * num0
            den0, den1 = den1, den1 + d * den0
        size = np.where(den1 == 0, 1.0, den1)
        num0, num1, den0, den1 = num0 / size, num1 / size, den0 / size, den1 / size
        last, value = value, num1
        if np.all(np.abs(value - last) <= 1e-14 * np.abs(value)):
            break
    else:
        raise ArithmeticError("the continued fraction did not settle")
    part = np.where(x <= 0.0, 0.0, front * value)
    return np.where(flip, 1.0 - part, part)


def binomial_upper(k: np.ndarray, n: np.ndarray, tail: float = 0.05) -> np.ndarray:
    """Rates at which ``P(X <= k) = tail`` for binomials of ``n`` trials, by bisection over all pairs at once."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    lo, hi = np.zeros_like(k), np.ones_like(k)
    inner = k < n
    a, b = np.where(inner, k + 1.0, 1.0), np.where(inner, n - k, 1.0)
    for _ in range(60):
        mid = (lo + hi) / 2.0
        above = 1.0 - incomplete_beta(mid, a, b) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(inner, (lo + hi) / 2.0, 1.0)
