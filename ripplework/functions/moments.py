"""Many numbers as moments by bin: enough for sums of ``log(mu + n x)`` and its derivatives at any ``mu`` and ``n``.

Numbers with the same sign, exponent and first bits of the fraction share a bin, so none is further from the middle ``c`` of its bin
than ``c / 65``. A bin keeps the sums of the powers of ``u = (x - c) / c``. With ``r = n c / (mu + n c)``, which is below 1,
``log(mu + n x)`` is ``log(mu + n c) + log(1 + r u)``: its series in ``r u``, cut after ``ORDERS`` terms, is as exact as the sum
itself in double precision. Numbers near zero share one bin, where ``r`` is near zero.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BIN_BITS = 5
ORDERS = 9
_SHIFT = 52 - BIN_BITS
_NEAR_ZERO = int(np.float64(2.0**-60).view(np.int64)) >> _SHIFT
_CELLS = 200_000


def _middles(bins: np.ndarray) -> np.ndarray:
    size = ((np.abs(bins) << _SHIFT) | (1 << (_SHIFT - 1))).view(np.float64)
    return np.where(bins < 0, -size, size)


def moments_by_bin(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins that hold a number, rising, and for each its count and the sums of ``u`` to ``u ** ORDERS``."""
    x = np.ascontiguousarray(x, float)
    bins = np.maximum(np.abs(x).view(np.int64) >> _SHIFT, _NEAR_ZERO)
    negative = x < 0
    if negative.any():
        own, at = np.unique(np.where(negative, -bins, bins), return_inverse=True)
    else:
        own = np.arange(bins.min(), bins.max() + 1)
        at = bins - own[0]
    middle = _middles(own)
    u = x / middle[at] - 1.0
    out = np.empty((own.size, ORDERS + 1))
    out[:, 0] = np.bincount(at, minlength=own.size)
    power = u
    for k in range(1, ORDERS + 1):
        out[:, k] = np.bincount(at, power, own.size)
        power = power * u
    held = out[:, 0] > 0
    return own[held], out[held]


def merged_moments(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The moments of all ``parts`` taken together."""
    bins = np.concatenate([b for b, _ in parts])
    order = np.argsort(bins, kind="stable")
    bins = bins[order]
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    return bins[first], np.add.reduceat(np.concatenate([m for _, m in parts])[order], first, axis=0)


def binned_sums(
    bins: np.ndarray, moments: np.ndarray, theta: np.ndarray, n: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``concave.partial_sums`` for a constant baseline, from the moments of the excitation sums."""
    cells, p = theta.shape
    ll, grad, hess = np.zeros(cells), np.zeros((cells, p)), np.zeros((cells, p, p))
    level = theta[:, 1] if n is None else n
    c = _middles(bins)
    m0 = moments.T
    m1 = m0[:-1] + m0[1:]  # sums of u ** k * x / c
    m2 = m1[:-1] + m1[1:]  # and of u ** k * (x / c) ** 2
    step = max(1, _CELLS // bins.size)
    for lo in range(0, cells, step):
        part = slice(lo, lo + step)
        lam = theta[part, :1] + level[part, None] * c
        r = -level[part, None] * c / lam

        def series(weighted):
            total = np.broadcast_to(weighted[-1], r.shape)
            for w in weighted[-2::-1]:
                total = total * r + w
            return total

        def log_series():
            total = np.broadcast_to(m0[ORDERS] / ORDERS, r.shape)
            for k in range(ORDERS - 1, 0, -1):
                total = total * r + m0[k] / k
            return -total * r

        rising = np.arange(1, ORDERS + 2)[:, None]
        inv = 1.0 / lam
        ll[part] = (m0[0] * np.log(lam) + log_series()).sum(axis=1)
        grad[part, 0] = (series(m0) * inv).sum(axis=1)
        sq = inv * inv
        hess[part, 0, 0] = (series(m0 * rising) * sq).sum(axis=1)
        if n is None:
            grad[part, 1] = (series(m1) * inv * c).sum(axis=1)
            hess[part, 0, 1] = hess[part, 1, 0] = (series(m1 * rising[:-1]) * sq * c).sum(axis=1)
            hess[part, 1, 1] = (series(m2 * rising[:-2]) * sq * c * c).sum(axis=1)
    return ll, grad, hess
