"""Maximise ``sum log(H b + n s) - C b - n cc`` over the baseline ``b`` and, if free, ``n``.

Many cells at a time: a cell is one kernel (its excitation column ``s``) with ``n`` free or fixed, all
cells share the baseline columns ``H``. The sums over events come from ``partial_sums`` on any slice
of the events, so the same step rule serves a stream held by one task and one spread over a cluster.
"""

from __future__ import annotations

import numpy as np

from ripplework.functions.moments import binned_sums

FLOOR = 1e-9
GAIN_TOLERANCE = 1e-12
#: a fit stops once no other parameters can raise its log-likelihood by more than this times the events
GAP_PER_EVENT = 1e-13
#: and counts as converged if they can't raise it by more than this
CONVERGED_GAP = 1e-4
MAX_STEPS = 80
_ELEMENTS = 1_000_000
_CACHED = 100_000


def basis_matrix(kind: str, seg: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Baseline weights per event: ``step`` has one column per segment, ``linear`` one per knot."""
    rows = np.arange(seg.size)
    if kind == "step":
        h = np.zeros((seg.size, k))
        h[rows, seg] = 1.0
        return h
    h = np.zeros((seg.size, k + 1))
    h[rows, seg] = 1.0 - weight
    h[rows, seg + 1] += weight
    return h


def basis_integral(kind: str, edges: np.ndarray) -> np.ndarray:
    """Integral over the horizon of each baseline column."""
    length = np.diff(edges)
    if kind == "step":
        return length
    half = 0.5 * length
    return np.concatenate([half, [0.0]]) + np.concatenate([[0.0], half])


def first_guess(kind: str, edges: np.ndarray, n_events: int) -> np.ndarray:
    """Half the mean rate everywhere; the problem is concave, so the start does not matter."""
    cols = edges.size - 1 if kind == "step" else edges.size
    rate = n_events / max(edges[-1] - edges[0], FLOOR)
    return np.full(cols, max(0.5 * rate, 1e-6))


def partial_sums(
    h: np.ndarray, s: np.ndarray, theta: np.ndarray, n: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and curvature sums over the given events, for every cell.

    ``h`` is events x baseline columns, ``s`` events x cells. ``theta`` is cells x parameters, with
    ``n`` as the last parameter unless it is given.
    """
    cells, p = theta.shape
    base = h.shape[1]
    ll, grad, hess = np.zeros(cells), np.zeros((cells, p)), np.zeros((cells, p, p))
    level = theta[:, base] if n is None else n
    square, beside = h * h, h[:, :-1] * h[:, 1:]  # an event weighs on one column or on two adjacent ones
    on, off = np.arange(base), np.arange(base - 1)
    step = max(1, _ELEMENTS // max(base, cells))
    for lo in range(0, h.shape[0], step):
        part, sg = h[lo : lo + step], s[lo : lo + step].T
        lam = theta[:, :base] @ part.T + level[:, None] * sg
        inv = 1.0 / lam
        sq = inv * inv
        ll += np.log(lam).sum(axis=1)
        grad[:, :base] += inv @ part
        hess[:, on, on] += sq @ square[lo : lo + step]
        if base > 1:
            cross = sq @ beside[lo : lo + step]
            hess[:, off, off + 1] += cross
            hess[:, off + 1, off] += cross
        if n is None:
            mixed = sq * sg
            cross = mixed @ part
            grad[:, base] += (inv * sg).sum(axis=1)
            hess[:, :base, base] += cross
            hess[:, base, :base] += cross
            hess[:, base, base] += (mixed * sg).sum(axis=1)
    return ll, grad, hess


def segment_places(t: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment of every time, clipped to the first and the last, and its place inside (0 in a segment of no length)."""
    seg = np.clip(np.searchsorted(edges, t, side="right") - 1, 0, edges.size - 2)
    seg[np.isnan(t)] = 0
    length = np.diff(edges)[seg]
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(length != 0, (t - edges[seg]) / length, 0.0)
    return seg, np.where(np.isnan(weight), 0.0, weight)


def placed_sums(
    kind: str, seg: np.ndarray, weight: np.ndarray, s: np.ndarray, kernel: np.ndarray, theta: np.ndarray, n: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``partial_sums`` of events in time order, each in its segment: sums over runs, without a column for every segment.

    ``s`` is events x kernels, ``kernel`` the kernel of every cell.
    """
    cells, p = theta.shape
    base = p if n is not None else p - 1
    ll, grad, hess = np.zeros(cells), np.zeros((cells, p)), np.zeros((cells, p, p))
    level = (theta[:, base] if n is None else n)[:, None]
    step = max(1, _CACHED // cells)
    for lo in range(0, seg.size, step):
        at, w = seg[lo : lo + step], weight[lo : lo + step]
        sg = s[lo : lo + step].T[kernel]
        runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        own, length = at[runs], np.diff(np.append(runs, at.size))

        def over(x):
            return x.sum(axis=1)[:, None] if runs.size == 1 else np.add.reduceat(x, runs, axis=1)

        def spread(columns):
            return theta[:, columns] if runs.size == 1 else np.repeat(theta[:, columns], length, axis=1)

        lam = level * sg
        if kind == "step":
            lam += spread(own)
        else:
            lam += spread(own) * (1.0 - w) + spread(own + 1) * w
        ll += np.log(lam).sum(axis=1)
        inv = np.divide(1.0, lam, out=lam)
        sq = inv * inv
        shares = [(own, None)] if kind == "step" else [(own, 1.0 - w), (own + 1, w)]
        for column, share in shares:
            grad[:, column] += over(inv if share is None else inv * share)
            hess[:, column, column] += over(sq if share is None else sq * (share * share))
        if kind != "step":
            cross = over(sq * (w * (1.0 - w)))
            hess[:, own, own + 1] += cross
            hess[:, own + 1, own] += cross
        if n is None:
            mixed = sq * sg
            grad[:, base] += (inv * sg).sum(axis=1)
            hess[:, base, base] += (mixed * sg).sum(axis=1)
            for column, share in shares:
                cross = over(mixed if share is None else mixed * share)
                hess[:, column, base] += cross
                hess[:, base, column] += cross
    return ll, grad, hess


def _sums_side_by_side(h, square, beside, idle, s, theta, n):
    """``partial_sums`` of cells that hold events of their own: ``h`` is cells x events x columns, ``s`` cells x events.

    Places filled up to the longest cell have no weight and are marked in ``idle``.
    """
    cells, p = theta.shape
    base = h.shape[2]
    grad, hess = np.zeros((cells, p)), np.zeros((cells, p, p))
    level = theta[:, base] if n is None else n
    lam = (theta[:, :1] * h[:, :, 0] if base == 1 else np.matmul(h, theta[:, :base, None])[:, :, 0]) + level[:, None] * s + idle
    inv = 1.0 / lam
    sq = inv * inv

    def over(x, weights):
        if weights.shape[2] == 1:
            return (x * weights[:, :, 0]).sum(axis=1)[:, None]
        return np.matmul(x[:, None, :], weights)[:, 0]

    on, off = np.arange(base), np.arange(base - 1)
    grad[:, :base] = over(inv, h)
    hess[:, on, on] = over(sq, square)
    if base > 1:
        hess[:, off, off + 1] = hess[:, off + 1, off] = over(sq, beside)
    if n is None:
        mixed = sq * s
        grad[:, base] = (inv * s).sum(axis=1)
        hess[:, :base, base] = hess[:, base, :base] = over(mixed, h)
        hess[:, base, base] = (mixed * s).sum(axis=1)
    return np.log(lam).sum(axis=1), grad, hess


def optimality_gap(theta: np.ndarray, sums: np.ndarray, cost: np.ndarray, n_events: int | np.ndarray) -> np.ndarray:
    """A bound on what any other non-negative parameters could add to the log-likelihood, for every cell.

    ``sums`` holds the sum over events of each parameter's column over the intensity. For intensities ``v`` and any
    others ``u``, ``log u <= log v - log c - 1 + c u / v`` for every ``c > 0``. With ``1 / c = k`` no smaller than any
    parameter's sum over its cost, the parameters drop out of the summed bound; what a fixed part of the intensity adds
    is the events less ``theta . sums``, because the terms of each event add up to one. The best such ``k`` is the larger
    of that ratio and the fixed part's share. At the optimum ``k`` is 1 and the bound is 0.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(sums > 0, sums / cost, 0.0).max(axis=1)
        fixed = np.maximum(n_events - (theta * sums).sum(axis=1), 0.0)
        k = np.maximum(ratio, fixed / n_events)
        gap = n_events * np.log(k) - n_events + fixed / k + (theta * cost).sum(axis=1)
    return np.where(np.isnan(gap), np.inf, np.maximum(gap, 0.0))


class Ascent:
    """Projected Newton with step halving, all cells side by side, until the optimality gap closes."""

    def __init__(self, theta0: np.ndarray, banded: bool = False):
        cells = theta0.shape[0]
        self.banded = banded  # a parameter meets only its neighbours: no n beside the baseline
        self.theta = theta0.copy()
        self.trial = theta0.copy()
        self.value = np.full(cells, -np.inf)
        self.direction = np.zeros_like(theta0)
        self.step = np.ones(cells)
        self.done = np.zeros(cells, dtype=bool)
        self.spread = np.full(cells, np.nan)
        self.gap = np.full(cells, np.inf)

    def advance(
        self, live: np.ndarray, ll: np.ndarray, grad: np.ndarray, hess: np.ndarray, cost: np.ndarray, n_events: int | np.ndarray
    ) -> None:
        """Take the sums at the trial points of the cells ``live`` and choose their next points."""
        n_events = np.broadcast_to(n_events, live.shape)
        trial = self.trial[live]
        value = ll - (trial * cost).sum(axis=1)
        slack = GAIN_TOLERANCE * (1.0 + np.abs(value))
        old = self.value[live]
        ok = value >= old - slack
        gain = value - old
        won = live[ok]
        self.theta[won], self.value[won] = trial[ok], np.maximum(value[ok], old[ok])
        gap = optimality_gap(trial[ok], grad[ok], cost[ok], n_events[ok])
        # closed, or neither the value nor the bound moves any more
        stalled = (gain[ok] <= slack[ok]) & (gap >= 0.5 * self.gap[won])
        self.gap[won] = gap
        self.done[won[(gap <= GAP_PER_EVENT * n_events[ok]) | stalled]] = True
        if won.size:
            newton = _newton_banded if self.banded else _newton
            self.direction[won], self.spread[won] = newton(trial[ok], grad[ok] - cost[ok], hess[ok])
            self.step[won] = 1.0
        self.step[live[~ok]] *= 0.5
        self.done[live[self.step[live] < 1e-12]] = True
        moved = self.theta[live] + self.step[live][:, None] * self.direction[live]
        self.trial[live] = np.maximum(FLOOR, moved)


def _newton(theta: np.ndarray, grad: np.ndarray, hess: np.ndarray):
    """Newton direction over parameters not held at the floor, and the spread of the last one."""
    p = theta.shape[1]
    held = (theta <= FLOOR) & (grad <= 0.0)
    free = ~held
    scale = np.sqrt(np.maximum(np.einsum("gii->gi", hess), 1e-300))
    unit = hess / (scale[:, :, None] * scale[:, None, :])
    unit = np.where(free[:, :, None] & free[:, None, :], unit, 0.0)
    diagonal = np.arange(p)
    unit[:, diagonal, diagonal] = np.where(free, 1.0 + 1e-10, 1.0)
    rhs = np.where(free, grad / scale, 0.0)
    both = np.concatenate([rhs[:, :, None], np.zeros_like(rhs)[:, :, None]], axis=2)
    both[:, -1, 1] = 1.0
    solved = np.linalg.solve(unit, both)
    spread = np.where(free[:, -1], np.sqrt(np.maximum(solved[:, -1, 1], 0.0)) / scale[:, -1], np.nan)
    return solved[:, :, 0] / scale, spread


def _newton_banded(theta: np.ndarray, grad: np.ndarray, hess: np.ndarray):
    """``_newton`` where only neighbours meet: one sweep down the columns and one back, all cells at a time."""
    p = theta.shape[1]
    free = ~((theta <= FLOOR) & (grad <= 0.0)).T
    scale = np.sqrt(np.maximum(np.einsum("gii->ig", hess), 1e-300))
    x = np.where(free, grad.T / scale, 0.0)
    on = np.where(free, 1.0 + 1e-10, 1.0)
    off = np.zeros((p, theta.shape[0]))
    if p > 1:
        off[:-1] = np.where(free[:-1] & free[1:], np.einsum("gii->ig", hess[:, :-1, 1:]) / (scale[:-1] * scale[1:]), 0.0)
    for j in range(1, p):
        ratio = off[j - 1] / on[j - 1]
        on[j] -= ratio * off[j - 1]
        x[j] -= ratio * x[j - 1]
    x[-1] /= on[-1]
    for j in range(p - 2, -1, -1):
        x[j] = (x[j] - off[j] * x[j + 1]) / on[j]
    return (x / scale).T, np.full(theta.shape[0], np.nan)


def maximise(
    h: np.ndarray, s: np.ndarray, cost: np.ndarray, theta0: np.ndarray, n: np.ndarray | None
) -> Ascent:
    """Run until every gap is closed on events held in memory; finished cells leave the work."""
    run = Ascent(theta0, n is not None)
    for _ in range(MAX_STEPS):
        live = np.flatnonzero(~run.done)
        if live.size == 0:
            break
        fixed = None if n is None else n[live]
        run.advance(live, *partial_sums(h, s[:, live], run.trial[live], fixed), cost[live], h.shape[0])
    return run


def maximise_binned(
    bins: np.ndarray, moments: np.ndarray, cost: np.ndarray, theta0: np.ndarray, n: np.ndarray | None, n_events: int
) -> Ascent:
    """``maximise`` for a constant baseline on the moments by bin of one kernel's sums."""
    run = Ascent(theta0, n is not None)
    for _ in range(MAX_STEPS):
        live = np.flatnonzero(~run.done)
        if live.size == 0:
            break
        run.advance(live, *binned_sums(bins, moments, run.trial[live], None if n is None else n[live]), cost[live], n_events)
    return run


def maximise_many(
    h: np.ndarray, idle: np.ndarray, own: np.ndarray, s: np.ndarray, cost: np.ndarray, theta0: np.ndarray,
    n: np.ndarray | None, n_events: np.ndarray,
) -> Ascent:
    """``maximise`` for the cells of many short streams: ``own`` is the stream of a cell.

    ``h`` is streams x events x columns, ``idle`` (streams x events) marks places beyond a stream's own events.
    """
    run = Ascent(theta0, n is not None)
    square, beside = h * h, h[:, :, :-1] * h[:, :, 1:]
    for _ in range(MAX_STEPS):
        live = np.flatnonzero(~run.done)
        if live.size == 0:
            break
        at = own[live]
        fixed = None if n is None else n[live]
        sums = _sums_side_by_side(h[at], square[at], beside[at], idle[at], s[live], run.trial[live], fixed)
        run.advance(live, *sums, cost[live], n_events[live])
    return run


def maximise_each(
    streams: list[tuple[np.ndarray, np.ndarray]], cost: np.ndarray, theta0: np.ndarray, n: np.ndarray | None, n_events: np.ndarray
) -> Ascent:
    """``maximise`` for the many cells of some streams: sums stream by stream, steps for all cells at once.

    ``streams`` holds ``h`` and ``s`` of each; all have the same number of cells, which stand stream by stream.
    """
    run = Ascent(theta0, n is not None)
    each = theta0.shape[0] // len(streams)
    for _ in range(MAX_STEPS):
        live = np.flatnonzero(~run.done)
        if live.size == 0:
            break
        sums = []
        for i, own in enumerate(np.split(live, np.searchsorted(live, np.arange(1, len(streams)) * each))):
            if own.size:
                h, s = streams[i]
                sums.append(partial_sums(h, s[:, own - i * each], run.trial[own], None if n is None else n[own]))
        run.advance(live, *(np.concatenate(x) for x in zip(*sums)), cost[live], n_events[live])
    return run
