"""Maximum-likelihood fits of baseline and branching ratio, for all streams at once.

With the kernel shape fixed the log-likelihood is concave in the baseline and ``n``, so each fit is a
few Newton steps whose inputs are sums over events. The same sums give an upper bound on what any other
parameters could reach: steps go on until that bound closes, and every row carries it as ``gap`` (log-likelihood
units) and ``converged``. Streams up to ``spark.ripplework.fit.maxRows``
events are fitted whole, many in one task. For larger ones every Newton step is a distributed
aggregation: runs of events, packed in rows, give partial sums, the sums give the next point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.functions.concave import (
    CONVERGED_GAP,
    FLOOR,
    MAX_STEPS,
    Ascent,
    basis_integral,
    basis_matrix,
    first_guess,
    maximise_binned,
    maximise_each,
    maximise_many,
    placed_sums,
    segment_places,
)
from ripplework.functions.kernels import Kernel, exponential, power_law
from ripplework.functions.moments import ORDERS, merged_moments
from ripplework.functions.numeric import decayed_sums, stream_gaps
from ripplework.operators.excite import PACKED_GROUP, binned_scan, packed_scan, stack_kernels, unpacked
from ripplework.operators.sequence import BLOCK, arrange, has_hot_group
from ripplework.operators.shape import STREAM, TIME_ORDER, segment_edges, stream_spans, with_segments
from ripplework.session import checkpointed, checkpointed_wide, spread

FIT_MAX_ROWS_KEY = "spark.ripplework.fit.maxRows"
FIT_MAX_ROWS = 200_000
CHUNK_ROWS = 100_000
#: events of whole streams taken together in a task, and numbers in one array of streams fitted side by side
BATCH_ROWS = 20_000
SIDE_BY_SIDE = 200_000
MIN_EVENTS = 10

FIT_SCHEMA = (
    "stream_id string, kernel_idx int, k int, z double, n double, n_se double, ll double, "
    "theta array<double>, edges array<double>, n_events bigint, horizon double, cc double, "
    "gap double, converged boolean"
)

# fixed values: provisional kernel shape, grids and cutoffs of the near-critical gate
SHAPE_EPS, SHAPE_C = 0.4, 0.5
GATE_K = 12
N_GRID = (0.30, 0.45, 0.60, 0.75, 0.90, 1.05, 1.20)
N_GRID_EXTENDED = (0.30, 0.45, 0.60, 0.75, 0.90, 1.05, 1.20, 1.40, 1.60, 1.80, 2.00)
N_GRID_FINE = (
    0.60, 0.75, 0.90, 0.95, 1.00, 1.025, 1.05, 1.075, 1.10, 1.125, 1.15, 1.175, 1.20,
    1.25, 1.30, 1.45, 1.70, 2.00,
)
EPS_GRID = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.1)
EPS_GRID_FINE = (0.02, 0.035, 0.05, 0.07, 0.1, 0.15, 0.2, 0.4, 0.7, 1.1)
C_GRID = (0.5, 1.0, 2.0)
K_SWEEP = (1, 2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32)


def shape_grid(eps: Sequence[float] = EPS_GRID, c: Sequence[float] = C_GRID):
    """``[(eps, c, kernel)]`` in grid order."""
    return [(e, x, power_law(e, x)) for e in eps for x in c]


def _with_defaults(streams: DataFrame) -> DataFrame:
    """Optional per-stream scales: time factor, and the centre and width of the fixed-n grid."""
    defaults = {"t_scale": 1.0, "n_center": 0.0, "n_scale": 1.0}
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in streams.columns}
    return streams.select("stream_id", "horizon", *[c for c in defaults if c in streams.columns]).withColumns(missing)


def _most_rows(events: DataFrame, max_rows: int | None) -> int:
    """Events of the largest stream that one task fits."""
    return int(events.sparkSession.conf.get(FIT_MAX_ROWS_KEY, str(FIT_MAX_ROWS))) if max_rows is None else max_rows


def fit_cells(
    events: DataFrame,
    streams: DataFrame,
    kernels: Sequence[Kernel],
    *,
    basis: str = "step",
    ks: Sequence[int] = (1,),
    ns: Sequence[float] | None = None,
    min_events: int = 1,
    max_rows: int | None = None,
    lean: bool = False,
) -> DataFrame:
    """Fit every stream under every kernel, segment count and (if given) fixed branching ratio.

    ``ns=None`` fits ``n`` with the baseline. Otherwise ``n = n_center + n_scale * z`` for each ``z``
    in ``ns`` and only the baseline is fitted. ``t_scale`` multiplies times before the fit. ``lean`` leaves the baselines and
    their edges out, which are most of what is written for a grid.
    """
    if basis not in ("step", "linear"):
        raise ValueError(f"basis must be 'step' or 'linear', got {basis!r}")
    max_rows = _most_rows(events, max_rows)
    sizes = events.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("n_events"))
    sizes = sizes.where(F.col("n_events") >= min_events)
    # a row for each stream, worked out once for all that follows
    known = checkpointed(_with_defaults(streams).join(sizes, STREAM))
    rows = events.select("stream_id", "event_id", "t", *[c for c in events.columns if c == BLOCK])
    is_large = F.col("n_events") > max_rows
    fitted = _fit_grouped(rows.drop(BLOCK).join(known.where(~is_large).drop("n_events"), STREAM), kernels, basis, ks, ns, lean)
    large = known.where(is_large)
    if not large.isEmpty():
        big = rows.join(large, STREAM).withColumn("t", F.col("t") * F.col("t_scale"))
        first = [F.first(c).alias(c) for c in ("horizon", "n_events", "n_center", "n_scale")]
        info = large.withColumn("horizon", F.col("horizon") * F.col("t_scale")).groupBy("stream_id").agg(*first)
        if basis == "step" and tuple(ks) == (1,):
            fits = _fit_binned(big, info, kernels, ns)
        else:
            fits = _fit_distributed(big.drop(BLOCK), info, kernels, basis, ks, ns)
        fitted = fitted.unionByName(fits.select(fitted.columns))
    # fits cost far more than their rows, and nearly every reader needs them more than once
    return checkpointed(fitted)


def _fit_grouped(rows: DataFrame, kernels, basis, ks, ns, lean: bool) -> DataFrame:
    """Whole streams by the thousand in one task, short ones side by side in one set of arrays."""
    rates, weights = stack_kernels(kernels)
    _, masses = stack_kernels(kernels, integrated=True)
    scaled = rows.withColumns({"t": F.col("t") * F.col("t_scale"), "horizon": F.col("horizon") * F.col("t_scale")})
    whole = tuple(ks) == (1,)  # one segment needs no edges
    if not whole:
        info = scaled.groupBy("stream_id").agg(F.first("horizon").alias("horizon"), F.count(F.lit(1)).alias("n_events"))
        edges = checkpointed(segment_edges(scaled.select("stream_id", "event_id", "t"), info, ks, blocked=False))
        # the edges of a stream travel as rows beside its events
        cuts = edges.select("stream_id", F.col("k").cast("int").alias("k"), "edges")
        scaled = with_segments(scaled, edges).unionByName(cuts, allowMissingColumns=True)

    def fit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_streams(batches):
            cuts = None
            if not whole:
                is_cut = pdf["k"].notna()
                cuts, pdf = pdf[is_cut].sort_values(["stream_id", "k"]), pdf[~is_cut]
            if not pdf.empty:
                yield from _fit_streams(pdf, cuts, kernels, basis, ns, rates, weights, masses, lean)

    schema = ", ".join(c for c in FIT_SCHEMA.split(", ") if not (lean and c.endswith("array<double>")))
    return spread(scaled, "stream_id").sortWithinPartitions("stream_id").mapInPandas(fit_batches, schema)


def _whole_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by stream, cut so that no stream is in two of them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        held.append(pdf)
        if sum(len(x) for x in held) < BATCH_ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        cut = int((rows["stream_id"] == rows["stream_id"].iloc[-1]).to_numpy().argmax())
        if cut:
            yield rows.iloc[:cut]
        held = [rows.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _fit_streams(pdf, cuts, kernels, basis, ns, rates, weights, masses, lean=False) -> Iterator[pd.DataFrame]:
    place, names = pd.factorize(pdf["stream_id"])
    pdf = pdf.assign(_place=place).sort_values(["_place", "t", "event_id"])
    size = np.bincount(place, minlength=names.size)
    first = np.cumsum(size) - size
    t, head = pdf["t"].to_numpy(float), pdf.iloc[first]
    horizon, center, scale = (head[c].to_numpy(float) for c in ("horizon", "n_center", "n_scale"))
    part = [slice(a, a + b) for a, b in zip(first, size)]
    sound = np.isfinite(np.add.reduceat(t, first))  # a missing time must not reach the stream after it
    sums = np.empty((t.size, len(kernels)))
    if sound.all():
        sums[:] = decayed_sums(stream_gaps(pdf["_place"].to_numpy(), t), rates, weights)[0]
    else:
        for p in part:
            sums[p] = decayed_sums(stream_gaps(np.zeros(t[p].size), t[p]), rates, weights)[0]
    cells = [_Cells(len(kernels), _mass(horizon[i] - t[p], rates, masses), ns, center[i], scale[i]) for i, p in enumerate(part)]
    if cuts is None:
        edges = [[np.array([0.0, x])] for x in horizon]
        seg = np.zeros((t.size, 1), int)
        with np.errstate(divide="ignore", invalid="ignore"):
            through = np.repeat(horizon, size)
            weight = np.where(through != 0, t / through, 0.0)[:, None]
    else:
        by_name = {sid: [np.asarray(e, float) for e in own] for sid, own in cuts.groupby("stream_id")["edges"]}
        edges = [by_name[sid] for sid in names]
        seg, weight = np.vstack(pdf["segs"].to_numpy()).astype(int), np.vstack(pdf["weights"].to_numpy())
    each = cells[0].kernel.size
    for k in range(len(edges[0])):
        columns = edges[0][k].size - (basis == "step")
        # many cells of a wide baseline fill the arrays of one stream by themselves: only their steps are taken together
        alone = columns > 1 and each > 4
        for group in _alike(size, each * (1 if alone else columns), alone):
            longest = int(size[group].max())
            starts = [cells[i].start(basis, edges[i][k], size[i]) for i in group]
            theta0, cost = (np.concatenate(x) for x in zip(*starts))
            n = None if ns is None else np.concatenate([cells[i].n for i in group])
            events = np.repeat(size[group], each)
            if group.size == 1 or alone:
                own = [
                    (basis_matrix(basis, seg[part[i], k], weight[part[i], k], edges[i][k].size - 1), sums[part[i]][:, cells[i].kernel])
                    for i in group
                ]
                run = maximise_each(own, cost, theta0, n, events)
            else:
                h = np.zeros((group.size, longest, columns))
                idle = np.ones((group.size, longest))
                s = np.zeros((group.size, each, longest))
                for j, i in enumerate(group):
                    h[j, : size[i]] = basis_matrix(basis, seg[part[i], k], weight[part[i], k], edges[i][k].size - 1)
                    idle[j, : size[i]] = 0.0
                    s[j, :, : size[i]] = sums[part[i]][:, cells[i].kernel].T
                own = np.repeat(np.arange(group.size), each)
                run = maximise_many(h, idle, own, s.reshape(-1, longest), cost, theta0, n, events)
            yield _fitted([cells[i] for i in group], run, names[group], [edges[i][k] for i in group], size[group], horizon[group], lean)


def _alike(size: np.ndarray, width: int, alone: bool) -> Iterator[np.ndarray]:
    """Streams of about the same number of events, as many as one set of arrays takes; with arrays ``alone``, of any number."""
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < order.size:
        hi = lo + 1
        while hi < order.size:
            longest = size[order[hi]]
            if (hi + 1 - lo) * longest * width > SIDE_BY_SIDE or (not alone and longest > 1.25 * size[order[lo]] + 16):
                break
            hi += 1
        yield order[lo:hi]
        lo = hi


def _fitted(cells: list[_Cells], run: Ascent, names, edges, size, horizon, lean: bool) -> pd.DataFrame:
    each = cells[0].kernel.size
    free = cells[0].n is None
    count = len(cells) * each
    cc = np.concatenate([c.cc for c in cells])
    fixed = None if free else np.concatenate([c.n for c in cells])
    theta = run.theta[:, :-1] if free else run.theta
    nothing = np.full(count, None, dtype=object)
    baseline = {} if lean else {"theta": list(theta), "edges": [e for e in edges for _ in range(each)]}
    return pd.DataFrame(
        {
            "stream_id": np.repeat(np.asarray(names, dtype=object), each),
            "kernel_idx": np.concatenate([c.kernel for c in cells]).astype("int32"),
            "k": np.full(count, edges[0].size - 1, dtype="int32"),
            "z": nothing if free else np.concatenate([c.z for c in cells]),
            "n": run.theta[:, -1] if free else fixed,
            "n_se": run.spread if free else nothing,
            "ll": run.value if free else run.value - fixed * cc,
            **baseline,
            "n_events": np.repeat(size, each).astype("int64"),
            "horizon": np.repeat(horizon, each),
            "cc": cc,
            "gap": np.where(np.isfinite(run.gap), run.gap, np.nan),
            "converged": run.gap <= CONVERGED_GAP,
        }
    )


def _mass(left: np.ndarray, rates: np.ndarray, masses: np.ndarray) -> np.ndarray:
    total = np.zeros(rates.size)
    for lo in range(0, left.size, CHUNK_ROWS):
        total += (-np.expm1(-np.outer(left[lo : lo + CHUNK_ROWS], rates))).sum(axis=0)
    return total @ masses.T


class _Cells:
    """The cells of one stream: every kernel with ``n`` free, or with every fixed ``n``."""

    def __init__(self, kernels: int, cc: np.ndarray, ns, center: float, scale: float):
        each = 1 if ns is None else len(ns)
        self.kernel = np.repeat(np.arange(kernels), each)
        self.cc = np.asarray(cc, float)[self.kernel]
        self.z = None if ns is None else np.tile(np.asarray(ns, float), kernels)
        self.n = None if ns is None else np.maximum(FLOOR, center + scale * self.z)

    def start(self, basis: str, edges: np.ndarray, n_events: int) -> tuple[np.ndarray, np.ndarray]:
        """Start points and the cost of every parameter."""
        size = self.kernel.size
        theta = np.tile(first_guess(basis, edges, n_events), (size, 1))
        cost = np.tile(basis_integral(basis, edges), (size, 1))
        if self.n is None:
            theta = np.column_stack([theta, np.full(size, 0.5)])
            cost = np.column_stack([cost, self.cc])
        return theta, cost

    def rows(self, run: Ascent, stream_id, k, edges, n_events, horizon) -> list[dict]:
        free = self.n is None
        return [
            {
                "stream_id": stream_id,
                "kernel_idx": int(self.kernel[g]),
                "k": int(k),
                "z": None if free else float(self.z[g]),
                "n": float(run.theta[g, -1] if free else self.n[g]),
                "n_se": float(run.spread[g]) if free else None,
                "ll": float(run.value[g] - (0.0 if free else self.n[g] * self.cc[g])),
                "theta": (run.theta[g, :-1] if free else run.theta[g]).tolist(),
                "edges": np.asarray(edges).tolist(),
                "n_events": int(n_events),
                "horizon": float(horizon),
                "cc": float(self.cc[g]),
                "gap": float(run.gap[g]) if np.isfinite(run.gap[g]) else None,
                "converged": bool(run.gap[g] <= CONVERGED_GAP),
            }
            for g in range(run.theta.shape[0])
        ]


# ---- streams too large for one task -------------------------------------------------------------

_STATE_SCHEMA = (
    "stream_id string, k int, edges array<double>, mass array<double>, n_events bigint, "
    "horizon double, n_center double, n_scale double, theta array<double>, trial array<double>, "
    "value array<double>, direction array<double>, step array<double>, done array<boolean>, "
    "spread array<double>, gap array<double>"
)
_INFO = ("stream_id", "k", "edges", "mass", "n_events", "horizon", "n_center", "n_scale")


def _fit_distributed(big: DataFrame, info: DataFrame, kernels, basis, ks, ns) -> DataFrame:
    # a run of events in one row for all segment counts, written once: a step reads it where it lies and only its sums are shuffled
    design = checkpointed_wide(packed_scan(big, kernels), PACKED_GROUP)
    edges = _edges_of_packed(design, info, ks)
    start = edges.join(info, STREAM).join(_mass_of_packed(design, info, kernels), STREAM).select(*_INFO)

    def cells_of(row) -> _Cells:
        return _Cells(len(kernels), row.mass, ns, row.n_center, row.n_scale)

    def begin(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                theta0, _ = cells_of(row).start(basis, np.asarray(row.edges), row.n_events)
                rows.append(_pack(Ascent(theta0), row))
            yield pd.DataFrame(rows)

    state = checkpointed(start.mapInPandas(begin, _STATE_SCHEMA))
    parts_schema = "stream_id string, k int, parts array<double>"

    def run_sums(batches):
        held, name = {}, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.stream_id != name:
                    yield from _partials(name, held)
                    held, name = {}, row.stream_id
                t, s = unpacked(row)
                t, s = t[row.lead :], s[row.lead :]
                cells = cells_of(row)
                for k, edge, trial, done in zip(row.ks, row.edge, row.trials, row.dones):
                    live = np.flatnonzero(~np.asarray(done, bool))
                    seg, weight = segment_places(t, np.asarray(edge, float))
                    trial = np.asarray(trial, float).reshape(cells.kernel.size, -1)[live]
                    fixed = None if cells.n is None else cells.n[live]
                    parts = placed_sums(basis, seg, weight, s, cells.kernel[live], trial, fixed)
                    parts = np.concatenate([x.ravel() for x in parts])
                    held[int(k)] = held[int(k)] + parts if int(k) in held else parts
        yield from _partials(name, held)

    def total(batches):
        # sums of a grid take a MB, and each task has sent some: they are added up as they come
        held, name = {}, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.stream_id != name:
                    yield from _partials(name, held)
                    held, name = {}, row.stream_id
                k, parts = int(row.k), np.asarray(row.parts, float)
                held[k] = held[k] + parts if k in held else parts
        yield from _partials(name, held)

    def advance(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                run = _unpack(row, ns is not None)
                _, cost = cells_of(row).start(basis, np.asarray(row.edges), row.n_events)
                live = np.flatnonzero(~run.done)
                g, p, parts = live.size, cost.shape[1], np.asarray(row.parts, float)
                run.advance(
                    live, parts[:g], parts[g : g + g * p].reshape(g, p), parts[g + g * p :].reshape(g, p, p), cost[live],
                    row.n_events,
                )
                rows.append(_pack(run, row))
            yield pd.DataFrame(rows)

    for _ in range(MAX_STEPS):
        live = state.where(F.exists("done", lambda d: ~d))
        if live.isEmpty():
            break
        # one row for each large stream, one entry for each segment count
        same = ("mass", "n_center", "n_scale")
        own = F.collect_list(F.struct("k", "edges", "trial", "done")).alias("_own")
        points = live.groupBy("stream_id").agg(*[F.first(c).alias(c) for c in same], own)
        lists = {"k": "ks", "edges": "edge", "trial": "trials", "done": "dones"}
        points = points.select("stream_id", *same, *[F.col("_own")[c].alias(name) for c, name in lists.items()])
        partial = design.join(F.broadcast(points), STREAM).mapInPandas(run_sums, parts_schema)
        totals = spread(partial, "stream_id").sortWithinPartitions("stream_id").mapInPandas(total, parts_schema)
        stepped = live.join(totals, ["stream_id", "k"]).mapInPandas(advance, _STATE_SCHEMA)
        state = checkpointed(stepped.unionByName(state.where(F.forall("done", lambda d: d))))

    def finish(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                rows += cells_of(row).rows(_unpack(row), row.stream_id, row.k, row.edges, row.n_events, row.horizon)
            yield pd.DataFrame(rows)

    return state.mapInPandas(finish, FIT_SCHEMA)


def _fit_binned(big: DataFrame, info: DataFrame, kernels, ns) -> DataFrame:
    """Constant baselines: one pass turns the sums of every kernel into moments by bin, and steps need nothing else."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [
            (np.frombuffer(bins, np.int64), np.frombuffer(moments).reshape(-1, ORDERS + 1))
            for bins, moments in zip(rows["bins"], rows["moments"])
        ]
        bins, moments = merged_moments(parts)
        head = rows.iloc[0]
        edges = np.array([0.0, head["horizon"]])
        cells = _Cells(1, np.array([rows["mass"].sum()]), ns, head["n_center"], head["n_scale"])
        theta0, cost = cells.start("step", edges, head["n_events"])
        run = maximise_binned(bins, moments, cost, theta0, cells.n, head["n_events"])
        found = cells.rows(run, head["stream_id"], 1, edges, head["n_events"], head["horizon"])
        return pd.DataFrame(found).assign(kernel_idx=head["kernel_idx"])

    # some hundred bins for each block of a stream, so a kernel of a stream is a small group
    return binned_scan(big, kernels, info).groupBy("stream_id", "kernel_idx").applyInPandas(solve, FIT_SCHEMA)


def _partials(name: str | None, held: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    if held:
        yield pd.DataFrame({"stream_id": name, "k": pd.Series(list(held), dtype="int32"), "parts": list(held.values())})


def _edges_of_packed(design: DataFrame, info: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``segment_edges`` of packed streams."""
    if tuple(ks) == (1,):  # one segment needs no event
        return info.select("stream_id", F.lit(1).cast("bigint").alias("k"), F.array(F.lit(0.0), "horizon").alias("edges"))

    def ranks(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                t = np.frombuffer(row.t)[row.lead :]
                yield pd.DataFrame({"stream_id": row.stream_id, "rn": row.first + 1 + np.arange(t.size), "t": t})

    ranked = design.mapInPandas(ranks, "stream_id string, rn bigint, t double")
    return checkpointed(segment_edges(ranked, info, ks, ranked=ranked))


def _mass_of_packed(design: DataFrame, info: DataFrame, kernels: Sequence[Kernel]) -> DataFrame:
    """``horizon_mass`` of packed streams, one entry per kernel: ``(stream_id, mass)``."""
    rates, _ = stack_kernels(kernels)
    _, masses = stack_kernels(kernels, integrated=True)

    def partial(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                left = row.horizon - np.frombuffer(row.t)[row.lead :]
                yield pd.DataFrame({"stream_id": [row.stream_id], "mass": [_mass(left, rates, masses)]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": rows["stream_id"].iloc[:1], "mass": [np.vstack(rows["mass"].to_numpy()).sum(axis=0)]})

    schema = "stream_id string, mass array<double>"
    runs = design.select("stream_id", "lead", "t").join(F.broadcast(info.select("stream_id", "horizon")), STREAM)
    return runs.mapInPandas(partial, schema).groupBy("stream_id").applyInPandas(total, schema)


def _pack(run: Ascent, row) -> dict:
    held = {c: getattr(row, c) for c in _INFO}
    moving = {
        "theta": run.theta.ravel(), "trial": run.trial.ravel(), "value": run.value,
        "direction": run.direction.ravel(), "step": run.step, "done": run.done, "spread": run.spread, "gap": run.gap,
    }
    return held | {k: v.tolist() for k, v in moving.items()}


def _unpack(row, banded: bool = False) -> Ascent:
    cells = len(row.value)
    run = Ascent(np.array(row.theta, float).reshape(cells, -1), banded)
    run.trial = np.array(row.trial, float).reshape(cells, -1)
    run.direction = np.array(row.direction, float).reshape(cells, -1)
    run.value, run.step = np.array(row.value, float), np.array(row.step, float)
    run.done, run.spread, run.gap = np.array(row.done, bool), np.array(row.spread, float), np.array(row.gap, float)
    return run


# ---- named fits ---------------------------------------------------------------------------------


def information_criteria(fits: DataFrame, basis: str, *, n_free: bool = True) -> DataFrame:
    p = F.col("k") + (1 if basis == "linear" else 0) + (1 if n_free else 0)
    return fits.withColumns(
        {
            "aic": 2.0 * p - 2.0 * F.col("ll"),
            "bic": p * F.log(F.col("n_events").cast("double")) - 2.0 * F.col("ll"),
        }
    )


def with_all_streams(fits: DataFrame, events: DataFrame, streams: DataFrame) -> DataFrame:
    """``fits`` with a row for every stream: without a fit the estimates are NULL and ``reason`` says why."""
    counts = events.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("_n"))
    known = streams.select("stream_id").distinct().join(counts, STREAM, "left")
    reason = F.when(F.col("n").isNull(), F.when(F.col("_n").isNull(), "no_events").otherwise("too_few_events"))
    return (
        known.join(fits, STREAM, "left")
        .withColumns({"reason": reason, "n_events": F.coalesce("n_events", "_n", F.lit(0).cast("bigint"))})
        .drop("_n")
    )


def fit_constant(events: DataFrame, streams: DataFrame, kernel: Kernel, **options) -> DataFrame:
    """Constant baseline ``mu`` and ``n`` under one fixed kernel shape."""
    fits = fit_cells(events, streams, [kernel], **options).select(
        "stream_id", F.get("theta", F.lit(0)).alias("mu"), "n", "n_se", "ll", "n_events", "horizon", "cc", "gap", "converged"
    )
    return with_all_streams(fits, events, streams)


def fit_step(events, streams, kernel, ks, **options) -> DataFrame:
    return information_criteria(fit_cells(events, streams, [kernel], basis="step", ks=ks, **options), "step")


def fit_linear(events, streams, kernel, ks, **options) -> DataFrame:
    return information_criteria(
        fit_cells(events, streams, [kernel], basis="linear", ks=ks, **options), "linear"
    )


def likelihood_grid(
    events: DataFrame,
    streams: DataFrame,
    *,
    ns: Sequence[float] = N_GRID,
    eps: Sequence[float] = EPS_GRID,
    cs: Sequence[float] = C_GRID,
    k: int = GATE_K,
    basis: str = "linear",
    **options,
) -> DataFrame:
    """``ll(stream_id, n, eps, c)``: best likelihood over the baseline for every grid cell, with its ``gap``."""
    grid = shape_grid(eps, cs)
    fits = fit_cells(events, streams, [g[2] for g in grid], basis=basis, ks=[k], ns=ns, lean=True, **options)
    idx = F.col("kernel_idx")
    return fits.select(
        "stream_id",
        "n",
        F.get(F.array(*[F.lit(float(g[0])) for g in grid]), idx).alias("eps"),
        F.get(F.array(*[F.lit(float(g[1])) for g in grid]), idx).alias("c"),
        "ll",
        "n_events",
        "gap",
        "converged",
    )


LADDER = tuple(float(x) for x in 10.0 ** np.linspace(-2, 3, 41))
LADDER_STEP = 10.0 ** (5 / 40)


def fit_exponential(events: DataFrame, streams: DataFrame, *, rounds: int = 3, **options) -> DataFrame:
    """Exponential kernel with free decay rate: ``(mu, n, beta)`` by a refined ladder of rates.

    Times are rescaled per stream so that one ladder serves all streams: first to unit mean rate,
    then so that the best rate so far is 1. Streams of fewer than ``MIN_EVENTS`` events or without a
    time span keep a row with NULL estimates and a reason.
    """
    options = {"min_events": MIN_EVENTS} | options
    events = _written(events, options.get("max_rows"))
    spans = stream_spans(events).select("stream_id", "n_events")
    base = checkpointed(streams.select("stream_id", "horizon").join(spans, STREAM).where(F.col("horizon") > 0))
    scale = base.withColumn("t_scale", F.col("n_events") / F.col("horizon"))
    best = _best_rate(events, scale, LADDER, **options)
    span = LADDER_STEP
    for _ in range(rounds):
        ladder = tuple(float(x) for x in span ** np.linspace(-1, 1, 21))
        scale = base.join(best.select("stream_id", F.col("beta").alias("t_scale")), STREAM)
        best = _best_rate(events, scale, ladder, **options)
        span = span ** (1 / 10)
    return with_all_streams(best, events, streams)


def _written(events: DataFrame, max_rows: int | None) -> DataFrame:
    """Events written once for several fits; if a stream is large, in blocks that serve all of them, as scales keep the order."""
    events = checkpointed(events.select("stream_id", "event_id", "t"))
    if not has_hot_group(events, STREAM, _most_rows(events, max_rows)):
        return events
    return arrange(events, STREAM, TIME_ORDER, blocked=True).df


def _best_rate(events, streams, ladder, **options) -> DataFrame:
    fits = fit_cells(events, streams, [exponential(b) for b in ladder], **options)
    rates = F.array(*[F.lit(b) for b in ladder])
    scale = streams.select("stream_id", "t_scale")
    scored = fits.join(scale, STREAM).select(
        "stream_id",
        (F.get("theta", F.lit(0)) * F.col("t_scale")).alias("mu"),
        "n",
        "n_se",
        (F.get(rates, F.col("kernel_idx")) * F.col("t_scale")).alias("beta"),
        (F.col("ll") + F.col("n_events") * F.log("t_scale")).alias("ll"),
        "n_events",
    )
    pick = F.max_by(F.struct("mu", "n", "n_se", "beta", "ll", "n_events"), F.struct("ll", -F.col("beta")))
    return checkpointed(scored.groupBy("stream_id").agg(pick.alias("b")).select("stream_id", "b.*"))


# fixed value: 95% point of the chi-square distribution with one degree of freedom
CHI2_95 = 3.841458820694124


def profile_interval(
    events: DataFrame,
    streams: DataFrame,
    fits: DataFrame,
    *,
    reach: float = 6.0,
    step: float = 0.25,
    **options,
) -> DataFrame:
    """Interval of ``n`` where twice the drop of the profile likelihood stays below 3.84.

    ``fits`` is the output of ``fit_exponential``. The profile is taken at steps of a quarter standard
    error around the estimate, over a ladder of decay rates; crossings are interpolated linearly. An
    end that is not reached is reported as the last step with ``lo_crossed``/``hi_crossed`` false.
    """
    events = _written(events, options.get("max_rows"))
    zs = [float(z) for z in np.arange(-reach, reach + step / 2, step)]
    ladder = tuple(float(x) for x in 4.0 ** np.linspace(-1, 1, 21))
    width = F.when(F.col("n_se") > 0, F.col("n_se")).otherwise(F.lit(0.05))
    centred = streams.select("stream_id", "horizon").join(
        fits.where("n IS NOT NULL").select(
            "stream_id",
            F.col("beta").alias("t_scale"),
            F.col("n").alias("n_center"),
            F.least(F.nanvl(width, F.lit(0.05)), F.lit(1.0)).alias("n_scale"),
            F.col("ll").alias("_top"),
            F.col("n_events").alias("_events"),
        ),
        STREAM,
    )
    cells = fit_cells(events, centred, [exponential(b) for b in ladder], ns=zs, lean=True, **options)
    profile = cells.groupBy("stream_id", "z", "n").agg(F.max("ll").alias("_ll"))
    profile = profile.join(centred.select("stream_id", "t_scale", "_top", "_events", "n_center"), STREAM)
    drop = 2.0 * (F.col("_top") - (F.col("_ll") + F.col("_events") * F.log("t_scale"))) - CHI2_95
    w = Window.partitionBy("stream_id").orderBy("z")  # one row per grid step
    walked = profile.withColumn("_g", drop).withColumns(
        {"_g0": F.lag("_g").over(w), "_n0": F.lag("n").over(w)}
    )
    at = F.col("_n0") + (F.col("n") - F.col("_n0")) * F.try_divide(
        F.col("_g0"), F.col("_g0") - F.col("_g")
    )
    falls = (F.col("_g0") > 0) & (F.col("_g") <= 0) & (F.col("z") <= 0)
    rises = (F.col("_g0") <= 0) & (F.col("_g") > 0) & (F.col("z") > 0)
    ends = walked.groupBy("stream_id").agg(
        F.first("n_center").alias("n"),
        F.max(F.when(falls, at)).alias("_lo"),
        F.min(F.when(rises, at)).alias("_hi"),
        F.min("n").alias("_first"),
        F.max("n").alias("_last"),
    )
    return ends.select(
        "stream_id",
        "n",
        F.coalesce("_lo", "_first").alias("lo"),
        F.coalesce("_hi", "_last").alias("hi"),
        F.col("_lo").isNotNull().alias("lo_crossed"),
        F.col("_hi").isNotNull().alias("hi_crossed"),
    )


def regime_band(n: Column) -> Column:
    """Band of the branching ratio (fixed limits 0.7, 0.9 and 1.0)."""
    return (
        F.when(n.isNull(), F.lit(None).cast("string"))
        .when(n < 0.7, "subcritical")
        .when(n < 0.9, "endogenous")
        .when(n < 1.0, "near_critical")
        .otherwise("supercritical")
    )
