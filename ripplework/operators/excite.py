"""Decay-weighted self-excitation along every stream, in one pass over the time-ordered events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.functions.kernels import Kernel
from ripplework.functions.moments import merged_moments, moments_by_bin
from ripplework.functions.numeric import decayed_sums, stream_gaps
from ripplework.operators.sequence import BLOCK, arrange, has_hot_group
from ripplework.operators.shape import STREAM, TIME_ORDER, with_segment
from ripplework.session import spread

COUNT = "_count"
SCAN_SCHEMA = "stream_id string, event_id bigint, t double, prior bigint, sums array<double>"
#: ``lead`` is 1 if the arrays begin with the event before the run
PACKED_SCHEMA = "stream_id string, first bigint, lead int, t binary, sums binary"
#: numbers in the sums of one packed run, and runs in a row group of the file they are written to
PACKED_NUMBERS = 1_000_000
PACKED_ROWS = 100_000
PACKED_GROUP = 2
#: events of a block, and numbers in its sums if they are held together
SCAN_ROWS = 500_000
SCAN_NUMBERS = 4_000_000
#: events of a block that have their sums at the same time before these are binned
FOLDED_ROWS = 32_768


def stack_kernels(kernels: Sequence[Kernel], *, integrated: bool = False):
    """Distinct decay rates of all kernels and one weight row per kernel.

    ``integrated`` weights components by ``a / beta``, as the compensator needs.
    """
    rates = sorted({b for k in kernels for b in k.beta})
    place = {b: i for i, b in enumerate(rates)}
    weights = np.zeros((len(kernels), len(rates)))
    for row, k in enumerate(kernels):
        for a, b in zip(k.a, k.beta):
            weights[row, place[b]] += a / b if integrated else a
    return np.asarray(rates), weights


def decay_scan(
    events: DataFrame, rates: np.ndarray, weights: np.ndarray, *, blocked: bool | None = None, count: str | None = None
) -> DataFrame:
    """``sums[s] = sum_k weights[s,k] sum_{j<i} exp(-rate_k (t_i - t_j))`` and the rank from 0.

    Earlier means an earlier row in (t, event_id): a tied earlier event counts in full. Streams of
    ordinary size are swept in sorted partitions with the state carried from batch to batch. Larger
    ones are cut into blocks: block end states, then one row per block carried along the stream, then
    the sweep of every block from its carried state. ``count`` names a column with the events that a row stands for; it
    comes back as ``COUNT`` beside the sums, so nobody has to join for it.
    """
    events = events.select("stream_id", "event_id", "t", *([F.col(count).cast("bigint").alias(COUNT)] if count else []))
    if blocked is None:
        blocked = has_hot_group(events, STREAM)
    schema = SCAN_SCHEMA + (f", {COUNT} bigint" if count else "")
    if blocked:
        return _blocked_scan(events, rates, weights, schema=schema)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, last_t, state, count = None, 0.0, np.zeros(rates.size), 0
        for pdf in batches:
            if pdf.empty:
                continue
            sid, t = pdf["stream_id"].to_numpy(), pdf["t"].to_numpy(float)
            gap = stream_gaps(sid, t, stream, last_t)
            sums, state = decayed_sums(gap, rates, weights, state, _counts(pdf))
            start = np.where(np.isinf(gap), np.arange(t.size), -1)
            start = np.maximum.accumulate(start)
            prior = np.arange(t.size) - start
            continued = start < 0
            prior[continued] = count + np.arange(t.size)[continued]
            stream, last_t, count = sid[-1], t[-1], int(prior[-1]) + 1
            yield pdf[["stream_id", "event_id", "t"]].assign(prior=prior.astype("int64"), sums=list(sums), **_counted(pdf))

    return (
        spread(events, "stream_id")
        .sortWithinPartitions("stream_id", *TIME_ORDER)
        .mapInPandas(sweep, schema)
    )


def packed_scan(events: DataFrame, kernels: Sequence[Kernel], *, integrated: bool = False) -> DataFrame:
    """The sums of large streams, a run of consecutive events in one row: times and sums (events x kernels) as bytes.

    ``first`` is the rank from 0 of the first event of the run. The event before it stands in front of it, for increments.
    """
    rates, weights = stack_kernels(kernels, integrated=integrated)
    most = max(1, min(PACKED_ROWS, PACKED_NUMBERS // len(kernels)))

    def pack(rows: pd.DataFrame, entry: pd.Series, t: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        first, lead = int(entry["before"]), int(entry["before"] > 0)
        if lead:
            t = np.concatenate([[entry["prev_t"]], t])
            sums = np.vstack([weights @ np.asarray(entry["prev_state"]), sums])
        runs = []
        for lo in range(lead, t.size, most):
            back = lo - min(lo, 1)
            part = slice(back, lo + most)
            runs.append((rows["stream_id"].iloc[0], first + lo - lead, lo - back, t[part].tobytes(), sums[part].tobytes()))
        return pd.DataFrame(runs, columns=["stream_id", "first", "lead", "t", "sums"])

    return _blocked_scan(events.select("stream_id", "event_id", "t"), rates, weights, pack, PACKED_SCHEMA)


def binned_scan(events: DataFrame, kernels: Sequence[Kernel], streams: DataFrame) -> DataFrame:
    """The sums of large streams as moments by bin (``functions.moments``): one row for each kernel and block of events.

    ``streams(stream_id, horizon, ...)`` has one row for each stream; its columns stand beside every row. ``mass`` is what
    the events of the block send on up to the horizon, per unit n. Only a slice of a block has its sums in memory. ``events``
    may be laid out already, with their ``BLOCK``.
    """
    rates, weights = stack_kernels(kernels)
    _, masses = stack_kernels(kernels, integrated=True)
    beside = [f.name for f in streams.schema if f.name != "stream_id"]

    def fold(rows: pd.DataFrame, entry: pd.Series, t: np.ndarray) -> pd.DataFrame:
        gap = stream_gaps(np.zeros(t.size), t)
        state = None
        if entry["before"]:
            gap[0], state = t[0] - entry["prev_t"], np.asarray(entry["prev_state"])
        found = [[] for _ in kernels]
        mass = np.zeros(len(kernels))
        for lo in range(0, t.size, FOLDED_ROWS):
            sums, state = decayed_sums(gap[lo : lo + FOLDED_ROWS], rates, weights, state)
            for k, own in enumerate(found):
                own.append(moments_by_bin(sums[:, k]))
            mass += (-np.expm1(-np.outer(entry["horizon"] - t[lo : lo + FOLDED_ROWS], rates))).sum(axis=0) @ masses.T
        merged = [merged_moments(own) for own in found]
        return pd.DataFrame(
            {
                "stream_id": rows["stream_id"].iloc[0],
                "kernel_idx": np.arange(len(kernels), dtype="int32"),
                "bins": [bins.tobytes() for bins, _ in merged],
                "moments": [moments.tobytes() for _, moments in merged],
                "mass": mass,
                **{c: entry[c] for c in beside},
            }
        )

    also = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in streams.schema if f.name != "stream_id")
    schema = f"stream_id string, kernel_idx int, bins binary, moments binary, mass double, {also}"
    rows = events.select("stream_id", "event_id", "t", *[c for c in events.columns if c == BLOCK])
    return _blocked_scan(rows, rates, weights, fold, schema, streams)


def _counts(rows: pd.DataFrame) -> np.ndarray | None:
    return rows[COUNT].to_numpy(float) if COUNT in rows else None


def _counted(rows: pd.DataFrame) -> dict[str, pd.Series]:
    return {COUNT: rows[COUNT]} if COUNT in rows else {}


def unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    """Times and sums of a packed run, with the event before it if it has one."""
    t = np.frombuffer(row.t)
    return t, np.frombuffer(row.sums).reshape(t.size, -1)


def _one_row_an_event(rows: pd.DataFrame, entry: pd.Series, t: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    prior = int(entry["before"]) + np.arange(t.size)
    return pd.DataFrame({"stream_id": rows["stream_id"], "event_id": rows["event_id"], "t": t, "prior": prior, "sums": list(sums), **_counted(rows)})


def _blocked_scan(
    events: DataFrame, rates: np.ndarray, weights: np.ndarray, shape=_one_row_an_event, schema: str = SCAN_SCHEMA,
    beside: DataFrame | None = None,
) -> DataFrame:
    """``shape`` gets the sums of a block; with ``beside``, a row a stream put beside what is carried, it works them out itself."""
    whole = beside is None
    most = min(SCAN_ROWS, max(1, SCAN_NUMBERS // len(weights))) if whole else SCAN_ROWS
    laid_out = events if BLOCK in events.columns else arrange(events, STREAM, TIME_ORDER, blocked=True, block_rows=most).df
    nothing = np.zeros((0, rates.size))

    def block_end(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME_ORDER)
        t = pdf["t"].to_numpy(float)
        gap = stream_gaps(np.zeros(t.size), t)
        _, state = decayed_sums(gap, rates, nothing, count=_counts(pdf))
        return pd.DataFrame(
            {
                "stream_id": [pdf["stream_id"].iloc[0]],
                BLOCK: [int(pdf[BLOCK].iloc[0])],
                "first_t": [t[0]],
                "last_t": [t[-1]],
                "n": [t.size],
                "state": [state],
            }
        )

    ends = laid_out.groupBy("stream_id", BLOCK).applyInPandas(
        block_end,
        f"stream_id string, {BLOCK} int, first_t double, last_t double, n bigint, state array<double>",
    )

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        entering, before, state, last_t, count = [], [], None, 0.0, 0
        prev_t, prev_state = [], []
        for row in pdf.itertuples(index=False):
            prev_t.append(last_t)
            prev_state.append(np.zeros(rates.size) if state is None else state)
            if state is None:
                at_first = np.zeros(rates.size)
            else:
                at_first = np.exp(-rates * (row.first_t - last_t)) * (state + 1.0)
            entering.append(at_first)
            before.append(count)
            state = np.asarray(row.state) + np.exp(-rates * (row.last_t - row.first_t)) * at_first
            last_t, count = row.last_t, count + row.n
        return pd.DataFrame(
            {
                "stream_id": pdf["stream_id"],
                BLOCK: pdf[BLOCK],
                "before": before,
                "entering": entering,
                "prev_t": prev_t,
                "prev_state": prev_state,
            }
        )

    carried = ends.groupBy("stream_id").applyInPandas(
        carry,
        f"stream_id string, {BLOCK} int, before bigint, entering array<double>, prev_t double, prev_state array<double>",
    )

    if not whole:
        carried = carried.join(F.broadcast(beside), STREAM)

    def finish(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(TIME_ORDER)
        t = rows["t"].to_numpy(float)
        if not whole:
            return shape(rows, entry.iloc[0], t)
        gap = stream_gaps(np.zeros(t.size), t)
        sums, _ = decayed_sums(gap, rates, weights, count=_counts(rows))
        at_first = np.asarray(entry["entering"].iloc[0])
        for lo in range(0, t.size, 8192):
            since = t[lo : lo + 8192] - t[0]
            sums[lo : lo + 8192] += np.exp(-np.outer(since, rates)) @ (weights * at_first).T
        return shape(rows, entry.iloc[0], t, sums)

    return (
        laid_out.groupBy("stream_id", BLOCK)
        .cogroup(carried.groupBy("stream_id", BLOCK))
        .applyInPandas(finish, schema)
    )


def self_excitation(
    events: DataFrame, kernels: Sequence[Kernel], *, blocked: bool | None = None
) -> DataFrame:
    """Events with ``prior`` and ``sums``: the excitation sum under each kernel, in their order."""
    return decay_scan(events, *stack_kernels(kernels), blocked=blocked)


def self_compensator(
    events: DataFrame, kernels: Sequence[Kernel], *, blocked: bool | None = None
) -> DataFrame:
    """Events with ``prior`` and ``sums``: expected offspring so far per unit n, under each kernel."""
    scanned = decay_scan(events, *stack_kernels(kernels, integrated=True), blocked=blocked)
    masses = F.array(*[F.lit(k.mass) for k in kernels])
    return scanned.withColumn(
        "sums", F.zip_with(masses, "sums", lambda m, q: m * F.col("prior") - q)
    )


def horizon_mass(events: DataFrame, streams: DataFrame, kernels: Sequence[Kernel]) -> DataFrame:
    """Expected offspring up to the horizon per unit n: ``(stream_id, kernel_idx, cc)``."""
    rates, weights = stack_kernels(kernels, integrated=True)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a batch holds many streams: all their events at once, one frame a batch
        for pdf in batches:
            place, names = pd.factorize(pdf["stream_id"])
            left = (pdf["horizon"] - pdf["t"]).to_numpy(float)
            each = -np.expm1(-np.outer(left, rates)) @ weights.T
            total = np.column_stack([np.bincount(place, each[:, k], names.size) for k in range(len(kernels))])
            yield pd.DataFrame(
                {
                    "stream_id": np.repeat(names.to_numpy(), len(kernels)),
                    "kernel_idx": np.tile(np.arange(len(kernels), dtype="int32"), names.size),
                    "cc": total.ravel(),
                }
            )

    rows = events.select("stream_id", "t").join(streams.select("stream_id", "horizon"), STREAM)
    return (
        rows.mapInPandas(partial, "stream_id string, kernel_idx int, cc double")
        .groupBy("stream_id", "kernel_idx")
        .agg(F.sum("cc").alias("cc"))
    )


def log_likelihood(
    events: DataFrame,
    streams: DataFrame,
    kernels: Sequence[Kernel],
    points: Sequence[tuple[float, float]],
    *,
    blocked: bool | None = None,
) -> DataFrame:
    """Log-likelihood of a constant baseline at every ``(mu, n)`` point, per stream and kernel.

    One aggregation over the events with a sum for every kernel and point, so neither rows nor what is shuffled
    grow with their number.
    """
    scanned = self_excitation(events, kernels, blocked=blocked)
    cells = [(k, float(mu), float(n)) for k in range(len(kernels)) for mu, n in points]
    sums = [F.sum(F.log(F.lit(mu) + F.lit(n) * F.get("sums", F.lit(k)))).alias(f"_{i}") for i, (k, mu, n) in enumerate(cells)]
    found = F.array(
        *[
            F.struct(F.lit(k).alias("kernel_idx"), F.lit(mu).alias("mu"), F.lit(n).alias("n"), F.col(f"_{i}").alias("_log"))
            for i, (k, mu, n) in enumerate(cells)
        ]
    )
    logs = scanned.groupBy("stream_id").agg(*sums).select("stream_id", F.inline(found))
    mass = horizon_mass(events, streams, kernels)
    return (
        logs.join(mass, ["stream_id", "kernel_idx"])
        .join(streams.select("stream_id", "horizon"), STREAM)
        .select(
            "stream_id",
            "kernel_idx",
            "mu",
            "n",
            (F.col("_log") - F.col("mu") * F.col("horizon") - F.col("n") * F.col("cc")).alias("ll"),
        )
    )


def baseline_likelihood(
    events: DataFrame,
    streams: DataFrame,
    parameters: DataFrame,
    kernel: Kernel,
    *,
    basis: str = "step",
    blocked: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood and gradient at given parameters of a step or piecewise-linear baseline.

    ``parameters(stream_id, k, edges, theta, n)``. Returns ``(stream_id, k, ll, grad_n)`` and
    ``(stream_id, k, param, grad)`` with one row per baseline parameter.
    """
    scanned = self_excitation(events, [kernel], blocked=blocked)
    rows = with_segment(scanned, parameters.select("stream_id", "k", "edges", "theta", "n"))
    s, seg = F.get("sums", F.lit(0)), F.col("seg").cast("int")
    w = F.coalesce("weight", F.lit(0.0))
    if basis == "step":
        level = F.get("theta", seg)
        parts = F.array(F.struct(seg.alias("param"), F.lit(1.0).alias("w")))
    else:
        level = (1.0 - w) * F.get("theta", seg) + w * F.get("theta", seg + 1)
        parts = F.array(
            F.struct(seg.alias("param"), (1.0 - w).alias("w")), F.struct((seg + 1).alias("param"), w.alias("w"))
        )
    rows = rows.select("stream_id", "k", "n", s.alias("s"), (level + F.col("n") * s).alias("lam"), parts.alias("parts"))
    sums = rows.groupBy("stream_id", "k").agg(
        F.sum(F.log("lam")).alias("_log"), F.sum(F.col("s") / F.col("lam")).alias("_gn")
    )
    by_param = rows.select("stream_id", "k", "lam", F.inline("parts")).groupBy("stream_id", "k", "param").agg(
        F.sum(F.col("w") / F.col("lam")).alias("_g")
    )
    pieces = parameters.select("stream_id", "k", "n", "edges", "theta").withColumn(
        "_len",
        F.transform(
            F.sequence(F.lit(0), F.size("edges") - 2), lambda i: F.get("edges", i + 1) - F.get("edges", i)
        ),
    )
    if basis == "step":
        cost = F.col("_len")
    else:
        padded = F.concat(F.array(F.lit(0.0)), "_len", F.array(F.lit(0.0)))
        cost = F.transform(
            F.sequence(F.lit(0), F.size("_len")), lambda i: 0.5 * (F.get(padded, i) + F.get(padded, i + 1))
        )
    pieces = pieces.withColumn("_cost", cost)
    area = F.aggregate(F.zip_with("theta", "_cost", lambda m, c: m * c), F.lit(0.0), lambda a, x: a + x)
    mass = horizon_mass(events, streams, [kernel]).select("stream_id", "cc")
    value = (
        sums.join(pieces, ["stream_id", "k"])
        .join(mass, STREAM)
        .select(
            "stream_id",
            "k",
            (F.col("_log") - area - F.col("n") * F.col("cc")).alias("ll"),
            (F.col("_gn") - F.col("cc")).alias("grad_n"),
        )
    )
    gradient = (
        pieces.select("stream_id", "k", F.posexplode("_cost").alias("param", "_c"))
        .join(by_param, ["stream_id", "k", "param"], "left")
        .select("stream_id", "k", "param", (F.coalesce("_g", F.lit(0.0)) - F.col("_c")).alias("grad"))
    )
    return value, gradient
