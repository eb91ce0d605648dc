"""Goodness of fit by time rescaling, and the granularity diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.functions.concave import segment_places
from ripplework.functions.kernels import Kernel, exponential, fine_power_law
from ripplework.operators.excite import COUNT, PACKED_GROUP, decay_scan, packed_scan, self_compensator, stack_kernels, unpacked
from ripplework.operators.fit import FIT_MAX_ROWS, FIT_MAX_ROWS_KEY, fit_exponential
from ripplework.operators.sequence import arrange, has_hot_group
from ripplework.operators.shape import STREAM, TIME_ORDER, quantize, tie_fraction
from ripplework.session import checkpointed, checkpointed_wide


def baseline_integral(t: Column, edges: Column, theta: Column, basis: str) -> Column:
    """Integral of a step or piecewise-linear baseline from 0 to ``t``; a handful of terms per row."""
    seg = F.sequence(F.lit(0), F.size(edges) - 2)

    def piece(i: Column) -> Column:
        lo, hi = F.get(edges, i), F.get(edges, i + 1)
        last = i == F.size(edges) - 2
        covered = F.greatest(F.when(last, t - lo).otherwise(F.least(t, hi) - lo), F.lit(0.0))
        if basis == "step":
            return F.get(theta, i) * covered
        at_lo, at_hi = F.get(theta, i), F.get(theta, i + 1)
        rise = F.coalesce(F.try_divide(at_hi - at_lo, hi - lo), F.lit(0.0))
        return covered * (at_lo + 0.5 * rise * covered)

    return F.aggregate(F.transform(seg, piece), F.lit(0.0), lambda a, x: a + x)


def baseline_area(t: np.ndarray, edges: np.ndarray, theta: np.ndarray, basis: str) -> np.ndarray:
    """``baseline_integral`` for arrays."""
    length = np.diff(edges)
    seg, _ = segment_places(t, edges)
    covered = np.maximum(t - edges[seg], 0.0)
    if basis == "step":
        return np.concatenate([[0.0], np.cumsum(theta * length)])[seg] + theta[seg] * covered
    rise = np.divide(np.diff(theta), length, out=np.zeros(length.size), where=length != 0)
    before = np.concatenate([[0.0], np.cumsum(length * (theta[:-1] + 0.5 * rise * length))])
    return before[seg] + covered * (theta[seg] + 0.5 * rise[seg] * covered)


def compensator(
    events: DataFrame,
    fits: DataFrame,
    kernels: Sequence[Kernel],
    *,
    basis: str = "step",
    extra: Sequence[str] = (),
    blocked: bool | None = None,
) -> DataFrame:
    """Expected events up to each event under each fit: ``Lambda``, and its increments ``dl``.

    ``fits`` carries ``stream_id, kernel_idx, n, theta, edges`` and the ``extra`` columns that tell
    several fits of a stream apart.
    """
    if blocked is None:
        blocked = has_hot_group(events, STREAM)
    scanned = self_compensator(events, kernels, blocked=blocked)
    keys = [*extra, "kernel_idx"]
    rows = scanned.join(fits.select("stream_id", *keys, "n", "theta", "edges"), STREAM)
    own = F.get("sums", F.col("kernel_idx"))
    value = F.col("n") * own + baseline_integral(F.col("t"), F.col("edges"), F.col("theta"), basis)
    rows = rows.select("stream_id", *keys, "event_id", "t", value.alias("Lambda"))
    seq = arrange(rows, ["stream_id", *keys], TIME_ORDER, blocked=blocked).add(lags={"_prev": "Lambda"})
    return seq.rows().withColumn("dl", F.col("Lambda") - F.col("_prev")).drop("_prev")


def ks_unit_exponential(
    increments: DataFrame, keys: Sequence[str], *, blocked: bool | None = None
) -> DataFrame:
    """Largest distance of the increments' distribution from Exp(1); NULL below two increments."""
    keys = list(keys)
    rows = increments.where(F.col("dl").isNotNull()).select(*keys, "event_id", "dl")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_increments"))
    ranked = arrange(rows, keys, ["dl", "event_id"], blocked=blocked).add(rn="_r").rows().join(counts, keys)
    n, f = F.col("n_increments"), -F.expm1(-F.col("dl"))
    gap = F.greatest(F.col("_r") / n - f, f - (F.col("_r") - 1) / n)
    out = ranked.groupBy(*keys).agg(
        F.first("n_increments").alias("n_increments"), F.max(gap).alias("_d")
    )
    return out.withColumn("ks", F.when(F.col("n_increments") >= 2, F.col("_d"))).drop("_d")


def kolmogorov_p(ks: Column, n: Column, terms: int = 101) -> Column:
    """Asymptotic p-value by the Kolmogorov series (Stephens' small-sample argument)."""
    root = F.sqrt(n.cast("double"))
    x = (root + 0.12 + 0.11 / root) * ks
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda a, j: a + F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))


def ks_of_fits(
    events: DataFrame,
    fits: DataFrame,
    shapes: Sequence[tuple[float, float]],
    *,
    basis: str = "step",
    extra: Sequence[str] = (),
    blocked: bool | None = None,
) -> DataFrame:
    """KS distance of every fit under the exact power-law compensator of its shape.

    Streams above ``spark.ripplework.fit.maxRows`` stay packed: their increments are counted in bins, and only those of
    bins that may hold the distance become rows.
    """
    kernels = [fine_power_law(e, c) for e, c in shapes]
    if blocked is not None:
        lam = compensator(events, fits, kernels, basis=basis, extra=extra, blocked=blocked)
        return ks_unit_exponential(lam, ["stream_id", *extra, "kernel_idx"], blocked=blocked)
    most = int(events.sparkSession.conf.get(FIT_MAX_ROWS_KEY, str(FIT_MAX_ROWS)))
    sizes = checkpointed(events.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("stream_id"))
    if sizes.isEmpty():
        return ks_of_fits(events, fits, shapes, basis=basis, extra=extra, blocked=has_hot_group(events, STREAM))
    small = events.join(sizes, STREAM, "left_anti")
    found = ks_of_fits(small, fits, shapes, basis=basis, extra=extra, blocked=has_hot_group(small, STREAM))
    return found.unionByName(_ks_of_large(events.join(sizes, STREAM, "left_semi"), fits.join(sizes, STREAM, "left_semi"), kernels, basis, extra))


def _ks_of_large(events: DataFrame, fits: DataFrame, kernels: Sequence[Kernel], basis: str, extra: Sequence[str]) -> DataFrame:
    """``ks_of_fits`` of packed streams, exact.

    Counts by bin give the distribution at every bin's smallest and largest value, and so what the distance is at least
    and at most inside a bin. Only the values of bins that could hold more than is known are ranked.
    """
    mass = np.array([k.mass for k in kernels])
    keys = [*extra, "kernel_idx"]
    # one entry for each fit of a stream
    packed = fits.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct(*keys, "n", "theta", "edges"))).alias("_fits"))
    packed = checkpointed(packed)
    named = packed.select("stream_id", F.posexplode("_fits").alias("fit", "_f")).select(
        "stream_id", "fit", *[F.col("_f")[c].alias(c) for c in keys]
    )
    columns = [F.col("_fits")[c].alias(f"own_{c}") for c in ("kernel_idx", "n", "theta", "edges")]
    own = packed.select("stream_id", *columns)
    design = checkpointed_wide(packed_scan(events, kernels, integrated=True), PACKED_GROUP)

    def distribution(row) -> Iterator[tuple[int, np.ndarray]]:
        """For every fit the unit-exponential distribution function at the increments of a run."""
        t, q = unpacked(row)
        prior = row.first - row.lead + np.arange(t.size)
        for fit, (kernel, n, theta, edges) in enumerate(zip(row.own_kernel_idx, row.own_n, row.own_theta, row.own_edges)):
            grown = baseline_area(t, np.asarray(edges, float), np.asarray(theta, float), basis)
            grown += n * (mass[kernel] * prior - q[:, kernel])
            yield fit, -np.expm1(-np.diff(grown))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for fit, f in distribution(row):
                    f = np.sort(f)
                    bins, at, count = np.unique(_bin_of(f), return_index=True, return_counts=True)
                    lo, hi = f[at], f[at + count - 1]
                    yield pd.DataFrame({"stream_id": row.stream_id, "fit": fit, "bin": bins, "cnt": count, "lo": lo, "hi": hi})

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                wanted, bins = np.asarray(row.fits), np.asarray(row.bins)
                for fit, f in distribution(row):
                    at = _bin_of(f)
                    held = np.isin(at, bins[wanted == fit])
                    yield pd.DataFrame({"stream_id": row.stream_id, "fit": fit, "bin": at[held], "f": f[held]})

    by_fit = ["stream_id", "fit"]
    hist = design.join(F.broadcast(own), STREAM).mapInPandas(
        counted, "stream_id string, fit int, bin bigint, cnt bigint, lo double, hi double"
    )
    hist = hist.groupBy(*by_fit, "bin").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # some thousand bins a fit
    order = Window.partitionBy(*by_fit).orderBy("bin")
    hist = checkpointed(
        hist.withColumns({"_end": F.sum("cnt").over(order), "_all": F.sum("cnt").over(Window.partitionBy(*by_fit))})
        .withColumn("_before", F.col("_end") - F.col("cnt"))
    )
    above, below = F.col("_end") / F.col("_all"), F.col("_before") / F.col("_all")
    least = hist.groupBy(*by_fit).agg(
        F.first("_all").alias("n_increments"), F.max(F.greatest(above - F.col("hi"), F.col("lo") - below)).alias("_least")
    )
    most = F.greatest(above - F.col("lo"), F.col("hi") - below)
    open_bins = checkpointed(hist.join(least, by_fit).where(most > F.col("_least")).select(*by_fit, "bin", "_before", "_all"))
    lists = open_bins.groupBy("stream_id").agg(F.collect_list(F.struct("fit", "bin")).alias("_o"))
    lists = lists.select("stream_id", F.col("_o.fit").alias("fits"), F.col("_o.bin").alias("bins"))
    values = design.join(F.broadcast(own.join(lists, STREAM)), STREAM).mapInPandas(chosen, "stream_id string, fit int, bin bigint, f double")
    rank = F.row_number().over(Window.partitionBy(*by_fit, "bin").orderBy("f"))
    ranked = values.withColumn("_r", rank).join(F.broadcast(open_bins), [*by_fit, "bin"])
    place, f = F.col("_before") + F.col("_r"), F.col("f")
    inside = ranked.groupBy(*by_fit).agg(F.max(F.greatest(place / F.col("_all") - f, f - (place - 1) / F.col("_all"))).alias("_d"))
    ks = F.when(F.col("n_increments") >= 2, F.greatest("_least", "_d"))
    return named.join(least, by_fit).join(inside, by_fit, "left").select("stream_id", *keys, "n_increments", ks.alias("ks"))


def _bin_of(f: np.ndarray) -> np.ndarray:
    """Bins that rise with the value: 2,048 from 0 to 1; below the first of them 64 to every halving."""
    small = (np.maximum(f, 0.0) + 0.0).view("int64") >> 46
    edge = int(np.float64(1 / 2048).view("int64") >> 46)
    even = edge + np.floor(np.nan_to_num(f) * 2048).astype("int64")
    bins = np.where(f < 1 / 2048, small, even)
    return np.where(np.isnan(f), np.int64(2**40), np.where(f < 0, np.int64(-1), bins))


def exponential_residuals(
    events: DataFrame, fits: DataFrame, *, blocked: bool | None = None
) -> DataFrame:
    """``Lambda = mu t + n (prior - R)`` and increments for each stream's own decay rate.

    Times are scaled by the stream's rate, so that one unit-rate sweep serves all streams.
    """
    if blocked is None:
        blocked = has_hot_group(events, STREAM)
    scale = fits.select("stream_id", "mu", "n", "beta")
    scaled = events.join(scale, STREAM).withColumn("t", F.col("t") * F.col("beta"))
    scanned = decay_scan(scaled, *stack_kernels([exponential(1.0)]), blocked=blocked)
    rows = scanned.join(scale, STREAM).select(
        "stream_id",
        "event_id",
        (F.col("t") / F.col("beta")).alias("t"),
        (
            F.col("mu") * F.col("t") / F.col("beta")
            + F.col("n") * (F.col("prior") - F.get("sums", F.lit(0)))
        ).alias("Lambda"),
    )
    seq = arrange(rows, STREAM, TIME_ORDER, blocked=blocked).add(lags={"_prev": "Lambda"})
    return seq.rows().withColumn("dl", F.col("Lambda") - F.col("_prev")).drop("_prev")


P_FLAG = 0.10


def calibrated_p(observed: DataFrame, nulls: DataFrame, p_flag: float = P_FLAG) -> DataFrame:
    """``(1 + #{null >= observed}) / (1 + usable)`` per market; NULL when it could not reach ``p_flag``."""
    counted = (
        nulls.join(observed.select("stream_id", F.col("ks").alias("_d")), STREAM)
        .groupBy(*STREAM)
        .agg(
            F.count_if(F.col("d").isNotNull()).alias("b_eff"),
            F.count_if(F.col("d") >= F.col("_d")).alias("_ge"),
        )
    )
    needed = math.ceil(1.0 / p_flag)
    p = F.when(
        (F.col("b_eff") >= needed) & F.col("ks").isNotNull(), (1 + F.col("_ge")) / (1 + F.col("b_eff"))
    )
    return (
        observed.join(counted, STREAM, "left")
        .withColumn("b_eff", F.coalesce("b_eff", F.lit(0)).cast("bigint"))
        .withColumn("p_boot", p)
        .withColumn("passed", F.coalesce(F.col("p_boot") >= p_flag, F.lit(False)))
        .drop("_ge")
    )


def _binned_rows(events: DataFrame, streams: DataFrame, grid: float, beta: float) -> DataFrame:
    """``_binned_rates`` for one decay rate."""
    return _binned_rates(events, streams, grid, [beta]).drop("beta")


def _binned_rates(events: DataFrame, streams: DataFrame, grid: float, betas: Sequence[float]) -> DataFrame:
    """Occupied bins with their count and, for every rate, the cross-bin excitation they see and the mass they send on.

    Excitation decays from bin centres. Empty bins have no log term; their share of the integral is
    in ``later``, the geometric sum of what a bin contributes to all bins after it. Events are counted once and only bins swept.
    """
    width = F.lit(float(grid))
    nb = streams.select("stream_id", F.ceil(F.col("horizon") / width).cast("bigint").alias("n_bins"))
    bin_of = F.least(F.floor(F.col("t") / width), F.col("n_bins") - 1)
    counts = events.join(nb, STREAM).groupBy("stream_id", bin_of.alias("event_id")).agg(F.count(F.lit(1)).alias("cnt"))
    counts = checkpointed(counts.withColumn("t", F.col("event_id") * width))
    scanned = decay_scan(counts, *stack_kernels([exponential(b) for b in betas]), count="cnt")
    # a bin sees the bins before it; its count comes along, as a table of counts packs so well that joining it could broadcast it
    seen = scanned.select("stream_id", F.round(F.col("t") / width).cast("bigint").alias("bin"), "sums", F.col(COUNT).alias("cnt"))
    rows = seen.join(nb, STREAM)

    def at(i: int, beta: float) -> Column:
        decay, half = math.exp(-beta * grid), math.exp(-0.5 * beta * grid)
        excited = F.get("sums", F.lit(i)) * F.lit(half / decay / beta) * F.lit(1.0 - decay)
        later = F.lit(half) * (1.0 - F.pow(F.lit(decay), F.col("n_bins") - 1 - F.col("bin")))
        return F.struct(F.lit(float(beta)).alias("beta"), excited.alias("excited"), later.alias("later"))

    return rows.select("stream_id", "bin", "cnt", "n_bins", F.inline(F.array(*[at(i, b) for i, b in enumerate(betas)])))


def binned_likelihood(
    events: DataFrame, streams: DataFrame, grid: float, beta: float, points: Sequence[tuple[float, float]]
) -> DataFrame:
    """Poisson likelihood of bin counts with cross-bin excitation only (biased high by design)."""
    pts = F.array(*[F.struct(F.lit(float(m)).alias("mu"), F.lit(float(n)).alias("n")) for m, n in points])
    rows = _binned_rows(events, streams, grid, beta).withColumn("p", F.explode(pts))
    lam = F.col("p.mu") * F.lit(float(grid)) + F.col("p.n") * F.col("excited")
    sums = rows.groupBy("stream_id", "p.mu", "p.n", "n_bins").agg(
        F.sum(F.col("cnt") * F.log(lam)).alias("_log"), F.sum(F.col("cnt") * F.col("later")).alias("_later")
    )
    ll = F.col("_log") - F.col("mu") * F.lit(float(grid)) * F.col("n_bins") - F.col("n") * F.col("_later")
    return sums.select("stream_id", "mu", "n", ll.alias("ll"))


BINNED_N_GRID = tuple(round(0.02 * i, 2) for i in range(0, 76))


def binned_fit(
    events: DataFrame,
    streams: DataFrame,
    grid: float,
    betas: Sequence[float],
    ns: Sequence[float] = BINNED_N_GRID,
) -> DataFrame:
    """Best ``n`` of the binned likelihood over a grid; ``mu`` follows from the total count.

    At the best baseline for a given ``n`` expected and observed counts agree, which leaves one
    parameter to search.
    """
    rows = checkpointed(_binned_rates(events, streams, grid, list(dict.fromkeys(betas))))
    keys = ["stream_id", "beta"]
    totals = rows.groupBy(*keys).agg(F.sum("cnt").alias("_all"), F.sum(F.col("cnt") * F.col("later")).alias("_later"))
    level = [(F.col("_all") - F.lit(float(n)) * F.col("_later")) / F.col("n_bins") for n in ns]
    sums = [F.sum(F.col("cnt") * F.log(mu + F.lit(float(n)) * F.col("excited"))) for n, mu in zip(ns, level, strict=True)]
    # one sum for every n in one row a stream and rate; the baseline is the same for all rows of a stream
    summed = rows.join(totals, keys).groupBy(*keys).agg(
        F.first("_all").alias("_all"),
        *[f.alias(f"_ll{i}") for i, f in enumerate(sums)],
        *[F.first(mu).alias(f"_mu{i}") for i, mu in enumerate(level)],
    )
    cells = [
        F.struct(F.lit(float(n)).alias("n"), F.col(f"_mu{i}").alias("_mu"), (F.col(f"_ll{i}") - F.col("_all")).alias("ll"))
        for i, n in enumerate(ns)
    ]
    scored = summed.select(*keys, F.inline(F.array(*cells))).where(F.col("_mu") > 0)
    pick = F.min_by(F.struct("n", "beta", "ll"), F.struct(-F.col("ll"), F.col("n"), F.col("beta")))
    return scored.groupBy("stream_id").agg(pick.alias("b")).select("stream_id", "b.*")


def granularity_probe(
    events: DataFrame, streams: DataFrame, grid: float, betas: Sequence[float], **options
) -> DataFrame:
    """Ties created by a grid and how far it moves the exponential-kernel estimate of ``n``.

    ``diff`` compares the fit on floored times with the fit on full times, ``diff_binned`` the fit on
    bin counts; both are bias diagnostics.
    """
    floored = events.withColumn("t", quantize(F.col("t"), grid))
    full = fit_exponential(events, streams, **options)
    coarse = fit_exponential(floored, streams, **options)
    binned = binned_fit(events, streams, grid, betas)
    return (
        full.select("stream_id", "n_events", F.col("n").alias("n_full"))
        .join(coarse.select("stream_id", F.col("n").alias("n_grid")), STREAM)
        .join(binned.select("stream_id", F.col("n").alias("n_binned")), STREAM)
        .join(tie_fraction(floored), STREAM)
        .withColumns(
            {
                "diff": F.col("n_grid") - F.col("n_full"),
                "diff_binned": F.col("n_binned") - F.col("n_full"),
            }
        )
    )
