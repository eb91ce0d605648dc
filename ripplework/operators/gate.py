"""Near-critical gate: where the likelihood peaks in ``n`` as heavier-tailed shapes are admitted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplework.operators.fit import likelihood_grid
from ripplework.operators.shape import STREAM

# fixed values of the gate
EPS_CUTOFFS = (0.4, 0.2, 0.1, 0.05, 0.02)
CLOSED, OPEN = 0.4, 0.02
MIGRATE_TOLERANCE = 0.15
N_CAP = 1.0
SHALLOW_SPAN, FLAT_SPAN = 2.0, 10.0
BOUNDARY_N, BOUNDARY_EPS = 1.0, 0.1
RECOVERY_TOLERANCE = 0.15
SHARPNESS_REFERENCE = 1.05
STABILITY_TOLERANCE = 0.05


def profile(ll: DataFrame, eps_min: float | None = None, n_cap: float | None = None) -> DataFrame:
    """Best likelihood per ``n`` over admitted shapes, with the shape reaching it.

    Equal likelihoods go to the larger eps, then the larger c.
    """
    rows = ll
    if eps_min is not None:
        rows = rows.where(F.col("eps") >= eps_min)
    if n_cap is not None:
        rows = rows.where(F.col("n") < n_cap)
    best = F.max(F.struct("ll", "eps", "c"))
    return rows.groupBy(*STREAM, "n").agg(best.alias("b")).select("stream_id", "n", "b.ll", "b.eps", "b.c")


def peak(prof: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` of the highest profile value, the smallest one on ties, with its shape."""
    pick = F.min_by(F.struct("n", "ll", "eps", "c"), F.struct(-F.col("ll"), F.col("n")))
    return prof.groupBy(*STREAM, *by).agg(pick.alias("b")).select("stream_id", *by, "b.*")


def trajectory(ll: DataFrame, cutoffs: Sequence[float] = EPS_CUTOFFS, n_cap: float | None = None) -> DataFrame:
    """Peak at every shape cutoff: ``(stream_id, eps_min, n, ll, eps, c)``."""
    rows = ll if n_cap is None else ll.where(F.col("n") < n_cap)
    opened = rows.withColumn("eps_min", F.explode(F.array(*[F.lit(float(e)) for e in cutoffs])))
    opened = opened.where(F.col("eps") >= F.col("eps_min"))
    best = F.max(F.struct("ll", "eps", "c"))
    prof = opened.groupBy(*STREAM, "eps_min", "n").agg(best.alias("b"))
    return peak(prof.select("stream_id", "eps_min", "n", "b.ll", "b.eps", "b.c"), ["eps_min"])


def gate_verdict(ll: DataFrame, cutoffs: Sequence[float] = EPS_CUTOFFS) -> DataFrame:
    """One row per stream: peaks closed and open, migration, the capped peak and the verdict."""
    free, capped = trajectory(ll, cutoffs), trajectory(ll, cutoffs, N_CAP)

    def at(cut: float):
        return F.max(F.when(F.col("eps_min") == cut, F.col("n")))

    wide = free.groupBy(*STREAM).agg(at(CLOSED).alias("peak_closed"), at(OPEN).alias("peak"))
    below = capped.groupBy(*STREAM).agg(at(OPEN).alias("peak_capped"))
    moved = F.col("peak") - F.col("peak_closed")
    return (
        wide.join(below, STREAM)
        .withColumn("migrated", moved)
        .withColumn("identified", (F.abs(moved) < MIGRATE_TOLERANCE) & (F.col("peak") < N_CAP))
    )


def certify_near_critical(events: DataFrame, streams: DataFrame, **options) -> DataFrame:
    """The gate over all streams in one job; ``options`` go to ``likelihood_grid``."""
    return gate_verdict(likelihood_grid(events, streams, **options))


def profile_shape(ll: DataFrame, lo: float = 0.30, hi: float = 0.90) -> DataFrame:
    """Span of the profile on ``[lo, hi]`` and whether its maximum is interior."""
    prof = profile(ll)
    span = prof.groupBy(*STREAM).agg(
        (
            F.max(F.when(F.col("n").between(lo, hi), F.col("ll")))
            - F.min(F.when(F.col("n").between(lo, hi), F.col("ll")))
        ).alias("span")
    )
    place = F.when(
        (F.col("n") >= BOUNDARY_N) | (F.col("eps") <= BOUNDARY_EPS), "boundary"
    ).otherwise("interior")
    return (
        peak(prof)
        .join(span, STREAM)
        .withColumn("curvature", F.when(F.col("span") < SHALLOW_SPAN, "shallow").otherwise("curved"))
        .withColumn("place", place)
    )


def peak_sharpness(ll: DataFrame) -> DataFrame:
    """Peak of the profile and its height above ``n = 1.05``; NULL where that ``n`` is not in the grid."""
    prof = profile(ll)
    near = F.abs(F.col("n") - SHARPNESS_REFERENCE) < 1e-9
    reference = prof.groupBy(*STREAM).agg(F.max(F.when(near, F.col("ll"))).alias("_ref"))
    return peak(prof).join(reference, STREAM).select("stream_id", "n", (F.col("ll") - F.col("_ref")).alias("sharpness"))


def profile_sharpness(ll_coarse: DataFrame, ll_fine: DataFrame) -> DataFrame:
    """Peak, its height above ``n = 1.05`` and whether a finer shape grid moves it."""
    fine = peak(profile(ll_fine)).select("stream_id", F.col("n").alias("n_fine"))
    stable = F.abs(F.col("n") - F.col("n_fine")) < STABILITY_TOLERANCE
    return peak_sharpness(ll_coarse).join(fine, STREAM).select("stream_id", "n", "n_fine", "sharpness", stable.alias("stable"))


def recovery_shape(ll: DataFrame, truth: DataFrame) -> DataFrame:
    """Flat, boundary or interior profile, and whether a known ``n_true`` is recovered."""
    prof = profile(ll)
    ends = prof.groupBy(*STREAM).agg(
        (F.max("ll") - F.min("ll")).alias("span"), F.max("n").alias("_top")
    )
    shape = (
        F.when(F.col("span") < FLAT_SPAN, "flat")
        .when(F.col("n") == F.col("_top"), "boundary")
        .otherwise("interior")
    )
    hit = (F.abs(F.col("n") - F.col("n_true")) <= RECOVERY_TOLERANCE) & (F.col("shape") == "interior")
    return (
        peak(prof)
        .join(ends, STREAM)
        .join(truth, STREAM)
        .withColumn("shape", shape)
        .withColumn("recovered", hit)
        .drop("_top")
    )


PLATEAU_STEP = 0.03
GOOD_FIT_FACTOR = 2.0


def segment_sweep(fits: DataFrame, ks_distance: DataFrame) -> DataFrame:
    """Fits over segment counts: criteria choices, plateau start and fit quality, one row per (stream, k).

    The plateau starts at the ``k`` before the first step that moves ``n`` by less than 0.03.
    """
    w = Window.partitionBy("stream_id").orderBy("k")  # one row per segment count
    rows = fits.join(ks_distance, ["stream_id", "k"], "left")
    step = F.abs(F.lead("n").over(w) - F.col("n"))
    rows = rows.withColumn("_flat", step < PLATEAU_STEP)
    per_stream = rows.groupBy(*STREAM).agg(
        F.min_by("k", F.struct("bic", "k")).alias("k_bic"),
        F.min_by("k", F.struct("aic", "k")).alias("k_aic"),
        F.min(F.when(F.col("_flat"), F.col("k"))).alias("plateau_k"),
    )
    good = 1.0 / F.sqrt(F.col("n_events").cast("double"))
    return (
        rows.drop("_flat")
        .join(per_stream, STREAM)
        .withColumns(
            {
                "in_plateau": F.coalesce(F.col("k_bic") >= F.col("plateau_k"), F.lit(False)),
                "fit_ok": F.col("ks") < GOOD_FIT_FACTOR * good,
                "ks_ratio": F.col("ks") / good,
            }
        )
    )


def best_shape(fits: DataFrame) -> DataFrame:
    """Shape with the smallest KS distance, the one with the highest likelihood, and the range of ``n``.

    ``fits(stream_id, eps, c, n, ll, ks, n_events)``. Distances equal to 9 digits and likelihoods equal to 6 are ties
    (at ``n = 0`` all shapes are the same model); they go to the smaller eps, then the smaller c.
    """
    by_ks = F.min_by(F.struct("eps", "c", "n", "ks"), F.struct(F.round("ks", 9), "eps", "c")).alias("_k")
    by_ll = F.min_by(F.struct("eps", "c", "n", "ll"), F.struct(-F.round("ll", 6), F.col("eps"), F.col("c"))).alias("_l")
    ratio = F.col("_k.ks") * F.sqrt(F.col("_n").cast("double"))
    return (
        fits.groupBy(*STREAM)
        .agg(by_ks, by_ll, F.first("n_events").alias("_n"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
        .select(
            "stream_id",
            F.col("_k.eps").alias("eps_ks"), F.col("_k.c").alias("c_ks"),
            F.col("_k.n").alias("n_ks"), F.col("_k.ks").alias("ks"),
            F.col("_l.eps").alias("eps_ll"), F.col("_l.c").alias("c_ll"), F.col("_l.n").alias("n_ll"),
            "n_min", "n_max",
            ratio.alias("ks_ratio"),
            (ratio < GOOD_FIT_FACTOR).alias("good_fit"),
        )
    )


def smallest_recovered(runs: DataFrame, by: str, tolerance: float = RECOVERY_TOLERANCE) -> DataFrame:
    """Smallest size at which most seeds recover the planted ``n``, per level of ``by``.

    ``runs(<by>, n_target, seed, n_true, peak)``.
    """
    hit = F.abs(F.col("peak") - F.col("n_true")) <= tolerance
    per_size = runs.groupBy(by, "n_target").agg(
        F.count_if(hit).alias("recovered"), F.count(F.lit(1)).alias("seeds")
    )
    majority = F.col("recovered") >= F.floor(F.col("seeds") / 2) + 1
    return per_size.groupBy(by).agg(F.min(F.when(majority, F.col("n_target"))).alias("floor_n"))
