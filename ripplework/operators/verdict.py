"""Market verdicts, instrument and control reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.functions.kernels import Kernel, power_law
from ripplework.operators.cascades import (
    generative_branching,
    reply_tree_cascades,
    structural_branching,
    trajectory_variance,
)
from ripplework.operators.fit import SHAPE_C, SHAPE_EPS, fit_constant
from ripplework.operators.gate import certify_near_critical
from ripplework.operators.scaling import (
    cascade_cells,
    corroboration,
    exponents,
    replicate_interval,
    residual_replicates,
    tail_arm,
)
from ripplework.operators.shape import STREAM, burstiness, fano_profile, first_events, stream_spans
from ripplework.operators.tail import tail_verdict, value_histogram

# fixed values of the capture overview
EVENT_FLOOR = 16_000
MIN_FIT_EVENTS = 400
NEAR_CRITICAL_N = 0.8
BACKSTOP_HOURS = 7 * 24.0


def market_overview(
    counts: DataFrame,
    fits: DataFrame,
    elapsed_hours: Column,
    *,
    floor: int = EVENT_FLOOR,
) -> DataFrame:
    """Events, sustained rate, provisional ``n``, flags and hours to the event floor.

    ``counts(stream_id, n_events)``; ``fits(stream_id, n)`` holds the markets worth fitting.
    """
    rows = counts.join(fits.select("stream_id", F.col("n").alias("n_hat")), STREAM, "left")
    rate = F.try_divide(F.col("n_events").cast("double"), elapsed_hours)
    over = F.col("n_events") >= floor
    to_floor = F.when(over, F.lit(0.0)).otherwise(F.try_divide(floor - F.col("n_events"), rate))
    critical = F.coalesce(F.col("n_hat") > NEAR_CRITICAL_N, F.lit(False))
    soon = F.coalesce(to_floor < BACKSTOP_HOURS, F.lit(False))
    return rows.withColumns(
        {
            "rate_per_hour": rate,
            "over_floor": over,
            "near_critical": critical,
            "hours_to_floor": to_floor,
            "on_track": critical & (over | soon),
        }
    )


def overview_totals(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.count(F.lit(1)).alias("n_markets"),
        F.count_if("over_floor").alias("n_over"),
        F.count_if("near_critical").alias("n_critical"),
        F.count_if("on_track").alias("n_on_track"),
    )


def top_markets(overview: DataFrame, k: int = 15) -> DataFrame:
    return overview.orderBy(F.desc("n_events"), F.asc("stream_id")).limit(k)


def provisional_fits(
    events: DataFrame, streams: DataFrame, *, min_events: int = MIN_FIT_EVENTS, kernel: Kernel | None = None, **options
) -> DataFrame:
    """``n`` of the markets with enough events, under the assumed shape."""
    kernel = kernel or power_law(SHAPE_EPS, SHAPE_C)
    return fit_constant(events, streams, kernel, min_events=min_events, **options)


def market_verdict(
    counts: DataFrame, fits: DataFrame, gof: DataFrame, probe: DataFrame, *, min_events: int
) -> DataFrame:
    """``insufficient_events``, ``inconclusive``, ``flagged_shape_misfit`` or ``certified``.

    ``counts(stream_id, n_events, horizon)``, ``fits(stream_id, mu, n)``, ``gof`` from
    ``calibrated_p`` and ``probe(stream_id, diff)``; the probe is read for certified markets only.
    """
    rows = (
        counts.select("stream_id", "n_events", "horizon")
        .join(fits.select("stream_id", "mu", "n"), STREAM, "left")
        .join(gof.select("stream_id", "ks", "p_boot", "b_eff", "passed"), STREAM, "left")
        .join(probe.select("stream_id", "diff"), STREAM, "left")
    )
    few = (F.col("n_events") < min_events) | (F.col("horizon") <= 0)
    status = (
        F.when(few, "insufficient_events")
        .when(F.col("p_boot").isNull(), "inconclusive")
        .when(~F.col("passed"), "flagged_shape_misfit")
        .otherwise("certified")
    )
    hidden = {c: F.when(~few, F.col(c)) for c in ("mu", "n", "ks", "p_boot", "b_eff")}
    return (
        rows.withColumn("status", status)
        .withColumns(hidden)
        .withColumn("diff", F.when(F.col("status") == "certified", F.col("diff")))
        .drop("passed")
    )


def pass_rate(verdicts: DataFrame, clean: DataFrame) -> DataFrame:
    """Share of fitted markets that admit the assumed shape, with the stream check beside it."""
    rows = verdicts.where(F.col("status") != "insufficient_events").join(
        clean.select("stream_id", "clean"), STREAM, "left"
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n_markets"),
        F.count_if(F.col("status") == "certified").alias("n_passed"),
        F.count_if(F.col("status") == "flagged_shape_misfit").alias("n_flagged"),
        F.count_if(F.col("status") == "inconclusive").alias("n_inconclusive"),
        F.count_if(F.coalesce("clean", F.lit(False))).alias("n_clean"),
        F.try_divide(F.count_if(F.col("status") == "certified"), F.count(F.lit(1))).alias("pass_rate"),
    )


def read_against_baseline(gates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Gate verdicts beside the frozen false-migration rate of their regime (NULL when unknown)."""
    return gates.join(baseline, STREAM, "left")


def counts_agree(runs: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Do two backends give the same mean event count, within ``tolerance`` standard errors.

    ``runs(backend, n_events)`` with two backends.
    """
    per = runs.groupBy("backend").agg(
        F.avg("n_events").alias("_m"),
        (F.var_samp("n_events") / F.count(F.lit(1))).alias("_v"),
    )
    both = per.agg(
        F.min_by("_m", "backend").alias("mean_a"),
        F.max_by("_m", "backend").alias("mean_b"),
        F.sqrt(F.sum("_v")).alias("se"),
    )
    return both.withColumn("agree", F.abs(F.col("mean_a") - F.col("mean_b")) <= tolerance * F.col("se"))


def instrument_report(
    cascades: DataFrame, *, replicates: int = 40, seed: int = 0, min_count: int = 50
) -> DataFrame:
    """Tail and scaling verdict per cell of ``cascades(cell, role, cascade_id, size, duration)``.

    Role ``tail`` cells are judged on the tail with its bootstrap, ``scaling`` cells on the residual;
    for the latter the tail verdict without bootstrap is reported for information.
    """
    keys = ["cell"]
    roles = cascades.select("cell", "role").distinct()
    cells = cascade_cells(cascades, ["cell", "role"])
    tail = cells.where(F.col("role") == "tail").drop("role")
    scale = cells.where(F.col("role") == "scaling").drop("role")
    judged = tail_verdict(value_histogram(tail, keys, "size", "cnt"), keys, replicates=replicates, seed=seed)
    informed = tail_verdict(value_histogram(scale, keys, "size", "cnt"), keys)
    point = exponents(scale, keys, min_count=min_count)
    spread = replicate_interval(
        residual_replicates(scale, keys, replicates, seed, min_count=min_count), keys
    )
    label = corroboration(spread).select("cell", "mean", "halfwidth", "n_undefined", "label")
    tails = judged.unionByName(informed).select("cell", "passes", F.col("alpha").alias("tau_tail"))
    return (
        roles.join(tails, keys, "left")
        .join(point.select("cell", "tau", "alpha", "inv_snz"), keys, "left")
        .join(label, keys, "left")
        .select(
            "cell", "role", "passes", F.coalesce("tau", "tau_tail").alias("tau"), "alpha", "inv_snz",
            F.col("mean").alias("delta_mean"), F.col("halfwidth").alias("resolution"), "n_undefined", "label",
        )
    )


def report_passes(report: DataFrame, agreement: DataFrame, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """Overall pass: every ``(cell, outcome)`` in ``expected`` holds and the backends agree.

    Outcomes are ``passes``, ``rejected`` and the residual labels.
    """
    outcome = F.when(F.col("role") == "scaling", F.col("label")).otherwise(
        F.when(F.col("passes"), "passes").otherwise("rejected")
    )
    wanted = F.create_map(*[F.lit(x) for pair in expected for x in pair])
    held = report.withColumn("_ok", outcome == wanted[F.col("cell")]).agg(
        (F.count_if("_ok") == len(expected)).alias("cells_hold")
    )
    return held.join(F.broadcast(agreement)).select(  # one row each
        "cells_hold", "agree", (F.col("cells_hold") & F.col("agree")).alias("passed")
    )


def run_record(
    labeled: DataFrame,
    counters: DataFrame,
    trajectory: DataFrame,
    *,
    n_match: int,
    replicates: int = 0,
    min_count: int = 50,
    ll_options: dict | None = None,
) -> DataFrame:
    """One row per stream: gate on the first ``n_match`` events, everything else on the full stream."""
    events = labeled.select("stream_id", F.col("idx").alias("event_id"), "t")
    matched = first_events(events, n_match)
    gate = certify_near_critical(matched, stream_spans(matched), **(ll_options or {}))
    cascades = reply_tree_cascades(labeled)
    cells = cascade_cells(cascades, STREAM)
    tail = tail_verdict(value_histogram(cells, STREAM, "size", "cnt"), STREAM, replicates=replicates)
    arm = tail_arm(cells, STREAM, tail, min_count=min_count)
    totals = stream_spans(events)
    return (
        totals.select("stream_id", F.least(F.col("n_events"), F.lit(n_match)).alias("n_events"))
        .join(gate, STREAM, "left")
        .join(arm, STREAM, "left")
        .join(structural_branching(cascades), STREAM, "left")
        .join(generative_branching(totals, counters), STREAM, "left")
        .join(trajectory_variance(trajectory), STREAM, "left")
    )


COMPARED = (
    "tau", "alpha", "inv_snz", "delta", "n_struct", "n_tree", "burstiness", "fano_short", "fano_long",
    "peak", "migrated",
)


def control_columns(
    labeled: DataFrame, records: DataFrame, windows: tuple[float, float]
) -> DataFrame:
    """Long form ``(stream_id, column, value)`` of everything the two arms are compared on."""
    events = labeled.select("stream_id", F.col("idx").alias("event_id"), "t")
    spans = stream_spans(events)
    fano = fano_profile(events, spans, windows).groupBy(*STREAM).agg(
        F.min_by("fano", "window_size").alias("fano_short"),
        F.max_by("fano", "window_size").alias("fano_long"),
    )
    rows = records.join(burstiness(events).drop("n_events"), STREAM, "left").join(fano, STREAM, "left")
    return rows.unpivot(
        "stream_id", [F.col(c).cast("double").alias(c) for c in COMPARED], "column", "value"
    )


def control_comparison(
    long_rows: DataFrame, subject: str, null: str, *, strict: bool = True
) -> DataFrame:
    """Subject beside null per column; a null with any edge or success fails when strict."""
    wide = long_rows.groupBy("column").pivot("stream_id", [subject, null]).agg(F.first("value"))
    wide = wide.select("column", F.col(subject).alias("subject"), F.col(null).alias("null_arm"))
    if not strict:
        return wide
    must_be_zero = F.col("column").isin("n_struct", "n_tree") & (F.coalesce("null_arm", F.lit(0.0)) != 0.0)
    guarded = F.when(
        must_be_zero, F.raise_error(F.lit("the null arm has edges or successes")).cast("double")
    ).otherwise(F.col("null_arm"))
    return wide.withColumn("null_arm", guarded)
