"""Summaries of replicate tables: coverage, error rates, magnitude and separation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.functions.columns import wilson_interval, with_binomial_upper
from ripplework.operators.sequence import arrange, group_quantiles

# fixed values of the rules
N_MATCH_TOLERANCE = 0.06
RESTORED_QUANTILE = 0.90
CEILING_N = 2.0
SEPARATION_QUANTILE = 0.95
SEPARATION_CAP = 1.125
SHARP_N, SHARP_GAIN = 1.175, 10.0
FLOOR_BREAK_RATE = 0.10
MIN_REFIT_EVENTS = 10


def coverage(fits: DataFrame) -> DataFrame:
    """Share of intervals holding the true value, median estimate and replicates, per cell.

    ``fits(cell, replicate, n_true, n_hat, lo, hi)``.
    """
    held = ((F.col("lo") <= F.col("n_true")) & (F.col("n_true") <= F.col("hi"))).cast("double")
    base = fits.groupBy("cell").agg(F.avg(held).alias("coverage"), F.count(F.lit(1)).alias("r"))
    return base.join(group_quantiles(fits, ["cell"], "n_hat", {"median_n": 0.5}), "cell")


def interval_agreement(pairs: DataFrame) -> DataFrame:
    """Mean end differences and overlap of two intervals per replicate: ``(cell, lo, hi, lo2, hi2)``."""
    overlap = F.greatest(F.lit(0.0), F.least("hi", "hi2") - F.greatest("lo", "lo2"))
    return pairs.groupBy("cell").agg(
        F.avg(F.abs(F.col("lo") - F.col("lo2"))).alias("mean_lo_diff"),
        F.avg(F.abs(F.col("hi") - F.col("hi2"))).alias("mean_hi_diff"),
        F.avg(overlap).alias("mean_overlap"),
        F.count(F.lit(1)).alias("r"),
    )


def refit_interval(refits: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval of refitted ``n`` over replicates with at least ten events."""
    a = (1.0 - level) / 2.0
    used = refits.where(F.col("n_events") >= MIN_REFIT_EVENTS)
    return group_quantiles(used, ["cell"], "n_hat", {"lo": a, "hi": 1.0 - a})


def false_migration(runs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Rate at which genuine streams are flagged, per regime and planted level, with its bounds.

    ``runs(regime, plant, seed, n_events, identified)``; ``targets(regime, target_n)`` adds the flag
    that the mean size is within 6% of the target.
    """
    per = runs.groupBy("regime", "plant").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(~F.col("identified")).alias("n_migrated"),
        F.avg("n_events").alias("mean_events"),
    )
    lo, hi = wilson_interval(F.col("n_migrated"), F.col("n_runs"))
    out = per.withColumns(
        {"rate": F.try_divide(F.col("n_migrated").cast("double"), F.col("n_runs")), "wilson_lo": lo, "wilson_hi": hi}
    )
    out = with_binomial_upper(out, "n_migrated", "n_runs", "upper95")
    if targets is not None:
        off = F.abs(F.col("mean_events") - F.col("target_n")) / F.col("target_n")
        out = out.join(targets, "regime", "left").withColumn("n_matched", off < N_MATCH_TOLERANCE)
    return out


def magnitude_rule(runs: DataFrame, markets: DataFrame) -> DataFrame:
    """Place each market's peak among the pooled peaks of genuine streams that were flagged.

    ``runs(peak, identified)``, ``markets(stream_id, peak)``. A market is restored above the 90th
    percentile, graded above the median, absent below.
    """
    pooled = runs.where(~F.col("identified")).select(F.lit(0).alias("pool"), F.col("peak").alias("_g"))
    cut = group_quantiles(pooled, ["pool"], "_g", {"median_peak": 0.5, "cut_peak": RESTORED_QUANTILE})
    ceiling = pooled.groupBy("pool").agg(F.avg((F.col("_g") >= CEILING_N).cast("double")).alias("ceiling_share"))
    rank = percentile_ranks(
        markets.select(F.lit(0).alias("pool"), F.col("peak").alias("value")),
        pooled.select("pool", F.col("_g").alias("x")),
        ["pool"],
    ).select(F.col("value").alias("peak"), "percentile")
    rank = markets.select("stream_id", "peak").join(rank, "peak", "left")
    limits = cut.join(ceiling, "pool").drop("pool")
    label = (
        F.when(F.col("peak") > F.col("cut_peak"), "restored")
        .when(F.col("peak") > F.col("median_peak"), "graded")
        .otherwise("absent")
    )
    return rank.join(F.broadcast(limits)).withColumn("label", label)  # one row of limits


def percentile_ranks(values: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """Mid-rank percentile of each distinct ``values(<keys>, value)`` in ``sample(<keys>, x)``.

    Both sides are merged into one value histogram and ranked by running counts, so no value meets
    the whole sample.
    """
    counted = sample.groupBy(*keys, F.col("x").alias("value")).agg(F.count(F.lit(1)).alias("_c"))
    asked = values.select(*keys, "value").distinct().withColumn("_asked", F.lit(1))
    merged = (
        counted.withColumn("_asked", F.lit(0))
        .unionByName(asked.withColumn("_c", F.lit(0).cast("bigint")))
        .groupBy(*keys, "value")
        .agg(F.sum("_c").alias("_c"), F.max("_asked").alias("_asked"))
    )
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = arrange(merged, keys, ["value"]).add(sums={"_cum": "_c"}).rows()
    share = (F.col("_cum") - 0.5 * F.col("_c")) * 100.0 / F.col("_n")
    return ranked.where("_asked = 1").join(totals, keys).select(*keys, "value", share.alias("percentile"))


def separation_rule(runs: DataFrame, markets: DataFrame) -> DataFrame:
    """Do flagged genuine peaks stay low while every migrating market peaks sharply.

    ``runs(peak)`` from the fine grid, ``markets(stream_id, n, sharpness)``.
    """
    high = runs.where(F.col("peak") > 1.0).select(F.lit(0).alias("pool"), "peak")
    cap = group_quantiles(high, ["pool"], "peak", {"genuine_q95": SEPARATION_QUANTILE}).drop("pool")
    sharp = (F.col("n") >= SHARP_N) & (F.col("sharpness") >= SHARP_GAIN)
    ok = (F.col("n") <= 1.0) | F.coalesce(sharp, F.lit(False))
    reals = markets.agg(F.every(ok).alias("markets_sharp"), F.count_if(~ok).alias("n_failing"))
    return reals.join(F.broadcast(cap), how="left").select(  # one row each
        "genuine_q95",
        "markets_sharp",
        "n_failing",
        F.when(
            F.coalesce(F.col("genuine_q95") <= SEPARATION_CAP, F.lit(False)) & F.col("markets_sharp"), "holds"
        ).otherwise("collapses").alias("verdict"),
    )


def rate_by_size(runs: DataFrame) -> DataFrame:
    """False-migration rate by planned size, with the verdict read at the largest size."""
    per = runs.groupBy("n_target").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(~F.col("identified")).alias("n_migrated"),
        F.avg("n_events").alias("mean_events"),
    )
    lo, hi = wilson_interval(F.col("n_migrated"), F.col("n_runs"))
    out = per.withColumns(
        {"rate": F.try_divide(F.col("n_migrated").cast("double"), F.col("n_runs")), "wilson_lo": lo, "wilson_hi": hi}
    )
    top = out.agg(F.max_by("rate", "n_target").alias("_rate"))
    label = F.when(F.col("_rate") < FLOOR_BREAK_RATE, "size_dependent").otherwise("intrinsic")
    return out.join(F.broadcast(top)).withColumn("verdict", label).drop("_rate")  # one row


def level_sweep(values: DataFrame) -> DataFrame:
    """Minimum, maximum and mean per level, and the mean against the mean of the other levels' means."""
    per = values.groupBy("level").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value")
    )
    whole = per.agg(F.sum("mean_value").alias("_sum"), F.count(F.lit(1)).alias("_levels"))
    others = F.try_divide(F.col("_sum") - F.col("mean_value"), F.col("_levels") - 1)
    return (
        per.join(F.broadcast(whole))  # one row
        .withColumn("ratio_to_others", F.try_divide(F.col("mean_value"), others))
        .drop("_sum", "_levels")
    )
