"""Size against duration: slopes, scaling residual, bootstraps, shuffles and profile collapse.

Works on ``cells(<keys>, size, duration, cnt)``, the cascades counted by size and duration, so that a
replicate costs as much as the number of distinct cells and never as much as the cascades.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.operators.sequence import arrange, group_quantiles
from ripplework.operators.tail import exponent_at, field, fit_tail, replicate_rng, value_histogram
from ripplework.session import checkpointed, spread

MIN_COUNT = 50
MIN_DURATIONS = 4
TAIL_QUANTILE = 0.80
CELLS_PER_CHUNK = 10_000
INTERVAL = (0.025, 0.975)
RESOLUTION_FACTOR = 2.0

# fixed values: correction forms of the slope fit, as expressions of T
CORRECTIONS = {
    "naive": None,
    "1/T": lambda t: 1.0 / t,
    "1/sqrtT": lambda t: 1.0 / F.sqrt(t),
    "1/T2": lambda t: 1.0 / (t * t),
    "logT/T": lambda t: F.log(t) / t,
}

# fixed values of the profile collapse
PROFILE_MIN_T, PROFILE_MIN_MEMBERS, PROFILE_POINTS = 5, 30, 20
COLLAPSE_GAMMAS = tuple(float(g) for g in np.linspace(1.4, 2.5, 23))
SPREAD_GAMMAS = tuple(float(g) for g in np.linspace(1.3, 2.6, 53))


def uncensored(cascades: DataFrame) -> DataFrame:
    if "censored" not in cascades.columns:
        return cascades
    return cascades.where(~F.coalesce("censored", F.lit(False)))


def cascade_cells(cascades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Uncensored cascades counted by size and duration."""
    return uncensored(cascades).groupBy(*keys, "size", "duration").agg(F.count(F.lit(1)).alias("cnt"))


def duration_means(cells: DataFrame, keys: Sequence[str], min_count: int = MIN_COUNT) -> DataFrame:
    """Mean size per duration with enough cascades: ``(<keys>, t, mean_size)``."""
    return (
        cells.groupBy(*keys, "duration")
        .agg(F.sum("cnt").alias("_n"), F.sum(F.col("size") * F.col("cnt")).alias("_s"))
        .where(F.col("_n") >= min_count)
        .select(*keys, F.col("duration").cast("double").alias("t"), (F.col("_s") / F.col("_n")).alias("mean_size"))
    )


def _least_squares(means: DataFrame, keys: Sequence[str], form: str) -> DataFrame:
    """Coefficients of ``ln mean = a + g ln t (+ b * correction)`` from sums, by Cramer's rule."""
    correction = CORRECTIONS[form]
    x, y = F.log("t"), F.log("mean_size")
    z = correction(F.col("t")) if correction else F.lit(0.0)
    rows = means.withColumns({"_x": x, "_y": y, "_z": z})
    names = {
        "n": F.count(F.lit(1)).cast("double"),
        "x": F.sum("_x"),
        "z": F.sum("_z"),
        "y": F.sum("_y"),
        "xx": F.sum(F.col("_x") * F.col("_x")),
        "xz": F.sum(F.col("_x") * F.col("_z")),
        "zz": F.sum(F.col("_z") * F.col("_z")),
        "xy": F.sum(F.col("_x") * F.col("_y")),
        "zy": F.sum(F.col("_z") * F.col("_y")),
    }
    sums = rows.groupBy(*keys).agg(*[v.alias(f"_s_{k}") for k, v in names.items()])
    s = {k: F.col(f"_s_{k}") for k in names}
    if correction is None:
        det = s["n"] * s["xx"] - s["x"] * s["x"]
        g = F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], det)
        a = F.try_divide(s["y"] - g * s["x"], s["n"])
        b = F.lit(0.0)
    else:
        # centred second moments keep the 2 x 2 system well scaled
        cxx, czz = s["xx"] - s["x"] * s["x"] / s["n"], s["zz"] - s["z"] * s["z"] / s["n"]
        cxz = s["xz"] - s["x"] * s["z"] / s["n"]
        cxy, czy = s["xy"] - s["x"] * s["y"] / s["n"], s["zy"] - s["z"] * s["y"] / s["n"]
        det = cxx * czz - cxz * cxz
        g = F.try_divide(cxy * czz - czy * cxz, det)
        b = F.try_divide(cxx * czy - cxz * cxy, det)
        a = (s["y"] - g * s["x"] - b * s["z"]) / s["n"]
    return sums.select(*keys, s["n"].alias("n_points"), a.alias("a"), g.alias("g"), b.alias("b"))


def curvature_slope(cells: DataFrame, keys: Sequence[str], min_count: int = MIN_COUNT) -> DataFrame:
    """``g`` of ``ln<S> = a + g ln T + b / T``; NULL below four usable durations."""
    fit = _least_squares(duration_means(cells, keys, min_count), keys, "1/T")
    return fit.select(*keys, F.when(F.col("n_points") >= MIN_DURATIONS, F.col("g")).alias("inv_snz"))


def binned_slope(cells: DataFrame, keys: Sequence[str], min_count: int = MIN_COUNT) -> DataFrame:
    means = duration_means(cells, keys, min_count)
    return means.groupBy(*keys).agg(F.regr_slope(F.log("mean_size"), F.log("t")).alias("binned_slope"))


def tail_slope(
    cells: DataFrame, keys: Sequence[str], q: float = TAIL_QUANTILE, *, blocked: bool | None = None
) -> DataFrame:
    """Slope of ``ln S`` on ``ln T`` over cascades from the ``q`` quantile of durations up."""
    cut = group_quantiles(cells, keys, "duration", {"_cut": q}, cnt="cnt", blocked=blocked)
    rows = cells.join(cut, list(keys)).where(F.col("duration") >= F.col("_cut"))
    x, y, c = F.log("duration"), F.log("size"), F.col("cnt")
    sums = rows.groupBy(*keys).agg(
        F.sum(c).cast("double").alias("_n"),
        F.sum(c * x).alias("_x"),
        F.sum(c * y).alias("_y"),
        F.sum(c * x * x).alias("_xx"),
        F.sum(c * x * y).alias("_xy"),
    )
    n, sx, sy = F.col("_n"), F.col("_x"), F.col("_y")
    # the determinant of one repeated duration is zero up to rounding
    det = n * F.col("_xx") - sx * sx
    slope = F.when(det > 1e-9 * n * F.col("_xx"), (n * F.col("_xy") - sx * sy) / det)
    return sums.select(*keys, F.when(n >= MIN_COUNT, slope).alias("tail_slope"))


def correction_forms(cells: DataFrame, keys: Sequence[str], min_count: int = MIN_COUNT) -> DataFrame:
    """Slope and AIC of every correction form, the form with the smallest AIC marked."""
    keys = list(keys)
    means = checkpointed(duration_means(cells, keys, min_count))
    out = None
    for form, correction in CORRECTIONS.items():
        fit = _least_squares(means, keys, form)
        z = correction(F.col("t")) if correction else F.lit(0.0)
        left = F.log("mean_size") - F.col("a") - F.col("g") * F.log("t") - F.col("b") * z
        p = 2 if correction is None else 3
        rss = means.join(fit, keys).groupBy(*keys, "g", "n_points").agg(F.sum(left * left).alias("_rss"))
        scored = rss.where(F.col("n_points") >= MIN_DURATIONS).select(
            *keys,
            F.lit(form).alias("form"),
            F.col("g").alias("slope"),
            (F.col("n_points") * F.log(F.greatest(F.col("_rss"), F.lit(1e-300)) / F.col("n_points")) + 2.0 * p).alias("aic"),
        )
        out = scored if out is None else out.unionByName(scored)
    best = out.groupBy(*keys).agg(F.min_by("form", F.struct("aic", "form")).alias("_best"))
    return out.join(best, keys).withColumn("is_best", F.col("form") == F.col("_best")).drop("_best")


def scaling_residual(tau: Column, alpha: Column, inv_snz: Column) -> Column:
    """``(alpha - 1) / (tau - 1) - 1/snz``; NULL when tau is 1 or a part is missing."""
    return F.try_divide(alpha - 1.0, tau - 1.0) - inv_snz


def exponents(
    cells: DataFrame,
    keys: Sequence[str],
    *,
    size_threshold: DataFrame | None = None,
    duration_threshold: DataFrame | None = None,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """``tau``, ``alpha``, ``inv_snz`` and the residual per set; parts that a set does not define are NULL.

    A threshold table ``(<keys>, xmin)`` fixes where a tail starts instead of searching for it.
    """
    keys = list(keys)
    cells = checkpointed(cells)  # one row per (size, duration), read three times

    def exponent(column: str, thresholds: DataFrame | None, name: str) -> DataFrame:
        hist = value_histogram(cells, keys, column, "cnt")
        fit = fit_tail(hist, keys) if thresholds is None else exponent_at(hist, keys, thresholds)
        return fit.select(*keys, F.col("alpha").alias(name), F.col("xmin").alias(f"xmin_{name}"))

    # every set keeps its row, also one whose sizes or durations are all equal
    out = (
        cells.select(*keys).distinct()
        .join(exponent("size", size_threshold, "tau"), keys, "left")
        .join(exponent("duration", duration_threshold, "alpha"), keys, "left")
        .join(curvature_slope(cells, keys, min_count), keys, "left")
    )
    return out.withColumn("delta", scaling_residual(F.col("tau"), F.col("alpha"), F.col("inv_snz")))


def tail_arm(
    cells: DataFrame, keys: Sequence[str], verdict: DataFrame, *, min_count: int = MIN_COUNT
) -> DataFrame:
    """Size verdict with the scaling columns; undefined parts are NULL.

    Fewer than two distinct sizes leave everything NULL and not passing; fewer than two distinct
    durations keep the size verdict alone.
    """
    keys = list(keys)
    cells = checkpointed(cells)
    spread = cells.groupBy(*keys).agg(F.countDistinct("duration").alias("_nd"))
    usable = cells.join(spread.where("_nd >= 2").select(*keys), keys, "left_semi")
    durations = fit_tail(value_histogram(usable, keys, "duration", "cnt"), keys)
    joined = (
        verdict.select(*keys, "passes", F.col("alpha").alias("tau"), "p_boot")
        .join(durations.select(*keys, F.col("alpha").alias("alpha")), keys, "left")
        .join(curvature_slope(usable, keys, min_count), keys, "left")
    )
    alpha = F.when(F.col("tau").isNotNull(), F.col("alpha"))
    inv = F.when(F.col("tau").isNotNull(), F.col("inv_snz"))
    return joined.withColumns({"alpha": alpha, "inv_snz": inv}).withColumn(
        "delta", scaling_residual(F.col("tau"), F.col("alpha"), F.col("inv_snz"))
    )


def resample_cells(cells: DataFrame, keys: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """``replicates`` draws with replacement of all cascades of a set, as counted cells.

    Drawing ``n`` cascades with replacement is one multinomial draw over the cells. It is taken in two
    steps, over chunks of cells and then inside each chunk, so no task needs all cells of a set.
    """
    keys = list(keys)
    # a stable chunk from the cell itself; one chunk holds about CELLS_PER_CHUNK cells
    per_set = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    chunked = cells.join(per_set, keys).withColumn(
        "_chunk", F.pmod(F.xxhash64("size", "duration"), F.ceil(F.col("_cells") / F.lit(CELLS_PER_CHUNK)))
    )
    packed = chunked.groupBy(*keys, "_chunk").agg(
        F.sum("cnt").alias("_n"),
        F.array_sort(F.collect_list(F.struct("size", "duration", "cnt"))).alias("_cells"),
    )
    totals = packed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_n"))).alias("_chunks")
    )
    plan = totals.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select(
        *keys, "replicate",
        F.transform("_chunks", lambda x: x["_chunk"]).alias("_ids"),
        F.transform("_chunks", lambda x: x["_n"]).alias("_sizes"),
    )
    types = dict(cells.select(*keys).dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def split(parts):
        for pdf in parts:
            for row in pdf.to_dict("records"):
                rng = replicate_rng(seed, "chunks", *(row[k] for k in keys), row["replicate"])
                sizes = np.asarray(row["_sizes"], float)
                drawn = rng.multinomial(int(sizes.sum()), sizes / sizes.sum())
                part = pd.DataFrame({"_chunk": np.asarray(row["_ids"], "int64"), "_draws": drawn})
                for k in keys:
                    part[k] = row[k]
                yield part.assign(replicate=row["replicate"])[[*keys, "replicate", "_chunk", "_draws"]]

    shares = spread(plan, *keys, "replicate").mapInPandas(
        split, f"{head}, replicate int, _chunk bigint, _draws bigint"
    )
    work = shares.where("_draws > 0").join(
        packed.select(
            *keys, "_chunk",
            *[F.transform("_cells", field(f)).alias(f"_{f}") for f in ("size", "duration", "cnt")],
        ),
        [*keys, "_chunk"],
    )

    def fill(parts):
        for pdf in parts:
            for row in pdf.to_dict("records"):
                rng = replicate_rng(seed, "cells", *(row[k] for k in keys), row["replicate"], row["_chunk"])
                weight = np.asarray(row["_cnt"], float)
                drawn = rng.multinomial(int(row["_draws"]), weight / weight.sum())
                part = pd.DataFrame({"size": row["_size"], "duration": row["_duration"], "cnt": drawn})
                for k in keys:
                    part[k] = row[k]
                yield part[part["cnt"] > 0].assign(replicate=row["replicate"])[
                    [*keys, "replicate", "size", "duration", "cnt"]
                ]

    return spread(work, *keys, "replicate", "_chunk").mapInPandas(
        fill, f"{head}, replicate int, size bigint, duration bigint, cnt bigint"
    )


def residual_replicates(
    cells: DataFrame,
    keys: Sequence[str],
    replicates: int,
    seed: int = 0,
    *,
    fixed_threshold: bool = False,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """Residual of every bootstrap replicate, with the curvature slope and with the tail slope.

    ``fixed_threshold`` keeps the thresholds of the full data instead of searching in each replicate.
    """
    keys = list(keys)
    cells = checkpointed(cells)
    drawn = checkpointed(resample_cells(cells, keys, replicates, seed))
    by = [*keys, "replicate"]
    options = {"min_count": min_count}
    if fixed_threshold:
        for column, name in (("size", "size_threshold"), ("duration", "duration_threshold")):
            fit = fit_tail(value_histogram(cells, keys, column, "cnt"), keys).select(*keys, "xmin")
            options[name] = fit.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    exps = exponents(drawn, by, **options)
    both = exps.join(tail_slope(drawn, by), by, "left")
    return both.withColumn(
        "delta_tail", scaling_residual(F.col("tau"), F.col("alpha"), F.col("tail_slope"))
    )


def leave_out_residuals(cells: DataFrame, keys: Sequence[str], group: str, groups: int, **options) -> DataFrame:
    """``delta`` of every set with one group of its cells left out at a time: ``(<keys>, replicate, delta)``.

    ``cells(<keys>, group, size, duration, cnt)`` with groups from 0 to ``groups - 1``; a replicate bears the number of
    the group it lacks. Cells are counted before they are repeated, so the work grows with them and not with cascades.
    A set keeps a row for each replicate that has any cell.
    """
    keys = list(keys)
    lacking = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("replicate")
    rest = cells.select("*", lacking).where(F.col("replicate") != F.col(group))
    rest = rest.groupBy(*keys, "replicate", "size", "duration").agg(F.sum("cnt").alias("cnt"))
    return exponents(rest, [*keys, "replicate"], **options).select(*keys, "replicate", "delta")


def replicate_interval(residuals: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """Mean, 95% interval, half-width and the number of undefined replicates."""
    keys = list(keys)
    base = residuals.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.count_if(F.col(value).isNull()).alias("n_undefined"),
        F.count(F.lit(1)).alias("n_replicates"),
    )
    ends = group_quantiles(residuals, keys, value, {"lo": INTERVAL[0], "hi": INTERVAL[1]})
    return base.join(ends, keys, "left").withColumn("halfwidth", (F.col("hi") - F.col("lo")) / 2.0)


def corroboration(intervals: DataFrame, resolution: Column | None = None, k: float = RESOLUTION_FACTOR) -> DataFrame:
    """``not-grossly-violated`` when the mean residual is within ``k`` resolutions of zero."""
    res = F.col("halfwidth") if resolution is None else resolution
    label = F.when(F.abs("mean") <= k * res, "not-grossly-violated").otherwise("grossly-violated")
    return intervals.withColumn("label", label)


def _draw_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def shuffle_pairing(
    cascades: DataFrame, keys: Sequence[str], fraction: float = 1.0, seed: int = 0, *, blocked: bool | None = None
) -> DataFrame:
    """Permute durations against sizes among a drawn fraction of cascades; marginals stay the same."""
    keys = list(keys)
    rows = uncensored(cascades).select(*keys, "cascade_id", "size", "duration")
    rows = rows.withColumns(
        {"_pick": _draw_order(seed, *keys, "cascade_id"), "_mix": _draw_order(seed + 1, *keys, "cascade_id")}
    )
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = arrange(rows, keys, ["_pick", "cascade_id"], blocked=blocked).add(rn="_r").rows()
    ranked = ranked.join(counts, keys)
    share = F.lit(min(1.0, max(0.0, float(fraction))))
    drawn = F.col("_r") <= F.floor(share * F.col("_n"))
    chosen, rest = ranked.where(drawn), ranked.where(~drawn)
    mixed = arrange(chosen.select(*keys, "cascade_id", "duration", "_mix"), keys, ["_mix", "cascade_id"], blocked=blocked)
    mixed = mixed.add(rn="_r").rows().select(*keys, "_r", F.col("duration").alias("_new"))
    swapped = chosen.join(mixed, [*keys, "_r"]).select(*keys, "cascade_id", "size", F.col("_new").alias("duration"))
    return swapped.unionByName(rest.select(*keys, "cascade_id", "size", "duration"))


def seed_resolution(residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample SD over seeds and the resolution ``2 sqrt(2) SD``."""
    return residuals.groupBy(*keys).agg(
        F.avg("delta").alias("mean_delta"),
        F.stddev_samp("delta").alias("sd_seed"),
        (2.0 * F.sqrt(F.lit(2.0)) * F.stddev_samp("delta")).alias("resolution"),
    )


def violation_table(violations: DataFrame, resolution: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean violation per fraction against the resolution of the same set."""
    keys = list(keys)
    mean = violations.groupBy(*keys, "fraction").agg(F.avg("violation").alias("mean_violation"))
    return mean.join(resolution, keys).withColumn("resolved", F.col("mean_violation") > F.col("resolution"))


def referenced_interval(test: DataFrame, reference: DataFrame, value: str = "delta", *, all_pairs: bool = False) -> DataFrame:
    """Interval of test minus reference over replicates, and whether it contains zero.

    Replicates are paired by number. ``all_pairs`` takes every test against every reference replicate
    of the set instead, which does not understate the width; both sides hold one row per replicate.
    """
    a = test.select("set_id", "replicate", F.col(value).alias("_a"))
    b = reference.select("replicate", F.col(value).alias("_b"))
    if all_pairs:
        packed = b.agg(F.collect_list("_b").alias("_all"))  # as many numbers as replicates
        pairs = a.join(F.broadcast(packed)).select("set_id", "_a", F.explode("_all").alias("_b"))
    else:
        pairs = a.join(b, "replicate")
    diffs = pairs.withColumn("diff", F.col("_a") - F.col("_b"))
    ends = group_quantiles(diffs, ["set_id"], "diff", {"lo": INTERVAL[0], "hi": INTERVAL[1]})
    return ends.withColumn("contains_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0))


def estimator_table(cells: DataFrame, keys: Sequence[str], min_count: int = MIN_COUNT) -> DataFrame:
    """Exponent ratio, three slope estimates and their residuals per set."""
    keys = list(keys)
    cells = checkpointed(cells)
    exps = exponents(cells, keys, min_count=min_count)
    ratio = F.try_divide(F.col("alpha") - 1.0, F.col("tau") - 1.0)
    n = cells.groupBy(*keys).agg(F.sum("cnt").alias("n_cascades"))
    return (
        n.join(exps, keys)
        .join(tail_slope(cells, keys), keys, "left")
        .join(binned_slope(cells, keys, min_count), keys, "left")
        .withColumn("ratio", ratio)
        .withColumns(
            {
                "delta_tail": F.col("ratio") - F.col("tail_slope"),
                "delta_binned": F.col("ratio") - F.col("binned_slope"),
            }
        )
    )


# ---- average profiles ---------------------------------------------------------------------------


def cascade_profiles(with_depth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population per generation of every cascade, with the cascade's duration."""
    keys = list(keys)
    by = [*keys, F.col("root_idx").alias("cascade_id")]
    counts = with_depth.groupBy(*by, F.col("depth").alias("generation")).agg(F.count(F.lit(1)).alias("population"))
    durations = counts.groupBy(*keys, "cascade_id").agg(F.max("generation").alias("duration"))
    return counts.join(durations, [*keys, "cascade_id"])


def mean_profiles(
    profiles: DataFrame,
    keys: Sequence[str],
    *,
    min_t: int = PROFILE_MIN_T,
    min_members: int = PROFILE_MIN_MEMBERS,
    points: int = PROFILE_POINTS,
) -> DataFrame:
    """Mean profile per duration, interpolated to ``points`` places between start and end."""
    keys = list(keys)
    long = profiles.where(F.col("duration") >= min_t)
    # every cascade of duration T has exactly one row per generation
    means = long.groupBy(*keys, "duration", "generation").agg(
        F.avg("population").alias("_p"), F.count(F.lit(1)).alias("_m")
    ).where(F.col("_m") >= min_members)
    frame = means.select(*keys, "duration").distinct().withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    at = F.col("point") * (F.col("duration") - 1) / F.lit(float(points - 1))
    frame = frame.withColumns({"_at": at, "_low": F.floor(at).cast("bigint") + 1})
    low = means.select(*keys, "duration", F.col("generation").alias("_low"), F.col("_p").alias("_p0"))
    high = means.select(*keys, "duration", (F.col("generation") - 1).alias("_low"), F.col("_p").alias("_p1"))
    by = [*keys, "duration", "_low"]
    part = F.col("_at") - F.floor("_at")
    return frame.join(low, by).join(high, by, "left").select(
        *keys,
        F.col("duration").cast("bigint").alias("duration"),
        F.col("point").cast("bigint").alias("point"),
        (F.col("_p0") + part * (F.coalesce("_p1", "_p0") - F.col("_p0"))).alias("height"),
    )


def collapse_exponent(
    means: DataFrame, keys: Sequence[str], gammas: Sequence[float] = COLLAPSE_GAMMAS, objective: str = "relative"
) -> DataFrame:
    """Exponent under which the profiles differ least, first on ties; NULL below four durations.

    ``relative`` averages variance over squared mean per point, ``standard`` divides their averages.
    """
    keys = list(keys)
    grid = F.explode(F.array(*[F.lit(float(g)) for g in gammas])).alias("gamma")
    scaled = means.select(*keys, "duration", "point", "height", grid).withColumn(
        "_h", F.col("height") / F.pow(F.col("duration").cast("double"), F.col("gamma") - 1.0)
    )
    points = scaled.groupBy(*keys, "gamma", "point").agg(
        F.avg("_h").alias("_m"), F.var_pop("_h").alias("_v"), F.count(F.lit(1)).alias("_k")
    )
    if objective == "relative":
        error = F.avg(F.col("_v") / (F.col("_m") * F.col("_m") + 1e-12))
    else:
        error = F.avg("_v") / (F.avg("_m") * F.avg("_m") + 1e-12)
    scored = points.groupBy(*keys, "gamma").agg(error.alias("_e"), F.max("_k").alias("_k"))
    return scored.groupBy(*keys).agg(
        F.when(F.max("_k") >= MIN_DURATIONS, F.min_by("gamma", F.struct("_e", "gamma"))).alias("gamma")
    )


def profile_exponents(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Standard-spread collapse, peak-height slope plus one, and area slope."""
    keys = list(keys)
    shape = means.groupBy(*keys, "duration").agg(
        F.max("height").alias("_peak"), F.sum("height").alias("_sum"), F.count(F.lit(1)).alias("_k")
    )
    lt = F.log("duration")
    area = F.col("_sum") * F.col("duration") / (F.col("_k") - 1)
    slopes = shape.groupBy(*keys).agg(
        (F.regr_slope(F.log("_peak"), lt) + 1.0).alias("peak_exponent"),
        F.regr_slope(F.log(area), lt).alias("area_exponent"),
    )
    spread = collapse_exponent(means, keys, SPREAD_GAMMAS, "standard")
    return slopes.join(spread.withColumnRenamed("gamma", "spread_exponent"), keys)
