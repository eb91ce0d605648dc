"""Discrete power-law tails: threshold scan, alternatives, bootstrap, verdict.

Everything works on value histograms ``hist(<keys>, value, cnt)``. For cascade sizes the number of
distinct values is at most ``sqrt(2 * events)``, because distinct sizes must add up to the events.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.functions.tails import draw_tail, likelihood_ratios, tail_distance
from ripplework.operators.sequence import arrange, has_hot_group
from ripplework.session import checkpointed, spread

ALTERNATIVES = ("lognormal", "exponential", "truncated_power_law")
CHUNK = 4096
DRAWS_PER_BATCH = 1_000_000

# fixed values of the pass rule
P_BOOT_FLOOR = 0.10
P_RATIO_CUT = 0.05


def field(name: str, kind: str | None = None):
    """A function that takes one field out of a struct, for use inside ``transform``."""
    if kind is None:
        return lambda x: x[name]
    return lambda x: x[name].cast(kind)


def value_histogram(rows: DataFrame, keys: Sequence[str], value: str, cnt: str | None = None) -> DataFrame:
    weight = F.sum(cnt) if cnt else F.count(F.lit(1))
    return (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("bigint").alias("value"))
        .agg(weight.cast("bigint").alias("cnt"))
    )


def exponent_at(hist: DataFrame, keys: Sequence[str], thresholds: DataFrame) -> DataFrame:
    """``1 + n / sum(ln(x / (xmin - 1/2)))`` over ``x >= xmin`` for given thresholds."""
    tail = hist.join(thresholds, list(keys)).where(F.col("value") >= F.col("xmin"))
    logs = F.sum(F.col("cnt") * F.log(F.col("value") / (F.col("xmin") - 0.5)))
    return tail.groupBy(*keys, "xmin").agg(
        F.sum("cnt").alias("n_tail"), (1.0 + F.sum("cnt") / logs).alias("alpha")
    )


def threshold_candidates(hist: DataFrame, keys: Sequence[str], *, blocked: bool | None = None) -> DataFrame:
    """Every distinct value with its rank, the count at or above it and the exponent from there."""
    weighted = hist.withColumn("_log", F.col("cnt") * F.log("value"))
    if blocked is None:
        blocked = has_hot_group(hist, keys)
    seq = arrange(weighted, keys, ["value"], blocked=blocked)
    ranked = seq.add(rn="rank", sums={"_cum": "cnt", "_cumlog": "_log"}).rows()
    totals = weighted.groupBy(*keys).agg(
        F.sum("cnt").alias("n"), F.sum("_log").alias("_log_all"), F.max("value").alias("_top")
    )
    n_ge = F.col("n") - F.col("_cum") + F.col("cnt")
    logs = F.col("_log_all") - F.col("_cumlog") + F.col("_log")
    base = ranked.join(totals, list(keys)).withColumns({"n_ge": n_ge, "_logs": logs})
    spread = F.col("_logs") - F.col("n_ge") * F.log(F.col("value") - 0.5)
    return base.select(
        *keys,
        "rank",
        "value",
        "n",
        "n_ge",
        # the largest value leaves nothing to compare, so it is no candidate
        F.when(F.col("value") < F.col("_top"), 1.0 + F.col("n_ge") / spread).alias("alpha"),
    )


def threshold_scan(hist: DataFrame, keys: Sequence[str], *, blocked: bool | None = None) -> DataFrame:
    """KS distance of the fitted tail for every candidate threshold.

    Candidates meet values as pairs of packed chunks, so a task sees two chunks and returns one row
    per candidate; a wide histogram spreads over many tasks.
    """
    keys = list(keys)
    # read three times below, and one row per distinct value
    cand = checkpointed(
        threshold_candidates(hist, keys, blocked=blocked).withColumn(
            "_chunk", F.floor((F.col("rank") - 1) / F.lit(CHUNK))
        )
    )
    values = cand.groupBy(*keys, F.col("_chunk").alias("_v")).agg(
        F.max("value").alias("_v_top"),
        F.array_sort(F.collect_list(F.struct("value", "n_ge"))).alias("_values"),
    )
    tries = cand.where(F.col("alpha").isNotNull()).groupBy(*keys, F.col("_chunk").alias("_c")).agg(
        F.min("value").alias("_c_low"),
        F.array_sort(F.collect_list(F.struct("value", "alpha", "n_ge"))).alias("_tries"),
    )
    pairs = tries.join(values, keys).where(F.col("_v_top") >= F.col("_c_low"))
    packed = pairs.select(
        *keys,
        *[F.transform("_tries", field(f, "double")).alias(f"_c_{f}") for f in ("value", "alpha", "n_ge")],
        *[F.transform("_values", field(f, "double")).alias(f"_v_{f}") for f in ("value", "n_ge")],
        "_c",
        "_v",
    )
    pairs = spread(packed, *keys, "_c", "_v").drop("_c", "_v")
    types = dict(pairs.select(*keys).dtypes)

    def measure(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                x, a, n, v, g = (
                    np.asarray(row[c], float)
                    for c in ("_c_value", "_c_alpha", "_c_n_ge", "_v_value", "_v_n_ge")
                )
                part = pd.DataFrame({"xmin": x.astype("int64"), "ks": tail_distance(x, a, n, v, g)})
                for k in keys:
                    part[k] = row[k]
                out.append(part)
            if out:
                yield pd.concat(out)[[*keys, "xmin", "ks"]]

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", xmin bigint, ks double"
    ks = pairs.mapInPandas(measure, schema).groupBy(*keys, "xmin").agg(F.max("ks").alias("ks"))
    info = cand.where(F.col("alpha").isNotNull()).select(
        *keys, F.col("value").alias("xmin"), "alpha", F.col("n_ge").alias("n_tail"), "n"
    )
    return info.join(ks, [*keys, "xmin"])


def fit_tail(hist: DataFrame, keys: Sequence[str], *, blocked: bool | None = None) -> DataFrame:
    """Threshold with the smallest KS distance (smallest threshold on ties) and its exponent."""
    scan = threshold_scan(hist, keys, blocked=blocked)
    best = F.min_by(F.struct("xmin", "alpha", "ks", "n_tail", "n"), F.struct("ks", "xmin"))
    return scan.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def tail_alternatives(hist: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Likelihood ratios against the alternatives, one row per (set, alternative).

    One grouped task per set works on the tail histogram, whose length is the number of distinct
    values, not of observations.
    """
    keys = list(keys)
    tail = hist.join(fits.select(*keys, "xmin", "alpha"), keys).where(F.col("value") >= F.col("xmin"))
    types = dict(tail.select(*keys).dtypes)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        ratios = likelihood_ratios(
            pdf["value"].to_numpy(), pdf["cnt"].to_numpy(), float(pdf["xmin"].iloc[0]), float(pdf["alpha"].iloc[0])
        )
        rows = [
            {**{k: pdf[k].iloc[0] for k in keys}, "alternative": name, "r": r, "p": p}
            for name, (r, p) in ratios.items()
        ]
        return pd.DataFrame(rows)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", alternative string, r double, p double"
    return spread(tail, *keys).groupBy(*keys).applyInPandas(compare, schema)


def replicate_rng(seed: int, *parts) -> np.random.Generator:
    """A generator that depends only on its labels, not on partitioning or retries."""
    return np.random.default_rng([seed, *(zlib.crc32(str(p).encode()) for p in parts)])


def bootstrap_tails(
    hist: DataFrame, fits: DataFrame, keys: Sequence[str], replicates: int, seed: int = 0
) -> DataFrame:
    """Histograms of replicates: tail from the fitted law, body resampled from below the threshold.

    A replicate of ``n`` observations is made of independent batches, so a big set spreads over tasks.
    """
    keys = list(keys)
    body = (
        hist.join(fits.select(*keys, "xmin"), keys)
        .where(F.col("value") < F.col("xmin"))
        .groupBy(*keys)
        # distinct values below the threshold
        .agg(F.array_sort(F.collect_list(F.struct("value", "cnt"))).alias("_body"))
    )
    batches = F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.lit(DRAWS_PER_BATCH)))
    )
    plan = (
        fits.select(*keys, "xmin", "alpha", "n", "n_tail")
        .join(body, keys, "left")
        .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("_batch", batches)
        .select(
            *keys, "replicate", "_batch", "xmin", "alpha", "n", "n_tail",
            F.transform("_body", lambda x: x["value"]).alias("_values"),
            F.transform("_body", lambda x: x["cnt"]).alias("_counts"),
        )
    )
    plan = spread(plan, *keys, "replicate", "_batch")
    types = dict(plan.select(*keys).dtypes)

    def draw(parts):
        for pdf in parts:
            for row in pdf.to_dict("records"):
                rng = replicate_rng(seed, *(row[k] for k in keys), row["replicate"], row["_batch"])
                size = min(DRAWS_PER_BATCH, row["n"] - row["_batch"] * DRAWS_PER_BATCH)
                n_tail = int(rng.binomial(size, row["n_tail"] / row["n"]))
                value, cnt = np.unique(draw_tail(rng, n_tail, row["xmin"], row["alpha"]), return_counts=True)
                if n_tail < size:
                    share = np.asarray(row["_counts"], float)
                    body_cnt = rng.multinomial(size - n_tail, share / share.sum())
                    value = np.concatenate([value, np.asarray(row["_values"], float)])
                    cnt = np.concatenate([cnt, body_cnt])
                part = pd.DataFrame({"value": np.minimum(value, 2.0**62).astype("int64"), "cnt": cnt})
                for k in keys:
                    part[k] = row[k]
                yield part[part["cnt"] > 0].assign(replicate=row["replicate"])[
                    [*keys, "replicate", "value", "cnt"]
                ]

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", replicate int, value bigint, cnt bigint"
    drawn = plan.mapInPandas(draw, schema)
    return drawn.groupBy(*keys, "replicate", "value").agg(F.sum("cnt").alias("cnt"))


def bootstrap_p(
    hist: DataFrame, fits: DataFrame, keys: Sequence[str], replicates: int = 200, seed: int = 0
) -> DataFrame:
    """Share of replicates whose best fit is at least as far from its data as the observed one."""
    keys = list(keys)
    drawn = checkpointed(bootstrap_tails(hist, fits, keys, replicates, seed))
    redone = fit_tail(drawn, [*keys, "replicate"]).select(*keys, "replicate", F.col("ks").alias("_ks"))
    counted = redone.join(fits.select(*keys, "ks"), keys).groupBy(*keys).agg(
        (F.count_if(F.col("_ks") >= F.col("ks")) / F.lit(replicates)).alias("p_boot")
    )
    return fits.select(*keys).join(counted, keys, "left").withColumn("p_boot", F.coalesce("p_boot", F.lit(0.0)))


def tail_passes(p_boot, worst_ratio):
    """Not rejected by the bootstrap (a missing one decides nothing) and no alternative preferred.

    ``worst_ratio`` is true when some alternative has R < 0 with p < 0.05.
    """
    rejected = F.coalesce(p_boot < P_BOOT_FLOOR, F.lit(False))
    return ~rejected & ~worst_ratio


def tail_verdict(
    hist: DataFrame, keys: Sequence[str], *, replicates: int = 0, seed: int = 0
) -> DataFrame:
    """One row per set: exponent, threshold, alternatives, bootstrap p and the pass flag.

    Sets with fewer than two distinct values have no fit: all NULL, not passing.
    """
    keys = list(keys)
    hist = checkpointed(hist)
    sets = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    usable = hist.join(sets.where("n_distinct >= 2").select(*keys), keys, "left_semi")
    fits = checkpointed(fit_tail(usable, keys))
    ratios = tail_alternatives(usable, fits, keys)
    wide = ratios.groupBy(*keys).agg(
        F.bool_or((F.col("r") < 0) & (F.col("p") < P_RATIO_CUT)).alias("_preferred"),
        *[
            F.max(F.when(F.col("alternative") == a, F.col(c))).alias(f"{c}_{a}")
            for a in ALTERNATIVES
            for c in ("r", "p")
        ],
    )
    joined = sets.join(fits, keys, "left").join(wide, keys, "left")
    if replicates > 0:
        joined = joined.join(bootstrap_p(usable, fits, keys, replicates, seed), keys, "left")
    else:
        joined = joined.withColumn("p_boot", F.lit(None).cast("double"))
    passes = F.when(F.col("alpha").isNull(), F.lit(False)).otherwise(
        tail_passes(F.col("p_boot"), F.col("_preferred"))
    )
    return joined.withColumn("passes", passes).drop("_preferred")
