"""Group events into cascades by parent link or by quiet time, and compare labelings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.operators.sequence import arrange, group_quantiles, has_hot_group
from ripplework.operators.shape import STREAM, gaps
from ripplework.operators.validate import forest_violations, require_empty
from ripplework.session import checkpointed

# fixed values of the calibration rule
WIDTH_GRID = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
RECOVERY_THRESHOLD = 0.90
MIN_CALIBRATION_EVENTS = 200
MAX_DOUBLINGS = 64


@dataclass(frozen=True)
class MergePolicy:
    single_membership: bool = True
    bin_edge: str = "left-closed"

    def check(self) -> None:
        """Anything but the implemented policy fails before a plan is built."""
        if not self.single_membership:
            raise NotImplementedError("overlapping cascades are not implemented")
        if self.bin_edge != "left-closed":
            raise NotImplementedError(f"bin edge {self.bin_edge!r} is not implemented")


def bin_width(events: DataFrame, k: float, *, blocked: bool | None = None) -> DataFrame:
    """``dt = k * median gap`` per stream."""
    if blocked is None:
        blocked = has_hot_group(events, STREAM)
    rows = gaps(events, blocked=blocked)
    medians = group_quantiles(rows, STREAM, "gap", {"_median": 0.5}, blocked=blocked)
    counts = rows.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.join(medians, STREAM, "left").select(
        "stream_id", "n_events", (F.lit(float(k)) * F.col("_median")).alias("dt")
    )


def occupied_bins(events: DataFrame, widths: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Events per occupied bin of width ``dt`` (and per ``extra`` columns of ``events``)."""
    start = events.groupBy(*STREAM).agg(F.min("t").alias("_t0"))
    keys = [c for c in widths.columns if c not in ("stream_id", "dt", "n_events")]
    bad = F.col("dt").isNull() | F.isnan("dt") | (F.col("dt") <= 0) | (F.col("dt") == float("inf"))
    width = F.when(bad, F.raise_error(F.lit("bin width must be finite and > 0")).cast("double"))
    return (
        events.join(widths.drop("n_events"), STREAM)
        .join(start, STREAM)
        .withColumn("bin", F.floor((F.col("t") - F.col("_t0")) / width.otherwise(F.col("dt"))))
        .groupBy(*STREAM, *keys, "bin", *extra)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def bin_runs(bins: DataFrame, keys: Sequence[str], *, blocked: bool | None = None) -> DataFrame:
    """Number the runs of occupied bins; a run ends when at least one bin stays empty."""
    seq = arrange(bins, keys, ["bin"], blocked=blocked).add(lags={"_prev": "bin"})
    seq = seq.transform(
        lambda d: d.withColumn(
            "_new", F.when(F.col("bin") - F.col("_prev") > 1, F.lit(1)).otherwise(F.lit(0))
        )
    ).add(sums={"run_id": "_new"})
    return seq.rows().drop("_prev", "_new")


def quiet_time_cascades(
    events: DataFrame,
    widths: DataFrame,
    policy: MergePolicy = MergePolicy(),
    *,
    blocked: bool | None = None,
) -> DataFrame:
    """Cascades split by an empty bin: size in events, duration in bins spanned."""
    policy.check()
    if blocked is None:
        blocked = has_hot_group(events, STREAM)  # occupied bins are never more than events
    runs = bin_runs(occupied_bins(events, widths), STREAM, blocked=blocked)
    return (
        runs.groupBy("stream_id", F.col("run_id").cast("bigint").alias("cascade_id"))
        .agg(
            F.sum("cnt").alias("size"),
            (F.max("bin") - F.min("bin") + 1).cast("bigint").alias("duration"),
        )
    )


def belief_updates(labeled: DataFrame) -> DataFrame:
    return labeled.where(F.col("is_update"))


def event_depth(labeled: DataFrame) -> DataFrame:
    """Depth of every event in its reply tree (root = 1), by pointer doubling.

    Each round replaces the ancestor by the ancestor's ancestor, so the number of joins is the log of
    the deepest chain. Finished rows leave the probing side, which keeps root hubs out of the join.
    """
    state = checkpointed(
        labeled.select(
            "stream_id",
            "idx",
            F.col("parent_idx").alias("_anc"),
            F.when(F.col("parent_idx").isNull(), 0).otherwise(1).cast("bigint").alias("_hops"),
        )
    )
    for _ in range(MAX_DOUBLINGS):
        active = state.where(F.col("_anc").isNotNull())
        if active.isEmpty():
            break
        lookup = state.select(
            "stream_id",
            F.col("idx").alias("_anc"),
            F.col("_anc").alias("_next"),
            F.col("_hops").alias("_more"),
        )
        stepped = active.join(lookup, ["stream_id", "_anc"]).select(
            "stream_id",
            "idx",
            F.col("_next").alias("_anc"),
            (F.col("_hops") + F.col("_more")).alias("_hops"),
        )
        state = checkpointed(stepped.unionByName(state.where(F.col("_anc").isNull())))
    else:
        raise ValueError("parent links contain a cycle; check forest_violations first")
    return labeled.join(
        state.select("stream_id", "idx", (F.col("_hops") + 1).alias("depth")), ["stream_id", "idx"]
    )


def reply_tree_cascades(labeled: DataFrame, *, strict: bool = True) -> DataFrame:
    """Cascades as reply trees: size in events, duration as deepest generation."""
    if strict:
        labeled = require_empty(forest_violations(labeled), labeled, "reply forest breaks its rules")
    return (
        event_depth(labeled)
        .groupBy("stream_id", F.col("root_idx").alias("cascade_id"))
        .agg(F.count(F.lit(1)).alias("size"), F.max("depth").alias("duration"))
    )


def adjusted_rand(
    cells: DataFrame, keys: Sequence[str], label_a: str, label_b: str, cnt: str = "cnt"
) -> DataFrame:
    """Adjusted Rand index from contingency counts; 1.0 when the maximum equals the expectation.

    Cells and both margins come from one pass over grouping sets.
    """
    keys = list(keys)
    sets = [[*keys, label_a, label_b], [*keys, label_a], [*keys, label_b]]
    table = cells.groupingSets(sets, *keys, label_a, label_b).agg(
        F.sum(cnt).cast("decimal(19,0)").alias("_c"),
        F.grouping(label_a).alias("_no_a"),
        F.grouping(label_b).alias("_no_b"),
    )
    # pair counts are kept doubled, as exact decimals, until the last division
    pairs = (F.col("_c") * (F.col("_c") - 1)).cast("decimal(38,0)")
    both = (F.col("_no_a") == 0) & (F.col("_no_b") == 0)
    joined = table.groupBy(*keys).agg(
        F.sum(F.when(both, pairs)).alias("_ab"),
        F.sum(F.when(F.col("_no_b") == 1, pairs)).alias("_a"),
        F.sum(F.when(F.col("_no_a") == 1, pairs)).alias("_b"),
        F.sum(F.when(both, F.col("_c"))).cast("bigint").alias("_n"),
    )
    pa, pb, pab = (F.col(c).cast("double") / 2.0 for c in ("_a", "_b", "_ab"))
    n = F.col("_n").cast("double")
    total = n * (n - 1.0) / 2.0
    expected = F.when(total > 0, pa * pb / total).otherwise(F.lit(0.0))
    most = (pa + pb) / 2.0
    ari = F.when(most == expected, F.lit(1.0)).otherwise((pab - expected) / (most - expected))
    return joined.select(*keys, F.col("_n").alias("n_events"), ari.alias("ari"))


def calibrate_width(
    labeled: DataFrame,
    grid: Sequence[float] = WIDTH_GRID,
    min_events: int = MIN_CALIBRATION_EVENTS,
    *,
    blocked: bool | None = None,
) -> DataFrame:
    """Mean agreement of quiet-time labels with true roots for every width factor ``k``.

    Streams below ``min_events`` are left out; ``used_streams`` tells how many remained, and with
    none every value is 0.0. ``is_best`` marks the largest mean (first k on ties).
    """
    if blocked is None:
        blocked = has_hot_group(labeled, STREAM)
    events = checkpointed(labeled.select("stream_id", F.col("idx").alias("event_id"), "t", "root_idx"))
    medians = bin_width(events, 1.0, blocked=blocked).where(F.col("n_events") >= min_events)
    ks = F.explode(F.array(*[F.lit(float(k)) for k in grid]))
    widths = medians.select("stream_id", ks.alias("k"), "dt").withColumn("dt", F.col("dt") * F.col("k"))
    if not blocked:  # whole streams lie together, so that events and not their cells for every k are shuffled
        events = events.repartition("stream_id")
    cells = occupied_bins(events, widths, extra=["root_idx"])
    # cells of one bin are neighbours without a gap, so they share its run; events without a time are in none
    labeled_cells = bin_runs(cells.where(F.col("bin").isNotNull()), ["stream_id", "k"], blocked=blocked)
    ari = adjusted_rand(labeled_cells, ["stream_id", "k"], "run_id", "root_idx")
    means = checkpointed(ari.groupBy("k").agg(F.avg("ari").alias("_m"), F.count(F.lit(1)).alias("_used")))  # read twice below
    frame = labeled.sparkSession.createDataFrame([(float(k),) for k in grid], "k double")
    scored = frame.join(F.broadcast(means), "k", "left").select(  # one row per k
        "k",
        F.coalesce("_m", F.lit(0.0)).alias("mean_ari"),
        F.coalesce("_used", F.lit(0)).cast("bigint").alias("used_streams"),
    )
    best = scored.agg(
        F.max_by("k", F.struct("mean_ari", -F.col("k"))).alias("_best_k"),
        F.max("mean_ari").alias("_best"),
    )
    return scored.join(F.broadcast(best)).select(  # one row
        "k",
        "mean_ari",
        "used_streams",
        (F.col("k") == F.col("_best_k")).alias("is_best"),
        (F.col("_best") >= RECOVERY_THRESHOLD).alias("cleared"),
    )


def structural_branching(cascades: DataFrame) -> DataFrame:
    """``1 - roots / events`` per stream."""
    return cascades.groupBy(*STREAM).agg(
        (1.0 - F.count(F.lit(1)) / F.sum("size")).alias("n_struct")
    )


def generative_branching(events_per_stream: DataFrame, counters: DataFrame) -> DataFrame:
    """Successes over events per stream."""
    return events_per_stream.join(counters, STREAM).select(
        "stream_id", F.try_divide(F.col("successes"), F.col("n_events")).alias("n_tree")
    )


def trajectory_variance(trajectory: DataFrame) -> DataFrame:
    return trajectory.groupBy(*STREAM).agg(F.var_pop("value").alias("chi"))


def reply_share(forest: DataFrame) -> DataFrame:
    """``stream_id, n_true``: replies as a share of all events, the branching ratio that a labelled forest has."""
    is_reply = F.when(F.col("parent_idx").isNotNull(), 1.0).otherwise(0.0)
    return forest.groupBy("stream_id").agg(F.avg(is_reply).alias("n_true"))
